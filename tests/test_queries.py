"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6) for a, b in zip(g, w, strict=True)), (g, w)
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
