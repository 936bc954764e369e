"""What must not grow with the tables: tables sent through the driver, rows of a task."""

import re

from pyspark.sql import functions as F

from panier.operators import baskets as B
from panier.operators import experiments as X
from panier.operators import groups as G
from panier.operators import itemsets as I
from panier.operators import ml
from panier.operators import similarity as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_not_broadcast(spark):
    a = spark.range(40).selectExpr("id", "id % 3 AS k", "id % 4 AS cluster")
    labels = spark.range(40).selectExpr("id", "CAST(id % 5 AS string) AS label")
    got = X.agreement(a, labels, ["k"])
    assert "SortMergeJoin [id" in plan(got) and got.count() == 3


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "FEW", 10)
    monkeypatch.setattr(B, "ROWS", 20)
    rows = [(i % 30, f"i{i * 7 % 11}") for i in range(300)]
    lines = spark.createDataFrame(rows, "b long, i string")
    items = B.basket_items(lines, "b", F.col("i"), len(rows))
    labels = spark.range(30).selectExpr("id AS basket_id", "CAST(id % 3 AS string) AS label")
    few = B.basket_items(lines, "b", F.col("i"))
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    dealt = r"hashpartitioning\({}#\d+L?, 15\)"
    for make, key in (
        (lambda x, n: x, "basket_id"), (lambda x, n: G.item_percent(x, labels), "basket_id"), (lambda x, n: S.label_cosine(S.label_vectors(x, labels, "frequency", n)).select("a", "b", F.round("sim", 9)), "item"),
        (lambda x, n: S.mean_cosine_by_label(x, labels, n).select("label", "pairs", F.round("mean", 9)), "basket_id"), (lambda x, n: I.pairs_set(x, 3), "basket_id"),
    ):
        assert re.search(dealt.format(key), plan(make(items, 300))) and same(make(items, 300), make(few, None))
    assert same(I.mine(items, 3, 3, multiset=True), I.mine(few, 3, 3, multiset=True))


def test_token_means_keep_vectors_whole(spark):
    tok = spark.createDataFrame([(1, ["a", "b", "a", "?"]), (2, ["?"]), (3, None), (4, ["b"])], "id long, tokens array<string>")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, None])], "token string, v array<double>")
    got = ml.token_mean(tok, vec, 2)
    assert {r.id: r.v for r in got.collect()} == {1: [2.5, 2.0], 2: None, 3: None, 4: [1.5, None]}
    assert "posexplode" not in plan(got)  # no row a dimension


def test_best_documents_without_all_pairs(spark):
    from panier.operators import matching as M

    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + i * j % 9)}" for j in range(i % 5 + 1)) + " the") for i in range(40)] + [(3, "wb wb"), (99, "")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([("the wa",), ("wb, wc wd",), ("zzz",), ("",)], "q string")
    key = lambda df: sorted((r.q, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    got = M.bm25_top(docs, queries, 4)
    assert "SortMergeJoin" not in plan(got) and key(got) == key(M.bm25_top(docs, queries, 4, cells=0)) and len(key(got)) == 8
