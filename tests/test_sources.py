"""Readers, writers, reports, the result cache, blocks of rows and experiments."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panier.operators import clusters as C
from panier.operators import evaluation as E
from panier.operators import experiments as X
from panier.operators import itemsets as I
from panier.operators import matching as M
from panier.operators import similarity as S
from panier.sources import readers, scratch, writers


def test_parquet_overwrites_and_appends(spark, tmp_path):
    path, one = f"file://{tmp_path}/t", spark.range(3)
    writers.parquet(one, path)
    writers.parquet(one, path)
    assert spark.read.parquet(path).count() == 3
    writers.parquet(one, path, mode="append")
    assert spark.read.parquet(path).count() == 6


def test_json_written_and_inferred(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, [])], "id long, name string, items array<string>")
    writers.json(df, f"file://{tmp_path}/lines")
    assert {r.id: r.name for r in readers.json_lines(spark, f"file://{tmp_path}/lines").collect()} == {1: "a", 2: None}
    (tmp_path / "array.json").write_text(json.dumps([{"id": 1, "cuisine": "x"}, {"id": 2, "cuisine": "y"}]))
    got = readers.json_array(spark, f"file://{tmp_path}/array.json")
    assert dict(got.dtypes) == {"id": "bigint", "cuisine": "string"} and got.count() == 2
    assert [tuple(r) for r in writers.described(got).orderBy("column_name").collect()] == [("cuisine", "string"), ("id", "bigint")]


def test_itemset_dictionaries_skip_missing_files(spark, tmp_path):
    one = {"a + b": {"items": ["a", "b"], "count": 3, "support": 0.3, "support_percentage": "30.00%"}}
    (tmp_path / "two.json").write_text(json.dumps(one))
    paths = [f"file://{tmp_path}/two.json", f"file://{tmp_path}/none.json"]
    assert [r.items for r in readers.itemset_dictionaries(spark, paths).collect()] == [["a", "b"]]
    assert readers.itemset_dictionaries(spark, paths[1:]) is None


def test_row_blocks_and_cache(spark, tmp_path):
    rows = spark.range(0, 103, 1, 5).select((F.col("id") * 37 % 103).alias("id"))
    got = {r.block: (r.n, r.lo, r.hi) for r in readers.row_blocks(rows, "id", 4).groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert got == {0: (26, 0, 25), 1: (26, 26, 51), 2: (26, 52, 77), 3: (25, 78, 102)}
    calls = []

    def compute():
        calls.append(1)
        return spark.range(4)

    for params in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert readers.cached(spark, f"file://{tmp_path}/cache", "x", params, compute).count() == 4
    assert len(calls) == 2


def test_tables_and_reports(spark):
    df = spark.createDataFrame([("a & b", 1.5)], "name string, value double")
    assert writers.latex_table(df).splitlines()[3] == r"a \& b & 1.5 \\"
    assert "<td>a &amp; b</td>" in writers.html_table(df, "t") and "<h1>t</h1>" in writers.html_table(df, "t")
    row = spark.createDataFrame([("x", 2, 7, 3.5, 0.5, "g", 0.25)], "label string, baskets long, items long, avg_size double, std_size double, top_group string, rarity double").first()
    assert writers.label_report(row).splitlines()[1:3] == ["Total baskets: 2", "Total items: 7"]
    sim = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("b", "c", 0.7)], "a string, b string, sim double")
    report = writers.similarity_report(S.top_pairs(sim, 2), S.top_triplets(sim, 1), S.neighbours(sim, 1))
    assert "a - b: 0.900" in report and "a - b - c: 0.700" in report and "c: b (0.700)" in report
    stats = spark.createDataFrame([("s", 0.5, 0.25, 0.75), ("t", 0.75, 0.25, 0.5)], "strategy string, clustering_rate double, high_confidence_rate double, avg_score double")
    assert writers.strategy_report(stats).splitlines()[0].startswith("1. t: clustering 75.0%")


def test_shared_folder_is_asked_for(spark):
    assert scratch.written(spark.range(5)).count() == 5


def test_sweep_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (8, 2)) for c in (0, 4, 9)])
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>")
    metrics = X.k_sweep(points, 5)
    best = {r.metric: r.k for r in X.best_by_metric(metrics).collect()}
    assert best["silhouette"] == best["ch"] == 3
    three = metrics.where("k = 3").first()
    c = np.repeat([0, 1, 2], 8)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    same, off = c[:, None] == c[None], ~np.eye(24, dtype=bool)
    assert abs(three.separation - d[~same].mean() / d[same & off].mean()) < 1e-9
    with pytest.raises(ValueError):
        E.bounded(points, 3)


def test_experiment_sweep(spark):
    rows = [(i, f"{'ab'[i % 2]}{j}", 1) for i in range(40) for j in range(3)]
    items = spark.createDataFrame(rows, "basket_id long, item string, n long")
    labels = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(40)], "basket_id long, label string")
    found = I.mine(items, 5, 3)
    out = X.combined_ranking(X.sweep(items, labels, found, 40, ("coverage", "top_support"), (2, 3), (2,), 30), ["strategy", "size", "k"]).collect()
    assert len(out) == 4 and [r.rank for r in sorted(out, key=lambda r: r.rank)] == [1, 2, 3, 4] and all(abs(r.ari - 1) < 1e-9 for r in out if r.strategy == "top_support")
    assert X.summary_by(X.combined_ranking(spark.createDataFrame([(2, 0.5, 0.5, 0.5), (2, 1.0, 1.0, 1.0)], "size long, ari double, nmi double, purity double"), ["size"]), "size").first().max_combined == 1.0
    with pytest.raises(ValueError):
        X.experiment(items, labels, found, 40, "none")


def test_respelt_names(spark):
    docs = spark.createDataFrame([(1, "olive oil"), (2, "rice")], "doc_id long, text string")
    q = spark.createDataFrame([("oliv oyl",), ("rice",), ("qqqqq oil",), ("zzz",)], "q string")
    assert {(r.q, r.doc_id) for r in M.searched(docs, q).collect()} == {("oliv oyl", 1), ("rice", 2), ("qqqqq oil", 1)}


def test_stems_and_stop_words(spark):
    from panier.functions.stem import stem

    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam triplicate:triplic hopeful:hope goodness:good revival:reviv adjustment:adjust adoption:adopt probate:probat rate:rate controlling:control"
    assert all(stem(a) == b for a, b in (p.split(":") for p in pairs.split())), [(a, stem(a)) for a, b in (p.split(":") for p in pairs.split()) if stem(a) != b]
    docs = spark.createDataFrame([(1, "roasted peppers with oil"), (2, "pepper"), (3, "with rice")], "doc_id long, text string")
    q = spark.createDataFrame([("roasting pepper with",)], "q string")
    assert {r.doc_id for r in M.bm25(docs, q, stop=["with"], stem=True).collect()} == {1, 2}
    assert {r.doc_id for r in M.bm25(docs, q).collect()} == {1, 2, 3}


def test_profiles_of_clusters(spark):
    items = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 1)], "basket_id long, item string, n long")
    clusters = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "basket_id long, cluster long")
    assert {(r.cluster, r.item): (r.count, r.share, r.rank) for r in C.item_profile(items, clusters).collect()}[0, "a"][1:] == (1.0, 1)
    assert {r.cluster: r.avg_items for r in C.cluster_sizes(items, clusters).collect()} == {0: 2.0, 1: 0.5}
    assert {r.basket_id: r["items"] for r in C.sample_head(items, clusters, width=1).collect()} == {1: ["a"], 2: ["a"], 3: ["c"]}
    assert S.distance("hamming") is S.hamming_share
    with pytest.raises(ValueError):
        S.distance("none")
