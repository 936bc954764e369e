"""Sweeps over numbers of clusters and mining settings, and the rankings of their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import clusters as C
from . import evaluation as E
from . import itemsets as I
from . import pairs as P
from . import similarity as S

HIGHER = ("silhouette", "ch", "separation")


def sweep_metrics(points: DataFrame, assigned: DataFrame, distance=None) -> DataFrame:
    """k, silhouette, ch, separation (mean distance between over within clusters) of several clusterings of ``points`` (id, v);
    ``assigned`` (k, id, cluster).  One row a clustering, of which there are few; distances are computed once for all of them, block
    against block, and only each point's means over clusters are kept."""
    assigned = written(assigned)
    means = written(P.mean_distances_of(points, assigned, distance or S.euclid))
    out = []
    for (k,) in sorted(tuple(r) for r in assigned.select("k").distinct().collect()):  # a row a clustering
        own = assigned.where(F.col("k") == k).select("id", "cluster")
        m = means.where(F.col("k") == k)
        row = E.silhouette(m).select("silhouette").join(E.calinski_harabasz(points.join(own, "id"))).join(E.separation(m).select(F.col("ratio").alias("separation")))
        out.append(row.select(F.lit(k).alias("k"), "silhouette", "ch", "separation"))
    return reduce(DataFrame.unionByName, out)


def best_by_metric(metrics: DataFrame, names: tuple[str, ...] = HIGHER) -> DataFrame:
    """metric, k, value: the k of each metric's largest value, the smallest of equals."""
    long = metrics.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("k", "x.*")
    return long.groupBy("metric").agg(F.min_by("k", F.struct(-F.round("value", 9), F.col("k"))).alias("k"), F.max("value").alias("value"))


def tree_assignments(points: DataFrame, ks, method: str = "average", distance=None) -> DataFrame:
    """k, id, cluster: one merge tree of a bounded sample, cut into each number of clusters."""
    ids = [r.id for r in E.bounded(points, 5000).select("id").orderBy("id").collect()]  # at most 5,000
    place = {x: i for i, x in enumerate(ids)}
    pairs = E.pair_table(points.withColumn("cluster", F.lit(0)), distance or S.euclid)
    tree = C.linkage(len(ids), ((place[r.a], place[r.b], r.d) for r in pairs.toLocalIterator()), method)
    rows = [(k, x, int(c)) for k in ks for x, c in zip(ids, C.cut(tree, len(ids), clusters=k), strict=True)]
    return points.sparkSession.createDataFrame(rows, "k long, id long, cluster long")


def k_sweep(points: DataFrame, most: int, method: str = "average", distance=None) -> DataFrame:
    """Metrics of the tree's clusters for each k from 2 to ``most``."""
    return sweep_metrics(points, tree_assignments(points, range(2, most + 1), method, distance), distance)


def agreement(assigned: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ari, nmi, purity (mean over clusters) of several clusterings (keys, id, cluster) against labels (id, label)."""
    # Labels are as many as points: a file that packs well is not taken for a small table and sent to every task through the driver.
    rows = assigned.join(labels.where("label IS NOT NULL AND lower(label) <> 'unknown'").hint("merge"), "id")
    c = rows.groupBy(*keys, "cluster", "label").agg(F.count("*").cast("double").alias("c"))
    c = c.withColumns({"x": F.sum("c").over(Window.partitionBy(*keys, "cluster")), "y": F.sum("c").over(Window.partitionBy(*keys, "label"))})
    half = lambda v: F.sum(F.col("c") * (F.col(v) - 1) / 2)
    log = lambda v: F.sum(F.col("c") * F.ln(v))
    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    t = c.groupBy(*keys).agg(F.sum("c").alias("n"), half("c").alias("s"), half("x").alias("a"), half("y").alias("b"), log("c").alias("lc"), log("x").alias("lx"), log("y").alias("ly"))
    expected, top, hu, hv = F.col("a") * F.col("b") / pairs, (F.col("a") + F.col("b")) / 2, F.ln(n) - F.col("lx") / n, F.ln(n) - F.col("ly") / n
    mi = (F.col("lc") - F.col("lx") - F.col("ly")) / n + F.ln(n)
    t = t.select(*keys, F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"), F.when(F.abs(hu + hv) < 1e-12, 1.0).otherwise(2 * mi / (hu + hv)).alias("nmi"))
    purity = c.groupBy(*keys, "cluster").agg((F.max("c") / F.max("x")).alias("p")).groupBy(*keys).agg(F.avg("p").alias("purity"))
    return t.join(purity, keys)


def combined_ranking(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results with combined, the mean of ari, nmi and purity, and their rank by it."""
    scored = results.withColumn("combined", (F.col("ari") + F.col("nmi") + F.col("purity")) / 3)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("combined", 9)), *keys)).cast("long"))


def summary_by(ranked: DataFrame, key: str) -> DataFrame:
    """key, mean and largest combined score."""
    return ranked.groupBy(key).agg(F.avg("combined").alias("avg_combined"), F.max("combined").alias("max_combined"))


def metric_rankings(rows: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """metric, rank, name, value: a list for each metric, the largest first."""
    long = rows.select(name, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(name, "x.*")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc(F.round("value", 9)), name)).cast("long"))


def pivot_mean(rows: DataFrame, index: str, columns: list[str], value: Column, values: list[tuple]) -> DataFrame:
    """A row for each ``index`` and a column a_b for each of the given pairs of ``columns``: the mean of ``value``."""
    return rows.groupBy(index).agg(*[F.avg(F.when(reduce(lambda p, q: p & q, [F.col(c) == x for c, x in zip(columns, pair, strict=True)]), value)).alias("_".join(map(str, pair))) for pair in values])


def experiment(items: DataFrame, labels: DataFrame, found: DataFrame, baskets: int, strategy: str = "coverage", sample: int = 5000, ks: tuple[int, ...] = (10,), size: int | None = None) -> DataFrame:
    """strategy, size, k, itemsets, ari, nmi, purity: itemsets of one size chosen by a strategy, a sample's Jaccard distances over
    them, average linkage, cuts.  ``found`` (items, k, count); baskets without any chosen itemset are left out."""
    chosen = found if size is None else found.where(F.col("k") == size)
    ways = {"coverage": lambda: I.select_coverage(chosen, baskets, 0.8), "top_support": lambda: I.select_top_support(chosen, 50), "balanced": lambda: I.select_balanced(chosen, 50)}
    if strategy not in ways:
        raise ValueError(f"no such strategy: {strategy}")
    sets = written(ways[strategy]().select(F.array_join("items", " + ").alias("itemset"), "items"))
    drawn = written(C.stratified(labels, sample))
    held = I.containment(items.join(drawn.select("basket_id"), "basket_id", "left_semi"), sets)
    points = written(held.groupBy(F.col("basket_id").alias("id")).agg(F.collect_set("itemset").alias("v")))
    setting = {"strategy": F.lit(strategy), "size": F.lit(size or 0)}  # size 0: of all sizes
    assigned = tree_assignments(points, ks, "average", S.jaccard_distance).withColumns(setting)
    scores = agreement(assigned, drawn.select(F.col("basket_id").alias("id"), "label"), [*setting, "k"])
    return scores.withColumn("itemsets", F.lit(sets.count()))


def sweep(items: DataFrame, labels: DataFrame, found: DataFrame, baskets: int, strategies: tuple[str, ...], sizes: tuple[int, ...], ks: tuple[int, ...], sample: int = 5000) -> DataFrame:
    """All experiments of the strategies and sizes; one tree gives all its ks."""
    return reduce(DataFrame.unionByName, [experiment(items, labels, found, baskets, s, sample, ks, n) for s in strategies for n in sizes])
