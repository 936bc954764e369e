"""Similarities of baskets, labels and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baskets import dealt


def overlaps(items: DataFrame, labels: DataFrame) -> DataFrame:
    """label, a, b, inter, na, nb for pairs of a label's baskets that share an item: a join on the item, not all pairs."""
    f = items.select("basket_id", "item").distinct().join(labels, "basket_id")
    n = f.groupBy("basket_id").agg(F.count("*").alias("size"))
    x = f.join(n, "basket_id")
    a, b = x.alias("a"), x.alias("b")
    on = (F.col("a.item") == F.col("b.item")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.basket_id") < F.col("b.basket_id"))
    return a.join(b, on).groupBy(F.col("a.label").alias("label"), F.col("a.basket_id").alias("a"), F.col("b.basket_id").alias("b")).agg(F.count("*").alias("inter"), F.first("a.size").alias("na"), F.first("b.size").alias("nb"))




def jaccard() -> Column:
    return F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))


def cosine() -> Column:
    return F.col("inter") / F.sqrt(F.col("na").cast("double") * F.col("nb"))


def pair_totals(items: DataFrame, labels: DataFrame) -> DataFrame:
    n = items.select("basket_id").distinct().join(labels, "basket_id").groupBy("label").agg(F.count("*").alias("baskets"))
    return n.withColumn("pairs", F.floor(F.col("baskets") * (F.col("baskets") - 1) / 2).cast("long"))


def mean_by_label(items: DataFrame, labels: DataFrame, measure: Column) -> DataFrame:
    """label, pairs, mean over all pairs: those that share nothing add 0 and need not be made."""
    s = overlaps(items, labels).groupBy("label").agg(F.sum(measure).alias("s"))
    return pair_totals(items, labels).join(s, "label", "left").select("label", "pairs", (F.coalesce("s", F.lit(0.0)) / F.col("pairs")).alias("mean"))


def mean_cosine_by_label(items: DataFrame, labels: DataFrame, n: int | None = None) -> DataFrame:
    """label, pairs, mean of the cosine over all pairs, without any pair: an item's baskets add half the square of their sum of
    1 / sqrt(size), less the sum of squares.  ``n``: about how many rows ``items`` has."""
    f = items.select("basket_id", "item").distinct().join(labels, "basket_id")
    x = dealt(f.select("label", "item", F.count("*").over(Window.partitionBy("basket_id")).alias("size")), n, "label", "item")
    one = 1 / F.sqrt(F.col("size").cast("double"))
    per = x.groupBy("label", "item").agg(((F.sum(one) ** 2 - F.sum(1 / F.col("size"))) / 2).alias("s"))
    s = per.groupBy("label").agg(F.sum("s").alias("s"))
    return pair_totals(items, labels).join(s, "label", "left").select("label", "pairs", (F.coalesce("s", F.lit(0.0)) / F.col("pairs")).alias("mean"))


def histogram_by_label(items: DataFrame, labels: DataFrame, measure: Column, bins: int = 10) -> DataFrame:
    """label, bin, count over [0, 1]; the pairs that share nothing are added to bin 0 by subtraction."""
    at = F.least(F.floor(measure * bins + 1e-9), F.lit(bins - 1)).cast("long")
    some = overlaps(items, labels).groupBy("label", at.alias("bin")).agg(F.count("*").alias("count"))
    rest = pair_totals(items, labels).join(some.groupBy("label").agg(F.sum("count").alias("c")), "label", "left").select("label", F.lit(0).cast("long").alias("bin"), (F.col("pairs") - F.coalesce("c", F.lit(0))).alias("count"))
    return some.unionByName(rest).groupBy("label", "bin").agg(F.sum("count").alias("count"))


def label_vectors(items: DataFrame, labels: DataFrame, weight: str = "binary", n: int | None = None) -> DataFrame:
    """label, item, w: 1, or the share of the label's baskets.  ``n``: about how many rows ``items`` has, of many items; all that follows
    is by item."""
    rows = dealt(items.select("basket_id", "item").join(labels.select("basket_id", "label").distinct(), "basket_id").select("label", "item"), n, "item")
    has = rows.groupBy("label", "item").agg(F.count("*").alias("has"))  # a basket has a row an item
    if weight == "binary":
        return has.select("label", "item", F.lit(1.0).alias("w"))
    baskets = labels.groupBy("label").agg(F.countDistinct("basket_id").alias("baskets"))
    return has.join(F.broadcast(baskets), "label").select("label", "item", (F.col("has") / F.col("baskets")).alias("w"))


def label_cosine(vectors: DataFrame) -> DataFrame:
    """a, b (a < b), sim: inner products by a join on the item."""
    norm = vectors.groupBy("label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = vectors.alias("x").join(vectors.alias("y"), F.expr("x.item = y.item AND x.label < y.label")).groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("dot"))
    na, nb = norm.select(F.col("label").alias("a"), F.col("norm").alias("na")), norm.select(F.col("label").alias("b"), F.col("norm").alias("nb"))
    return dot.join(na, "a").join(nb, "b").where("na > 0 AND nb > 0").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("sim"))


def masked(sim: DataFrame, least: float = 0.4) -> DataFrame:
    return sim.withColumn("sim", F.when(F.col("sim") >= least, F.col("sim")))


def top_pairs(sim: DataFrame, k: int) -> DataFrame:
    return sim.orderBy(F.desc(F.round("sim", 9)), "a", "b").limit(k)


def top_triplets(sim: DataFrame, k: int) -> DataFrame:
    """a < b < c with the mean of their three similarities."""
    x, y, z = sim.alias("x"), sim.alias("y"), sim.alias("z")
    t = x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("z.a") == F.col("x.a")) & (F.col("z.b") == F.col("y.b")))
    mean = (F.col("x.sim") + F.col("y.sim") + F.col("z.sim")) / 3
    return t.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"), mean.alias("sim")).orderBy(F.desc(F.round("sim", 9)), "a", "b", "c").limit(k)


def neighbours(sim: DataFrame, k: int = 3) -> DataFrame:
    both = sim.select(F.col("a").alias("label"), F.col("b").alias("other"), "sim").unionByName(sim.select(F.col("b").alias("label"), F.col("a").alias("other"), "sim"))
    w = Window.partitionBy("label").orderBy(F.desc(F.round("sim", 9)), "other")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 for two empty ones."""
    n = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - n
    return F.when(union == 0, 0.0).otherwise(1 - n / union)


def hamming_share(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a)


DISTANCES = {"jaccard": jaccard_distance, "cosine": cosine_distance, "hamming": hamming_share, "euclidean": euclid}


def distance(name: str):
    """The distance of that name between two array columns."""
    if name not in DISTANCES:
        raise ValueError(f"no such distance: {name}")
    return DISTANCES[name]


def in_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows with ord, the place of ``column`` in a stated order; those it does not name come last."""
    places = rows.sparkSession.createDataFrame(list(enumerate(order)), f"ord int, `{column}` string")
    return rows.join(F.broadcast(places), column, "left").withColumn("ord", F.coalesce("ord", F.lit(len(order))))
