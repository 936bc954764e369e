"""How clusters agree with labels, and how well they separate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CLUSTERS = 10_000


def contingency(rows: DataFrame) -> DataFrame:
    """cluster, label, c; rows of unknown label are left out on both sides."""
    return rows.where("label IS NOT NULL AND lower(label) <> 'unknown'").groupBy("cluster", "label").agg(F.count("*").alias("c"))


def per_cluster(rows: DataFrame) -> DataFrame:
    """cluster, size, dominant (smallest of equals), purity, entropy in bits."""
    c = contingency(rows)
    p = F.col("c") / F.sum("c").over(Window.partitionBy("cluster"))
    return c.withColumn("p", p).groupBy("cluster").agg(F.sum("c").alias("size"), F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("dominant"), F.max("p").alias("purity"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def confusion(rows: DataFrame) -> DataFrame:
    """cluster, label, c, share of the cluster."""
    return contingency(rows).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("cluster")))


def _pairs(c: Column) -> Column:
    return c.cast("double") * (c.cast("double") - 1) / 2


def _shares(rows: DataFrame) -> DataFrame:
    """The contingency table with x and y, the sizes of the row's cluster and label: one pass, as a cell's row counts in its cluster's sum."""
    c = contingency(rows)
    return c.withColumns({"x": F.sum("c").over(Window.partitionBy("cluster")), "y": F.sum("c").over(Window.partitionBy("label"))})


def ari(rows: DataFrame) -> DataFrame:
    """Adjusted Rand index; 1 where both partitions are trivial."""
    half = lambda v: F.sum(F.col("c").cast("double") * (F.col(v) - 1) / 2)
    t = _shares(rows).agg(F.sum(_pairs(F.col("c"))).alias("s"), F.sum("c").alias("n"), half("x").alias("a"), half("y").alias("b"))
    expected = F.col("a") * F.col("b") / _pairs(F.col("n"))
    top = (F.col("a") + F.col("b")) / 2
    return t.select(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))


def nmi(rows: DataFrame) -> DataFrame:
    """Mutual information over the mean of the entropies; 1 where both are zero."""
    c, x, y = (F.col(v).cast("double") for v in "cxy")
    t = _shares(rows).agg(F.sum(c).alias("n"), F.sum(c * F.ln(c / (x * y))).alias("m"), F.sum(c * F.ln(x)).alias("hx"), F.sum(c * F.ln(y)).alias("hy"))
    n = F.col("n")
    mi, hu, hv = F.col("m") / n + F.ln(n), F.ln(n) - F.col("hx") / n, F.ln(n) - F.col("hy") / n
    both = hu + hv
    return t.select(F.when(F.abs(both) < 1e-12, 1.0).otherwise(mi / (both / 2)).alias("nmi"))


def discrimination(contained: DataFrame, labels: DataFrame, sets: DataFrame, least: int = 5, lo: float = 0.02, hi: float = 0.6, top: int = 50) -> DataFrame:
    """itemset, support, disc, score: how unevenly an itemset's baskets spread over labels, joined with its support.

    ``contained`` (basket_id, itemset), ``sets`` (itemset, support)."""
    classes = labels.where("lower(label) <> 'unknown'").agg(F.countDistinct("label").alias("m"))
    c = contained.join(labels.where("lower(label) <> 'unknown'"), "basket_id").groupBy("itemset", "label").agg(F.count("*").alias("c"))
    p = c.withColumn("n", F.sum("c").over(Window.partitionBy("itemset"))).withColumn("p", F.col("c") / F.col("n"))
    h = p.groupBy("itemset").agg(F.first("n").alias("n"), (-F.sum(F.col("p") * F.log2("p"))).alias("h")).where(F.col("n") >= least)
    most = F.when(F.col("m") > 1, F.log2(F.col("m").cast("double"))).otherwise(1.0)
    out = h.join(sets.where(F.col("support").between(lo, hi)), "itemset").join(classes).withColumn("disc", 1 - F.col("h") / most)
    return out.select("itemset", "support", "disc", (0.7 * F.col("disc") + 0.3 * F.col("support")).alias("score")).orderBy(F.desc(F.round("score", 9)), "itemset").limit(top)


def bounded(points: DataFrame, most: int) -> DataFrame:
    """``points``, or an error if they are more than ``most``: what compares all pairs is for samples, which the caller draws."""
    if (n := points.count()) > most:
        raise ValueError(f"{n} points; pairs are made of at most {most}")
    return points


def pair_table(points: DataFrame, distance, most: int = 5000) -> DataFrame:
    """a, b (a < b), ca, cb, d over all pairs of a bounded set of points (id, cluster, v), in as many tasks as there are cores."""
    bounded(points, most)
    a, b = points.select(F.col("id").alias("a"), F.col("cluster").alias("ca"), F.col("v").alias("va")), points.select(F.col("id").alias("b"), F.col("cluster").alias("cb"), F.col("v").alias("vb"))
    a = a.repartition(points.sparkSession.sparkContext.defaultParallelism)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", "ca", "cb", distance(F.col("va"), F.col("vb")).alias("d"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair seen from both ends, its distance computed once."""
    end = lambda a, ca, b, cb: F.struct(F.col(a).alias("a"), F.col(ca).alias("ca"), F.col(b).alias("b"), F.col(cb).alias("cb"))
    return pairs.select("d", F.explode(F.array(end("a", "ca", "b", "cb"), end("b", "cb", "a", "ca"))).alias("x")).select("x.*", "d")


def mean_distances(pairs: DataFrame) -> DataFrame:
    """a, ca, cb, m: each point's mean distance to each cluster's other points."""
    return both_ways(pairs).groupBy("a", "ca", "cb").agg(F.avg("d").alias("m"))


def mean_cosine_distances(points: DataFrame) -> DataFrame:
    """The same of cosine distances, without pairs: the mean of 1 - x.y over a cluster's unit vectors y is 1 less x times their mean.
    The clusters' sums go to every task: a vector for each cluster, of which there are MOST_CLUSTERS at most."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = points.select("id", "cluster", F.transform("v", lambda x: x / norm).alias("u"))
    sums = unit.select("cluster", F.posexplode("u").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("s"), F.max("n").alias("n"))
    sums = bounded(sums.select(F.col("cluster").alias("cb"), "s", "n"), MOST_CLUSTERS)
    dot = F.aggregate(F.zip_with("u", "s", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = F.col("cluster") == F.col("cb")
    mean = F.when(own, F.when(F.col("n") > 1, 1 - (dot - 1) / (F.col("n") - 1))).otherwise(1 - dot / F.col("n"))
    return unit.join(F.broadcast(sums)).select(F.col("id").alias("a"), F.col("cluster").alias("ca"), "cb", mean.alias("m"))


def silhouette(means: DataFrame) -> DataFrame:
    """From mean distances, the mean over points of (b - a) / max(a, b); points alone in their cluster count 0."""
    s = means.groupBy("a").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("m"))).alias("x"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("m"))).alias("y"))
    v = F.when(F.col("x").isNull() | F.col("y").isNull() | (F.greatest("x", "y") == 0), 0.0).otherwise((F.col("y") - F.col("x")) / F.greatest("x", "y"))
    return s.agg(F.avg(v).alias("silhouette"), F.count("*").alias("points"))


def silhouette_capped(means: DataFrame) -> DataFrame:
    """The sampled form: no neighbours in the own cluster count as distance 0, and other clusters are at most 1 away."""
    s = means.groupBy("a").agg(F.coalesce(F.max(F.when(F.col("ca") == F.col("cb"), F.col("m"))), F.lit(0.0)).alias("x"), F.least(F.lit(1.0), F.min(F.when(F.col("ca") != F.col("cb"), F.col("m")))).alias("y"))
    top = F.greatest("x", "y")
    return s.agg(F.avg(F.when(top > 0, (F.col("y") - F.col("x")) / top).otherwise(0.0)).alias("silhouette"))


def separation(pairs: DataFrame) -> DataFrame:
    """Mean distances within and between clusters and their ratio (infinite if within is 0), of pairs (ca, cb, d) or of means (ca, cb, m, n)."""
    same = F.col("ca") == F.col("cb")
    d, n = (F.col("m") * F.col("n"), F.col("n")) if "m" in pairs.columns else (F.col("d"), F.when(F.col("d").isNotNull(), 1))
    mean = lambda w: F.try_divide(F.sum(F.when(w, d)), F.sum(F.when(w, n)))
    m = pairs.agg(mean(same).alias("intra"), mean(~same).alias("inter"))
    return m.select("intra", "inter", F.when(F.col("intra") == 0, F.lit(float("inf"))).otherwise(F.col("inter") / F.col("intra")).alias("ratio"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Of points (id, cluster, v): between over within sums of squares, each over its degrees of freedom."""
    x = points.select("id", "cluster", F.posexplode("v").alias("j", "x"))
    g = x.groupBy("j").agg(F.avg("x").alias("g"))
    c = x.groupBy("cluster", "j").agg(F.avg("x").alias("m"), F.count("*").alias("n"), (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.avg("x")).alias("w"))
    t = c.join(F.broadcast(g), "j").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("b"), F.sum("w").alias("w"), F.countDistinct("cluster").alias("k"))
    n = points.agg(F.count("*").alias("n"))
    return t.join(n).select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("ch"))
