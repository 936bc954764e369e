"""Vectors: means, scaling, projection, k-means in its several forms, a classifier."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .baskets import dealt
from .clusters import should_split


def token_mean(tokens: DataFrame, vectors: DataFrame, places: int = 20) -> DataFrame:
    """id, v: the sum of the tokens' vectors over ``places``, whatever the number of tokens; unknown tokens are zeros.

    ``tokens`` (id, tokens), ``vectors`` (token, v)."""
    x = dealt(tokens.select("id", F.explode("tokens").alias("token")).join(vectors, "token").select("id", "v"), 4 * tokens.count(), "id")  # wide rows
    plus = lambda s, v: F.zip_with(s, v, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))
    s = x.groupBy("id").agg(F.collect_list("v").alias("l"))  # as long as a text
    v = s.select("id", F.transform(F.aggregate(F.slice("l", 2, F.size("l")), F.element_at("l", 1), plus), lambda t: t / places).alias("v"))
    return tokens.select("id").join(v, "id", "left")


def standardised(points: DataFrame) -> DataFrame:
    """id, j, z: each dimension less its mean over its population deviation; 0 where that is 0."""
    x = points.select("id", F.posexplode("v").alias("j", "x"))
    s = x.groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return x.join(F.broadcast(s), "j").select("id", F.col("j").cast("long").alias("j"), F.when(F.col("sd") > 0, (F.col("x") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("z"))


def variance_sum(points: DataFrame, keys: list[str]) -> DataFrame:
    """The population variances of all dimensions, summed, for each key."""
    x = points.select(*keys, F.posexplode("v").alias("j", "x"))
    return x.groupBy(*keys, "j").agg(F.var_pop("x").alias("var")).groupBy(*keys).agg(F.sum("var").alias("variance"))


def centroids(points: DataFrame) -> DataFrame:
    """cluster, j, m."""
    return points.select("cluster", F.posexplode("v").alias("j", "x")).groupBy("cluster", "j").agg(F.avg("x").alias("m"))


def centroid_pairs(points: DataFrame, share: float = 0.1) -> DataFrame:
    """a, b, d: pairs of clusters whose centroids are nearer than that quantile of the square matrix of distances, diagonal included."""
    c = centroids(points)
    d = c.alias("x").join(c.alias("y"), "j").groupBy(F.col("x.cluster").alias("a"), F.col("y.cluster").alias("b")).agg(F.sqrt(F.sum((F.col("x.m") - F.col("y.m")) ** 2)).alias("d"))
    return d.join(F.broadcast(d.agg(F.percentile("d", share).alias("q")))).where("a < b AND d <= q").select("a", "b", "d")


def pca(points: DataFrame, k: int) -> DataFrame:
    """id, v: projections of the centred vectors on the k principal directions."""
    x = points.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="p").fit(x)
    mean = points.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).orderBy("j").collect()  # a row a dimension
    shift = model.pc.toArray().T @ [r.m for r in mean]
    return model.transform(x).select("id", F.zip_with(vector_to_array("p"), F.array(*[F.lit(float(s)) for s in shift]), lambda a, b: a - b).alias("v"))


def concatenated(a: DataFrame, b: DataFrame, scale: float = 4.0, drop: int = 0) -> DataFrame:
    """id, v: a's vector, then b's scaled; ``drop`` leaves out that many leading places."""
    both = a.select("id", F.col("v").alias("va")).join(b.select("id", F.col("v").alias("vb")), "id")
    v = F.concat("va", F.transform("vb", lambda x: x * scale))
    return both.select("id", F.slice(v, drop + 1, F.size(v)).alias("v"))


def kmeans(points: DataFrame, k: int, seed: int = 42, rounds: int = 100) -> DataFrame:
    """id, v, cluster (from 0)."""
    x = points.withColumn("_x_", array_to_vector(F.col("v").cast("array<double>")))
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_x_", predictionCol="cluster").fit(x).transform(x).drop("_x_")


def _silhouette(clustered: DataFrame) -> float:
    x = clustered.withColumn("_x_", array_to_vector(F.col("v").cast("array<double>"))).withColumn("_p_", F.col("cluster").cast("double"))
    return ClusteringEvaluator(featuresCol="_x_", predictionCol="_p_", distanceMeasure="squaredEuclidean").evaluate(x)


def best_split(points: DataFrame, ks=(2, 3, 4), seed: int = 42) -> tuple[DataFrame, float] | None:
    """The k-means division of the best silhouette; None if none has two clusters."""
    best = None
    for k in ks:
        c = kmeans(points, k, seed)
        if c.select("cluster").distinct().count() < 2:
            continue
        s = _silhouette(c)
        if best is None or s > best[1]:
            best = (c, s)
    return best


def recursive_kmeans(points: DataFrame, start: int, least: int, depth: int = 3, base: float = 0.1, hetero: float = 0.3, seed: int = 42) -> DataFrame:
    """id, label, path: clusters divided again and again while it pays, named by their way from the root.  ``points`` (id, label, v).

    All clusters of one depth are measured by one aggregation; a division is a k-means job on its rows."""
    now = written(kmeans(points, start, seed).withColumn("path", F.concat(F.lit("cluster_"), F.col("cluster"))).select("id", "label", "v", "path"))
    for _ in range(depth):
        c = now.groupBy("path", "label").agg(F.count("*").alias("c")).groupBy("path").agg(F.sum("c").alias("size"), (1 - F.max("c") / F.sum("c")).alias("impurity"))
        parts = []
        for r in c.where(F.col("size") >= 2 * least).orderBy("path").collect():  # a row a cluster
            own = now.where(F.col("path") == r.path)
            found = best_split(own, seed=seed)
            if found and should_split(r["size"], found[1], r.impurity, least, base, hetero):
                parts.append(found[0].select("id", F.concat("path", F.lit("_"), F.col("cluster")).alias("to")))
        if not parts:
            break
        to = parts[0]
        for p in parts[1:]:
            to = to.unionByName(p)
        now = written(now.join(to, "id", "left").select("id", "label", "v", F.coalesce("to", "path").alias("path")))
    return now.select("id", "label", "path")


def bisecting(points: DataFrame, threshold: float, most: int = 64, seed: int = 42) -> DataFrame:
    """id, cluster: halves by 2-means every cluster whose summed variance passes the threshold, one level at a time."""
    now = written(points.select("id", "v", F.lit("0").alias("path")))
    done: set[str] = set()
    while True:
        wide = [r.path for r in variance_sum(now, ["path"]).where(F.col("variance") > threshold).orderBy("path").collect() if r.path not in done]
        if not wide or now.select("path").distinct().count() >= most:
            break
        to = None
        for p in wide:
            c = kmeans(now.where(F.col("path") == p).drop("path"), 2, seed)
            if c.select("cluster").distinct().count() < 2:
                done.add(p)
                continue
            c = c.select("id", F.concat(F.lit(p), F.col("cluster")).alias("to"))
            to = c if to is None else to.unionByName(c)
        if to is None:
            break
        now = written(now.join(to, "id", "left").select("id", "v", F.coalesce("to", "path").alias("path")))
    ids = now.select("path").distinct().orderBy("path").collect()  # at most ``most``
    names = F.create_map(*[F.lit(x) for i, r in enumerate(ids) for x in (r.path, i)])
    return now.select("id", names[F.col("path")].alias("cluster"))


def mlp(points: DataFrame, hidden: int = 128, rounds: int = 10, seed: int = 42) -> DataFrame:
    """id, label, predicted, held_out: one hidden layer; a quarter of the rows (by hash) is held out.  ``points`` (id, label, v)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    x = points.withColumn("_x_", array_to_vector(F.col("v").cast("array<double>"))).withColumn("held_out", F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
    index = StringIndexer(inputCol="label", outputCol="_y_", stringOrderType="alphabetAsc", handleInvalid="skip").fit(x)
    x = written(index.transform(x))
    width = len(x.select("v").first()[0])
    model = MultilayerPerceptronClassifier(layers=[width, hidden, len(index.labels)], featuresCol="_x_", labelCol="_y_", predictionCol="_p_", maxIter=rounds, seed=seed).fit(x.where(~F.col("held_out")))
    names = F.array(*[F.lit(n) for n in index.labels])
    return model.transform(x).select("id", "label", F.element_at(names, F.col("_p_").cast("int") + 1).alias("predicted"), "held_out")
