"""Hierarchical clusters of samples, small clusters, samples with quotas, profiles, recursive k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("single", "complete", "average", "ward")


def linkage(n: int, pairs, method: str = "average", most: int = 5000) -> np.ndarray:
    """Merges (left, right, height, size) of n points from (a, b, d) with a < b, by nearest-neighbour chains over a distance matrix
    that the Lance-Williams formulas update.  For samples: memory grows with n squared, so more than ``most`` points are refused."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    if n > most:
        raise ValueError(f"{n} points; at most {most}")
    d = np.full((n, n), np.inf)
    for a, b, x in pairs:
        d[a, b] = d[b, a] = x
    return ordered(chained(d, np.ones(n), method), n)


def chained(d: np.ndarray, size: np.ndarray, method: str) -> list[tuple[float, int, int]]:
    """(height, x, y): merges in the order of nearest-neighbour chains over a matrix of distances, both of which change; y stands for both."""
    n = len(size)
    active, merges, chain = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(active)))
        while True:
            x = chain[-1]
            row = np.where(active, d[x], np.inf)
            row[x] = np.inf
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        chain.pop()
        chain.pop()
        x, y = sorted((x, y))  # the merged cluster takes the larger place, which settles ties
        h, nx, ny = d[x, y], size[x], size[y]
        if method == "single":
            new = np.minimum(d[x], d[y])
        elif method == "complete":
            new = np.maximum(d[x], d[y])
        elif method == "average":
            new = (nx * d[x] + ny * d[y]) / (nx + ny)
        else:
            t = nx + ny + size
            new = np.sqrt(np.maximum(0, ((nx + size) * d[x] ** 2 + (ny + size) * d[y] ** 2 - size * h**2) / t))
        merges.append((h, x, y))
        active[x] = False
        size[y] += nx
        d[y] = d[:, y] = new
        d[y, y] = np.inf
    return merges


def ordered(merges, n: int) -> np.ndarray:
    """The tree of merges (height, point, point), found out of order: by height."""
    root, made = list(range(n)), {i: i for i in range(n)}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out, count = [], {i: 1 for i in range(n)}
    for k, (h, x, y) in enumerate(sorted(merges, key=lambda m: m[0])):
        a, b = find(x), find(y)
        u, v = sorted((made[a], made[b]))
        root[a] = b
        count[b] += count[a]
        made[b] = n + k
        out.append((u, v, h, count[b]))
    return np.array(out).reshape(-1, 4)


def cut(tree: np.ndarray, n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """A cluster number from 1 for each point, in order of the clusters' first points."""
    if (clusters is None) == (height is None):
        raise ValueError("either a number of clusters or a height")
    merges = n - clusters if clusters is not None else int((tree[:, 2] <= height).sum())
    of = {i: [i] for i in range(n)}
    for k in range(max(0, min(merges, n - 1))):
        of[n + k] = of.pop(int(tree[k, 0])) + of.pop(int(tree[k, 1]))
    out = np.zeros(n, int)
    for c, members in enumerate(sorted(of.values(), key=min), 1):
        out[members] = c
    return out


def small_clusters(points: DataFrame, least: int, how: str, distance=None) -> DataFrame:
    """id, cluster with clusters below ``least`` points handled: 'remove' (-1), 'outlier_class' (one more than the largest),
    'merge_nearest' (to the large cluster nearest on average), 'reassign' (each point to the large cluster of its nearest point).

    ``points`` (id, cluster, and v for the last two); ties go to the smaller cluster.  Only points of small clusters are compared, with
    those of large ones, block against block."""
    n = points.groupBy("cluster").agg(F.count("*").alias("size"))
    p = points.join(n, "cluster")
    small = F.col("size") < least
    if how == "remove":
        return p.select("id", F.when(small, -1).otherwise(F.col("cluster")).alias("cluster"))
    if how == "outlier_class":
        top = n.agg((F.max("cluster") + 1).alias("top"))
        return p.join(F.broadcast(top)).select("id", F.when(small, F.col("top")).otherwise(F.col("cluster")).alias("cluster"))
    if how not in ("merge_nearest", "reassign"):
        raise ValueError(f"no such way: {how}")
    from .pairs import across

    few, many = (p.where(w).select("id", "cluster", "v") for w in (small, ~small))
    if how == "merge_nearest":
        d = across(few, many, distance, "mean")
        to = d.groupBy("ca", "cb").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m")).groupBy("ca").agg(F.min_by("cb", F.struct(F.round("m", 9), F.col("cb"))).alias("to"))
        return p.join(to.withColumnRenamed("ca", "cluster"), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
    d = across(few, many, distance, "least")
    to = d.groupBy("a").agg(F.min_by("cb", F.struct(F.round("m", 9), F.col("cb"))).alias("to"))
    return p.join(to.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))


def sizes_valid(points: DataFrame, least: int) -> DataFrame:
    return points.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("valid", F.col("size") >= least)


def quotas(labels: DataFrame, sample: int) -> DataFrame:
    """label, n, quota: max(1, floor(sample n / N)), with the difference to ``sample`` made up by one each in order of size."""
    known = labels.where("lower(label) <> 'unknown'").groupBy("label").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    q = known.join(F.broadcast(total)).withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(sample) * F.col("n") / F.col("total"))))
    # One row a label from here on.
    w = Window.orderBy(F.desc("n"), "label")
    gap = F.lit(sample) - F.sum("quota").over(Window.partitionBy())
    one = F.when((gap > 0) & (F.row_number().over(w) <= gap), 1).when((gap < 0) & (F.row_number().over(w) <= -gap) & (F.col("quota") > 1), -1).otherwise(0)
    return q.select("label", "n", (F.col("quota") + one).cast("long").alias("quota"))


def stratified(labels: DataFrame, sample: int, seed: int = 42) -> DataFrame:
    """basket_id, label: each label's quota of baskets, drawn without replacement by a seeded hash (md5, which other engines have)."""
    w = Window.partitionBy("label").orderBy(F.md5(F.concat_ws("-", F.col("basket_id").cast("string"), F.lit(str(seed)))), "basket_id")
    return labels.join(F.broadcast(quotas(labels, sample)), "label").withColumn("r", F.row_number().over(w)).where("r <= quota").select("basket_id", "label")


def profile(contained: DataFrame, clusters: DataFrame, least: float = 0.1, k: int = 5) -> DataFrame:
    """cluster, itemset, mean, rank: itemsets that more than ``least`` of a cluster's baskets hold, or its k commonest if none does."""
    n = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    m = contained.join(clusters, "basket_id").groupBy("cluster", "itemset").agg(F.count("*").alias("c")).join(n, "cluster").withColumn("mean", F.col("c") / F.col("size"))
    by = Window.partitionBy("cluster")
    m = m.withColumn("rank", F.row_number().over(by.orderBy(F.desc("c"), "itemset")).cast("long")).withColumn("some", F.max((F.col("mean") > least).cast("int")).over(by))
    return m.where(((F.col("some") == 1) & (F.col("mean") > least)) | ((F.col("some") == 0) & (F.col("rank") <= k))).select("cluster", "itemset", "mean", "rank")


def item_profile(items: DataFrame, clusters: DataFrame, k: int = 10) -> DataFrame:
    """cluster, item, count, share of its baskets, rank: each cluster's k commonest items."""
    n = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    c = items.select("basket_id", "item").distinct().join(clusters, "basket_id").groupBy("cluster", "item").agg(F.count("*").alias("count")).join(n, "cluster")
    w = Window.partitionBy("cluster").orderBy(F.desc("count"), "item")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("cluster", "item", "count", (F.col("count") / F.col("size")).alias("share"), "rank")


def cluster_sizes(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, baskets and their mean number of items."""
    s = items.groupBy("basket_id").agg(F.sum("n").alias("size"))
    return clusters.join(s, "basket_id", "left").groupBy("cluster").agg(F.count("*").alias("baskets"), F.avg(F.coalesce("size", F.lit(0))).alias("avg_items"))


def sample_head(items: DataFrame, clusters: DataFrame, rows: int = 5, width: int = 8) -> DataFrame:
    """cluster, basket_id, items: each cluster's first baskets with their first items, for display."""
    w = Window.partitionBy("cluster").orderBy("basket_id")
    first = clusters.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).drop("r")
    held = items.select("basket_id", "item").distinct().join(first, "basket_id").groupBy("cluster", "basket_id").agg(F.array_sort(F.collect_list("item")).alias("all"))  # as long as a basket
    return held.select("cluster", "basket_id", F.slice("all", 1, width).alias("items"), F.size("all").alias("n_items"))


def top_by_top(rows: DataFrame, one: str, many: int, two: str, most: int) -> DataFrame:
    """Rows of the ``many`` commonest values of one column and the ``most`` commonest of another; ties by value."""
    best = lambda c, n: rows.groupBy(c).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), c).limit(n).select(c)
    # At most ``many`` and ``most`` values.
    return rows.join(F.broadcast(best(one, many)), one, "left_semi").join(F.broadcast(best(two, most)), two, "left_semi")


def final_evaluation(rows: DataFrame) -> DataFrame:
    """One row of (cluster, label): ari, nmi, mean purity, clusters and rows."""
    from .evaluation import ari, nmi, per_cluster

    p = per_cluster(rows).agg(F.avg("purity").alias("mean_purity"), F.count("*").alias("clusters"), F.sum("size").alias("total"))
    return ari(rows).join(nmi(rows)).join(p)


def largest(rows: DataFrame, k: int = 10) -> DataFrame:
    """cluster, size, dominant, purity, rank of the k largest clusters."""
    from .evaluation import per_cluster

    w = Window.orderBy(F.desc("size"), "cluster")
    return per_cluster(rows).orderBy(F.desc("size"), "cluster").limit(k).select("cluster", "size", "dominant", "purity", F.row_number().over(w).cast("long").alias("rank"))


def differences(profiles: DataFrame, one: int, two: int, k: int = 5) -> DataFrame:
    """common, only_one, only_two among the k strongest itemsets of two clusters."""
    top = profiles.where((F.col("rank") <= k) & F.col("cluster").isin(one, two))
    s = top.agg(*[F.array_sort(F.collect_set(F.when(F.col("cluster") == c, F.col("itemset")))).alias(n) for c, n in ((one, "x"), (two, "y"))])
    return s.select(F.array_intersect("x", "y").alias("common"), F.array_except("x", "y").alias("only_one"), F.array_except("y", "x").alias("only_two"))


def should_split(size: int, silhouette: float, impurity: float, least: int, base: float = 0.1, hetero: float = 0.3, have: int | None = None, target: int | None = None) -> bool:
    """Whether a cluster is divided; with a target number of clusters the rule is relaxed below it and strict from there on."""
    if size < 2 * least:
        return False
    if target is None:
        return silhouette > base and impurity > hetero
    if have < target:
        return silhouette > max(0.05, 0.7 * base) or impurity > min(0.9, 1.3 * hetero)
    return silhouette > 1.5 * base and impurity > 0.7 * hetero
