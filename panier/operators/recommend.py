"""Baskets like a given one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recommend(query: list[str], items: DataFrame, contained: DataFrame, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, basket_id, overlap: in the cluster whose baskets' itemsets are nearest the query's on average (Jaccard), all baskets
    that share most items with it.  ``query``: a few items; ``contained`` (basket_id, itemset), ``sets`` (itemset, items)."""
    q = F.array(*[F.lit(x) for x in query])
    own = sets.where(F.size(F.array_except("items", q)) == 0).select("itemset")
    n = own.agg(F.count("*").alias("nq"))
    size = contained.groupBy("basket_id").agg(F.count("*").alias("nb"))
    inter = contained.join(own, "itemset").groupBy("basket_id").agg(F.count("*").alias("inter"))
    rows = clusters.join(size, "basket_id", "left").join(inter, "basket_id", "left").join(F.broadcast(n)).fillna(0, ["nb", "inter"])
    union = F.col("nb") + F.col("nq") - F.col("inter")
    mean = rows.groupBy("cluster").agg(F.avg(F.when(union > 0, F.col("inter") / union).otherwise(0.0)).alias("m"))
    best = mean.agg(F.min_by("cluster", F.struct(-F.round("m", 9), F.col("cluster"))).alias("cluster"))
    shared = items.where(F.col("item").isin(query)).groupBy("basket_id").agg(F.countDistinct("item").alias("overlap"))
    inside = clusters.join(F.broadcast(best), "cluster").join(shared, "basket_id", "left").fillna(0, ["overlap"])
    most = inside.agg(F.max("overlap").alias("most"))
    return inside.join(F.broadcast(most)).where("overlap = most").select("cluster", "basket_id", "overlap")


