"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node reachable.  Nodes of any ordered type; loops and repeats do no harm.

    Each round is two aggregations and two joins over the links alone, written to the shared folder; the links of a node are reduced
    to their minimum before they are joined, so that a node with very many links costs no more than they do elsewhere.
    """
    edges = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # large: v > m for each neighbour; a node's own link to m follows from its neighbours' small step.
        own = least.where("u <> m").select("u", F.col("m").alias("v"))
        large = large.unionByName(own).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        old, edges = edges, common.written(small, "links")
        common.done(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)
