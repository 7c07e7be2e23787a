"""Property graphs as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_occurrence(tags: DataFrame, item: str, tag: str) -> DataFrame:
    """(t1, t2, weight, similarity) with t1 < t2: items that have both. An item's
    tags are gathered first, so pairs arise within a row. (G01, G02, F57)"""
    sets = tags.groupBy(item).agg(F.array_sort(F.collect_set(tag)).alias("tags"))
    pairs = F.flatten(F.transform("tags", lambda a, i: F.transform(F.filter("tags", lambda b: b > a), lambda b: F.struct(a.alias("t1"), b.alias("t2")))))
    edges = sets.select(F.explode(pairs).alias("e")).groupBy("e.t1", "e.t2").agg(F.count(F.lit(1)).alias("weight"))
    return edges.withColumn("similarity", F.when(F.col("weight") == 1, 0.5).otherwise(0.5 + 0.1 * F.col("weight")))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), *[c for c in edges.columns if c not in ("t1", "t2")])
    return edges.unionByName(back)


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop): the nodes within so many steps of start (node), at their least."""
    around = both_ways(edges).select("t1", "t2")
    seen = start.select("node", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("t1"))
        reached = around.join(front, "t1").select(F.col("t2").alias("node"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(reached).groupBy("node").agg(F.min("hop").alias("hop"))
    return seen
