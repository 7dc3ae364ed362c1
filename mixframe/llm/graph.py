"""Connected components as a loop of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node reachable, for every node that has an edge.

    Large-star / small-star: every round hooks the neighbours of a node to the smallest of them, which
    halves the depth; a node's neighbours are only ever reduced to a minimum, so that a hub with many
    neighbours is combined on the map side and no group is collected.
    """
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct()
    now = stage(now, "links")
    while True:
        both = now.unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("least")).select(F.col("hi").alias("node"), F.least("hi", "least").alias("least"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = (both.filter("lo > hi").withColumnsRenamed({"hi": "node", "lo": "far"}).join(least, "node")
                 .select(F.col("far").alias("hi"), F.col("least").alias("lo")).distinct())
        # small star: smaller neighbours and the node itself go to the smallest of them
        small_least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (large.join(small_least, "hi").select(F.col("lo").alias("node"), "least").unionAll(
                     small_least.select(F.col("hi").alias("node"), "least")).filter("node > least").distinct()
                 .select(F.col("node").alias("hi"), F.col("least").alias("lo")))
        following = stage(small, "links")
        if _same(now, following):
            return following.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component").unionAll(
                following.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        now = following


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two sets of links are equal, by two order-free sums."""
    def figure(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")),
                            F.bit_xor(F.xxhash64("lo", "hi"))).first())
    return figure(x) == figure(y)
