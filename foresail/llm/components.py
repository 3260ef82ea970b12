"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, parted, written


def _least(pairs: DataFrame) -> DataFrame:
    """Each u with the least of itself and its v: summed up before the shuffle, dealt anew, so that a join with it can split a hot u."""
    return parted(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")


def _settled(now: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no vertex with two v, and none that is a u and a v."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("outs"), F.max(1 - F.col("out")).alias("into"))
    return seen.where("outs > 1 OR (outs > 0 AND into > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, root) for each vertex of edges (a, b), root being the least vertex reachable.

    Each round replaces edges by stars around lesser vertices; the number of rounds grows
    with the logarithm of the longest path. Every round is written to the shared folder,
    so lineage stays short and no vertex, edge or component comes to the driver.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large, "large-star")
        discard(now)
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "small-star")
        discard(large)
        if _settled(now):
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select("v", F.col("v").alias("root")).distinct())
