"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableprobe.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """`node` and `root` for every end of the edges (`u`, `v`); the root is the smallest node reachable.

    Each round lets every node point its larger, then its smaller neighbours at the smallest one it
    knows; the rounds needed grow with the logarithm of the longest path. A node's neighbours
    are never gathered, only their minimum, which is pre-aggregated.
    """

    def state(df):
        return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()

    def pointing_down(df):
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = saved(pointing_down(edges), "edges")
    before = state(now)
    while before.n:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(pointing_down(large), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = saved(pointing_down(small), "edges")
        after = state(now)
        if (after.n, after.x) == (before.n, before.x):
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
