"""Connected components by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, written


def components(spark: SparkSession, edges: DataFrame, tag: str = "components") -> DataFrame:
    """``id`` and ``root``, the least id of its component, for every id of an edge (``a``, ``b``) but the roots.

    Large stars and small stars alternate until nothing changes: O(log^2 n) rounds whatever the shape, no list of a
    component in one place, and each round ends in a table of the shared folder, which replaces the one before.
    """
    edges = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag)
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, written(spark, small.where("u <> v").distinct(), tag)
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            out.stored_at = edges.stored_at
            return out
        seen = now
