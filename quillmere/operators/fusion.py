"""Reciprocal Rank Fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring


def ranked(rows: DataFrame, ranking_id: int, *order) -> DataFrame:
    """``ranking_id``, ``row_id``, ``rank`` (1 first). One ranking has one order, so it is numbered in one place: rank a top-k."""
    return rows.select(F.lit(ranking_id).alias("ranking_id"), "row_id", F.row_number().over(W.orderBy(*order)).alias("rank"))


def fuse(rankings: DataFrame, k: int | DataFrame = scoring.RRF_K) -> DataFrame:
    """``row_id``, ``score`` and ``ranks`` (by ranking id, of those that have the row), from any number of rankings.

    A row that a ranking holds twice counts where it is first. ``k`` is one number, or a table of ``ranking_id``, ``k``
    that must have every ranking.
    """
    first = rankings.groupBy("ranking_id", "row_id").agg(F.min("rank").alias("rank"))
    if isinstance(k, DataFrame):
        first = first.join(F.broadcast(k.select("ranking_id", F.col("k").alias("k_"))), "ranking_id", "left")
        share = F.when(F.col("k_").isNull(), F.raise_error(F.lit("a ranking has no k"))).otherwise(scoring.rrf(F.col("rank"), F.col("k_")))
    else:
        share = scoring.rrf(F.col("rank"), k)
    return first.groupBy("row_id").agg(F.sum(share).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("ranking_id", "rank")))).alias("ranks"))


def best(fused: DataFrame, n: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "row_id").limit(n)
