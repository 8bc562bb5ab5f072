"""Which snapshots stay, which objects nothing refers to, which codebooks go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THREE_DAYS = 3 * 24 * 3600 * 1000


def retained(snapshots: DataFrame, now_millis: int, keep_last: int | None = None, max_age_millis: int | None = None) -> DataFrame:
    """The current snapshot, the ``keep_last`` newest versions, and all of an age up to ``max_age_millis``, bounds included.

    Versions are one row a commit, which is small beside any table. A policy needs one of the two.
    """
    if keep_last is None and max_age_millis is None:
        raise ValueError("a retention policy needs a number or an age")
    place = F.dense_rank().over(W.orderBy(F.desc("version")))
    keep = F.col("place") == 1
    if keep_last is not None:
        keep = keep | (F.col("place") <= keep_last)
    if max_age_millis is not None:
        keep = keep | (F.lit(now_millis) - F.col("committed_at_millis") <= max_age_millis)
    return snapshots.withColumn("place", place).where(keep).drop("place")


def classified(objects: DataFrame, referenced: DataFrame, now_millis: int, window_millis: int = THREE_DAYS) -> DataFrame:
    """``key``, ``fate``: referenced, within_window (an age up to the window) or orphan."""
    rows = objects.join(referenced.select("key").distinct().withColumn("used", F.lit(True)), "key", "left")
    fate = F.when(F.col("used"), "referenced").when(F.lit(now_millis) - F.col("last_modified_millis") <= window_millis, "within_window").otherwise("orphan")
    return rows.select("key", fate.alias("fate"))


CODEBOOK = ("dims", "metric", "bit_width", "rotator", "payload_hash")


def mismatch(a: str, b: str, fields: tuple[str, ...] = CODEBOOK) -> Column:
    """The first field in which two codebook structs differ, or null if they can be merged."""
    return F.coalesce(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in fields])
