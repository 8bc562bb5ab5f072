"""Filter fields as bitmaps, and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, value: str, id_col: str) -> DataFrame:
    """``value``, ``bucket``, ``bits``: a bitmap of row ids for every value and run of 32,768 ids."""
    return df.where(f"{value} is not null").groupBy(F.col(value).alias("value"), F.bitmap_bucket_number(id_col).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("bits"))


def cardinality(maps: DataFrame) -> DataFrame:
    """Rows of each value."""
    return maps.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def members(maps: DataFrame) -> DataFrame:
    """``value``, ``row_id``: a bitmap unfolded again."""
    byte = F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("byte")
    rows = maps.where(F.octet_length("bits") > 0).select("value", "bucket", "bits", byte)
    rows = rows.select("value", "bucket", "byte", F.conv(F.hex(F.substring("bits", F.col("byte") + 1, 1)), 16, 10).cast("int").alias("x")).where("x > 0")
    rows = rows.select("value", "bucket", "byte", "x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("(shiftright(x, bit) & 1) = 1")
    place = F.col("byte") * 8 + F.col("bit")
    row_id = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place)
    return rows.select("value", row_id.cast("long").alias("row_id"))


def combined(maps: DataFrame, values: list, how: str) -> DataFrame:
    """One bitmap a bucket: the union (``or``) or intersection (``and``) of the values' bitmaps."""
    rows = maps.where(F.col("value").isin(*values))
    if how == "or":
        return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    if how == "and":
        return rows.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count_distinct("value").alias("k")).where(F.col("k") == len(set(values))).select("bucket", "bits")
    raise ValueError("how is 'and' or 'or'")


def without_deleted(rows: DataFrame, deletes: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows that no tombstone names."""
    return rows.join(deletes.select(key), key, "left_anti")


def survivors(rows: DataFrame, deletes: DataFrame, key: str = "row_id", segment: str = "segment_id") -> DataFrame:
    """Rows left after a merge, renumbered densely inside each segment: the segment's offset is how many survive before it."""
    from pyspark.sql import Window as W

    kept = without_deleted(rows, deletes, key)
    sizes = kept.groupBy(segment).agg(F.count("*").alias("n"))
    before = sizes.select(segment, F.coalesce(F.sum("n").over(W.orderBy(segment).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy(segment).orderBy(key)) - 1
    return kept.withColumn("within", within).join(before, segment).withColumn("new_id", F.col("before") + F.col("within")).drop("within", "before")
