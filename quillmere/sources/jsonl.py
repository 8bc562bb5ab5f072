"""A corpus as lines of JSON, gzip or plain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, schema: str = "text string", stride: int = 1) -> DataFrame:
    """``line_no`` (in its file, 0 first), ``file`` and the fields of every ``stride``-th line.

    A gzip file is read by one task from its beginning, so its lines have numbers; a plain file must not be split, and
    isn't: each is one record stream. Empty lines and lines that aren't JSON are left out after they are counted.
    """
    lines = spark.read.option("wholetext", False).option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    place = F.monotonically_increasing_id()
    rows = lines.withColumn("place", place)
    first = rows.groupBy("file").agg(F.min("place").alias("first"), F.max("start").alias("last_block"))
    rows = rows.join(F.broadcast(first), "file")  # a row a file
    whole = F.when(F.col("last_block") > 0, F.raise_error(F.lit("a plain file was split; compress it or raise spark.sql.files.maxPartitionBytes"))).otherwise(F.col("place") - F.col("first"))
    rows = rows.withColumn("line_no", whole.cast("long")).where(F.col("line_no") % stride == 0)
    return rows.withColumn("fields", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})).where("fields is not null and value <> '' and get_json_object(value, '$') is not null").select("line_no", "file", "fields.*")
