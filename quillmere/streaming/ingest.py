"""Continuous ingest: every micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.table import Table


def ingest(rows: DataFrame, table: Table, checkpoint: str, source: str = "stream", **trigger) -> StreamingQuery:
    """Append a stream to a table. The snapshot holds the number of the last batch of ``source``, so one that is run again after a crash isn't added twice."""

    def add(batch: DataFrame, number: int) -> None:
        if table.snapshot().batches.get(source, -1) < number and not batch.isEmpty():
            table.append(batch, (source, number))

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and window, with rows later than ``late`` left out."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
