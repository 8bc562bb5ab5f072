"""Packing into windows by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytebpe
from ._common import id_text, written

SCHEMA = "doc_id long, chunk long, length int, window_id long, start int"
_RANK_BITS = 46


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of at most ``counts`` of ``lengths`` (descending) whose sum is the largest that is at most ``room``.

    Bit s of the integer says whether s can be reached; each length's copies are added in powers of two. The steps are
    kept to read off, backwards, how many of each length the best sum takes.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, power = min(counts[length], room // length if length <= room else 0), 1
        if not left:
            continue
        before = reach
        while left:
            take = min(power, left)
            reach |= reach << (take * length) & mask
            left -= take
            power *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> best & 1:
            best -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Contents of the windows and how many windows have each.

    Every window takes the longest length left and then the fullest completion. While its lengths last, the same
    contents stay the best completion, so they are repeated at once: the steps depend on the number of distinct
    lengths, not on the number of pieces.
    """
    left = {k: n for k, n in counts.items() if n}
    order, found = sorted(left, reverse=True), []
    while order:
        longest = order[0]
        left[longest] -= 1
        contents = fill(order, left, capacity - longest)
        left[longest] += 1
        contents[longest] = contents.get(longest, 0) + 1
        times = min(left[k] // n for k, n in contents.items())
        found.append((contents, times))
        for k, n in contents.items():
            left[k] -= n * times
        order = [k for k in order if left[k]]
    return found


def token_lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``n``, the tokens of each whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bytebpe.load(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(encoder.count(b.column("text")).astype(np.int64))], names=["id", "n"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "id long, n long")


def pack_lengths(spark: SparkSession, lengths: DataFrame, capacity: int = 2048, share: int = 250_000) -> DataFrame:
    """Place pieces of documents (``id``, ``n`` tokens) in windows of ``capacity``.

    A document longer than the capacity is cut into full windows and a remainder. Gives one row a piece: document,
    number of the piece in it, length, window and the piece's start in the window. Pieces of one length are spread over
    parts of about ``share`` pieces, which are ranked side by side (by id, then piece), so that a length which most pieces
    have needs no task of its own. What reaches the driver is the number of pieces of each length, and of each part. Documents of no tokens
    (null or empty texts) take no place and have no row; null ids and repeated rows are pieces like any other. An empty
    table gives no row.
    """
    if not 1 <= capacity < 1 << 16:
        raise ValueError("capacity must be from 1 to 65535")
    pieces = lengths.where("n > 0").select(
        "id", F.posexplode(F.expr(f"transform(sequence(0L, (n - 1) div {capacity}), i -> cast(least({capacity}L, n - i * {capacity}) as int))")).alias("chunk", "length")
    )
    pieces = written(spark, pieces.select("id", F.col("chunk").cast("long").alias("chunk"), "length", F.when(F.col("id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("id", "chunk")).alias("h")), "pieces")
    totals = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        totals[length] = n
    parts = np.maximum(1, -(-totals // share))
    first_part = np.cumsum(parts) - parts
    spread = F.broadcast(spark.createDataFrame([(k, int(parts[k]), int(first_part[k])) for k in np.flatnonzero(totals).tolist()], "length int, parts long, first_part long"))  # a row a length
    pieces = pieces.join(spread, "length").select("id", "chunk", "length", (F.col("first_part") + F.pmod("h", "parts")).alias("part"))
    sizes = np.zeros(parts.sum(), np.int64)
    for part, n in pieces.groupBy("part").count().collect():
        sizes[part] = n
    before = np.cumsum(sizes) - sizes
    base = before - np.repeat(before[first_part], parts)

    used, rows, first = np.zeros(capacity + 1, np.int64), [], 0
    for contents, times in plan({k: int(n) for k, n in enumerate(totals) if n}, capacity):
        start = 0
        for length in sorted(contents, reverse=True):
            n = contents[length]
            rows.append(((length << _RANK_BITS) + int(used[length]), int(used[length]), first, n, start))
            used[length] += n * times
            start += n * length
        first += times
    at = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = base[b.column("part").to_numpy()] + b.column("rank").to_numpy()
            k = np.searchsorted(at[:, 0], (length << _RANK_BITS) + rank, side="right") - 1
            nth = rank - at[k, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("chunk"), b.column("length"), pa.array(at[k, 2] + nth // at[k, 3]), pa.array((at[k, 4] + nth % at[k, 3] * length).astype(np.int32))],
                names=["doc_id", "chunk", "length", "window_id", "start"],
            )

    ranked = pieces.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("id", "chunk")).cast("long") - 1)
    return ranked.mapInArrow(place, SCHEMA)


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack_lengths`` over the token counts of whole texts; each text is encoded once."""
    return pack_lengths(spark, token_lengths(docs, vocabulary, id_col, text_col), capacity)
