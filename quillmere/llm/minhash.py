"""Near-duplicate documents: banded MinHash candidates, verified by odd sketches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, id_text, mix64, split_chunks, written
from .components import components


@dataclass(frozen=True)
class Settings:
    """Shingles of ``shingle`` words; ``bands`` bands of ``rows`` samples; ``bits`` parity bits; least estimated Jaccard ``threshold``.

    A bucket of more than ``bucket`` sketches is compared in parts, each part with each.
    """

    shingle: int = 3
    bands: int = 40
    rows: int = 5
    bits: int = 1024
    threshold: float = 0.55
    bucket: int = 20_000
    seed: int = 7

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of each text and the texts' bounds."""
    codes, bounds, pieces = split_chunks(texts)
    words = pc.utf8_lower(pc.utf8_trim_whitespace(pieces))
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    keep = real[codes]
    if not keep.all():
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return hashes[codes], bounds


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of each text and their bounds; a text of fewer words has one, of all of them."""
    n = len(words)
    counts = np.diff(bounds)
    end = np.repeat(bounds[1:], counts)
    at = np.arange(n)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        later = np.full(n, 0x9E3779B9, np.uint64)
        later[: n - k] = words[k:]
        mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < end, later, np.uint64(k + 1)))
    keep = (at + size <= end) | (at == np.repeat(bounds[:-1], counts))
    return (mixed[keep] >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(keep)])[bounds]


def minima(hashes: np.ndarray, bounds: np.ndarray, s: Settings) -> np.ndarray:
    """MinHash samples, a row for each text with shingles."""
    draw = np.random.default_rng(s.seed)
    factor = draw.integers(0, 1 << 32, s.samples, dtype=np.uint32) | np.uint32(1)
    flip = draw.integers(0, 1 << 32, s.samples, dtype=np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((s.samples, len(starts)), np.uint32)
    first, cuts = 0, np.append(starts, len(hashes))
    while first < len(starts):  # a few cache-sized runs of whole texts at a time
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + 100_000, side="right")) - 1)
        part, at = hashes[cuts[first] : cuts[last]], starts[first:last] - cuts[first]
        for k in range(s.samples):
            x = (part ^ flip[k]) * factor[k]
            out[k, first:last] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), at)
        first = last
    return out.T


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Each row's samples, with their places, folded into ``bits`` parity bits."""
    n, k = samples.shape
    spot = mix64((np.arange(k, dtype=np.uint64) << np.uint64(32)) | samples) % np.uint64(bits)
    odd = np.bincount((np.arange(n)[:, None] * bits + spot.astype(np.int64)).ravel(), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1)


def estimate(distance: np.ndarray, s: Settings) -> np.ndarray:
    """Jaccard from the number of differing parity bits: 2k(1 - J) samples differ, each thrown at one of n bits."""
    share = np.minimum(2.0 * distance / s.bits, 1 - 1e-9)
    return np.clip(1 + s.bits / (4.0 * s.samples) * np.log1p(-share), 0, 1)


def largest_distance(s: Settings) -> int:
    """The most differing bits at which the estimate reaches the threshold."""
    return int(np.flatnonzero(estimate(np.arange(s.bits // 2), s) >= s.threshold).max())


def link(ids: np.ndarray, sketches: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the pairs of ``sketches`` (rows of uint64) at most ``limit`` bits apart.

    Every member is compared with all that no tree has yet, so the components are those of all pairs; a group of m
    copies takes about m comparisons, not m * m.
    """
    left, edges = np.arange(len(ids)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = np.bitwise_count(sketches[left] ^ sketches[k]).sum(axis=1, dtype=np.int64) <= limit
            if near.any():
                met = left[near]
                edges += [(int(ids[k]), int(m)) for m in ids[met]]
                queue += met.tolist()
                left = left[~near]
    return edges


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """``id``, ``text_hash``, ``sketch`` and ``bands`` (hashes) of every text with a word; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = shingles(*word_hashes(batch.column("text")), s.shingle)
            have = np.diff(bounds) > 0
            if not have.any():
                continue
            m = minima(hashes, bounds, s)
            key = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), (len(m), s.bands))
            for r in range(s.rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, r :: s.rows])
            flat = pa.array(key.astype(np.int64).ravel())
            bits = odd_sketches(m, s.bits)
            size = bits.shape[1]
            sketch = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * size), pa.py_buffer(bits.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * s.bands), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(have)) for c in ("id", "text_hash")), sketch, lists], names=["id", "text_hash", "sketch", "bands"])

    return docs.withColumn("text_hash", text_hash("text")).mapInArrow(run, "id long, text_hash long, sketch binary, bands array<long>")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _linked(s: Settings):
    limit = largest_distance(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one bucket, over the batches of a partition that is sorted by bucket."""
        rest: pa.Table | None = None

        def edges(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            bucket = table.column("bucket").to_numpy()
            ids = table.column("rep").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(ids)]])
            two = cuts[:-1][np.diff(cuts) == 2]
            near = two[np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(axis=1, dtype=np.int64) <= limit]
            found = [(int(a), int(b)) for a, b in zip(ids[near], ids[near + 1])]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 2:
                    found += link(ids[a:b], sketches[a:b], limit)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            bucket = table.column("bucket").to_numpy()
            if not len(bucket):
                continue
            whole = int(np.searchsorted(bucket, bucket[-1], side="left"))
            if whole:
                yield edges(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield edges(rest)

    return run


def _edges(spark: SparkSession, reps: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Links between the sketches of ``reps`` (rep, sketch, bands) that share a band and are near, and the written table that they are made of.

    Nothing holds a whole bucket: buckets with the same members, by count, extremes and two sums of hashes, are one, and large
    ones are cut into parts by hash, of which every two meet in a task.
    """
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    keys = written(spark, keys.join(shared, "key", "left_semi"), "buckets")
    alike = ["n", "low", "high", "x", "y"]
    buckets = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.shiftright(F.xxhash64("rep", F.lit(1)), 24)).alias("y")
    )
    buckets = buckets.groupBy(*alike).agg(F.min("key").alias("key")).select("key", F.ceil(2 * F.col("n") / s.bucket).alias("parts"))
    rows = keys.join(buckets, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    small = rows.where("parts <= 2").select(F.col("key").alias("bucket"), "rep")
    large = rows.where("parts > 2").select("key", "rep", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    large = large.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "rep")
    rows = small.union(large).join(reps.select("rep", "sketch"), "rep").repartition("bucket").sortWithinPartitions("bucket", "rep")
    return rows.select("bucket", "rep", "sketch").mapInArrow(_linked(s), "a long, b long"), keys


def grouped(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_hash``, ``n`` (rows that have both), ``group_id`` and ``kept``, for all rows of groups of more than one row.

    One (``id``, ``text_hash``) of a group is ``kept``: the least id, null last, then the least hash; ``group_id`` is its id.
    """
    s = settings
    sigs = written(spark, signatures(id_text(docs, id_col, text_col), s), "signatures")
    reps = sigs.groupBy("sketch").agg(F.min("bands").alias("bands"))  # equal sketches are estimated at 1
    reps = written(spark, reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")  # numbered once, in the table
    edges, keys = _edges(spark, reps, s)
    groups = components(spark, edges, "near-duplicates")
    rows = sigs.select("id", "text_hash", "sketch").join(reps.select("sketch", "rep"), "sketch").groupBy("id", "text_hash", "rep").agg(F.count("*").alias("n"))
    rows = rows.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("id", "text_hash", "n", F.coalesce("root", "rep").alias("root"))
    rows = written(spark, rows, "grouped")
    discard(sigs, reps, keys, groups)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    several = rows.groupBy("root").agg(F.sum("n").alias("size"), first).where("size > 1")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.join(several, "root").select("id", "text_hash", "n", F.col("first.id").alias("group_id"), kept.alias("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``group_id``, the least id of its group, and ``n_rows``, for the documents that duplicate an earlier one.

    Two documents are near duplicates when some band of their MinHash samples agrees and their odd sketches estimate
    a Jaccard of at least ``threshold`` over word shingles (lower case; white space doesn't count); groups are the
    connected components, so copies of copies meet. Documents with equal sketches are estimated at 1 and are joined
    before the bands, so thousands of equal copies cost one row each. No bucket is capped.

    One row for each id and text of a group but the one that is kept: the least id, null ids last, then the text of least
    hash; ``n_rows`` rows have that id and text. Where the one that is kept occurs n times, it has a row too, of n - 1.
    So different texts under one id, and texts under null ids, are documents of their own. A null or blank text has no
    shingles and is in no group; a text shorter than a shingle has one, of all its words. An empty table gives no row.
    """
    rows = grouped(spark, docs, settings, id_col, text_col).withColumn("n_rows", F.col("n") - F.col("kept").cast("long"))
    return rows.where("n_rows > 0").select(F.col("id").alias("doc_id"), "group_id", "n_rows")


def keep_one(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", few: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without near duplicates: one row of each group stays, by the rule of ``near_duplicates``.

    Rows outside groups stay, so null and blank texts do. Of several rows with the id and text that is kept, the one of least
    values in the other columns stays. Up to ``few`` decisions are sent to every executor, more are joined by a shuffle;
    texts are shuffled only then, and those of repeated rows.
    """
    taken = {c.lower() for c in docs.columns}
    own, other, best = (next(n for n in (f"{x}_{k}" for k in range(len(taken) + 1)) if n not in taken) for x in ("own", "other", "best"))
    rows = grouped(spark, docs, settings, id_col, text_col).where("not kept or n > 1")
    rows = written(spark, rows.select(F.col("id").alias(own), F.col("text_hash").alias(other), "kept"), "decisions")
    count = dict(rows.groupBy("kept").count().collect())
    doc, text = F.col(f"`{id_col}`").cast("long"), text_hash(text_col)

    def meet(part: DataFrame, how: str) -> DataFrame:
        part = part.select(own, other)
        return docs.join(F.broadcast(part) if sum(count.values()) <= few else part, doc.eqNullSafe(F.col(own)) & (text == F.col(other)), how)

    rest = meet(rows, "left_anti")
    if not count.get(True):
        return rest
    whole = [F.col(f"`{c}`") for c in docs.columns]
    again = meet(rows.where("kept"), "left_semi").groupBy(doc.alias(own), text.alias(other)).agg(F.min_by(F.struct(*whole), F.to_json(F.struct(*whole))).alias(best))
    return rest.unionByName(again.select(f"{best}.*"))
