"""Katz backoff language model over token ids, in tables.

An n-gram is (``ctx``, ``tok``): ``ctx`` packs the ids before the token, 16 bits each with the nearest lowest, so the
context of a shorter n-gram is a mask of it. Every text is padded with ``order - 1`` begin marks and ends with an end
mark, which is predicted like a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe
from ._common import discard, id_text, mix64, new_folder, written

SCHEMA = "doc_id long, n_tokens long, log_prob double, perplexity double"
_RUN, _BLOCK, _PART = 1_000_000, 8_000_000, 4_000_000  # tokens


@dataclass(frozen=True)
class Settings:
    """``order`` from 1 to 4; counts up to ``discounted`` are discounted; n-grams of order 3 and 4 seen less than ``min_count`` times give their mass to the backoff."""

    order: int = 2
    discounted: int = 5
    min_count: int = 2

    def least(self, order: int) -> int:
        return self.min_count if order >= 3 else 1


@dataclass
class Model:
    """``grams`` (ngram_order, ctx, tok, lp) and ``backoffs`` (ngram_order, ctx, la) as tables partitioned by order; natural logarithms.

    ``solved`` has the values of the longest order once more, a compressed row a part, for scoring the corpus.
    """

    settings: Settings
    vocab: int
    unseen: float
    grams: DataFrame
    backoffs: DataFrame | None
    solved: DataFrame | None = None
    factor: np.ndarray | None = None  # of the longest order's counts


def blocks(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``block``, ``id`` and the token ids (uint16) of each text with a token; a block is a run of texts of about ``_BLOCK`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bytebpe.load(vocabulary), TaskContext.get().partitionId()
        if encoder.vocab + 2 > 1 << 16:
            raise ValueError("the vocabulary needs ids under 65,534")
        done = 0
        for b in batches:
            ids, bounds = encoder.encode(b.column("text"))
            k, done = done // _BLOCK, done + len(ids)
            have = np.diff(bounds) > 0
            flat = ids.astype("<u2").tobytes()
            blob = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(flat)]).filter(pa.array(have))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(have.sum()), (part << 32) + k)), b.column("id").filter(pa.array(have)), blob], names=["block", "id", "ids"])

    return docs.mapInArrow(run, "block long, id long, ids binary")


def runs(blobs: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about a million tokens, one text at least, which bounds what a worker holds."""
    sizes, first = np.cumsum(pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(blobs):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + 2 * _RUN, side="right")))
        yield blobs.slice(first, last - first)
        first = last


def keys(blobs: pa.Array, order: int, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram before and at every token and end mark, packed with the token lowest, and the texts' bounds."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    n = len(blobs)
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + n + 1].astype(np.int64) // 2
    flat = np.frombuffer(data, "<u2")[at[0] : at[-1]]
    at = at - at[0]
    ends = at[1:] + np.arange(1, n + 1) - 1  # places of the end marks, once they are in
    padded = np.empty(len(flat) + n, np.uint64)
    marks = np.zeros(len(padded), bool)
    marks[ends] = True
    padded[~marks] = flat
    padded[ends] = vocab + 1
    bounds = np.concatenate([[0], ends + 1])
    first = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(len(padded))
    key = padded.copy()
    for k in range(1, order):
        back = np.full(len(padded), vocab, np.uint64)
        inside = place - k >= first
        back[inside] = padded[place[inside] - k]
        key |= back << np.uint64(16 * k)
    return key, bounds


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order and their counts."""
    key, n = (np.concatenate(p) for p in zip(*parts))
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(blob, n * kind.itemsize, "zstd", asbytes=True), kind)


def squeezed_counts(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, told by the first byte."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(values) or values.max() <= np.iinfo(k).max)
    return kind[2].encode() + squeeze(values.astype(kind))


def unsqueezed_counts(blob: bytes, n: int) -> np.ndarray:
    return unsqueeze(blob[1:], n, f"<u{blob[:1].decode()}").astype(np.int64)


#: Columns that hold the values of n-grams: the count of one that has a probability of its own, else 0, and the total of its context, and the logarithms of the others.
VALUES = ("c", "total", "rest")


def values(row: dict, factor: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of a row's n-grams."""
    c, total = (unsqueezed_counts(row[x], row["n"]) for x in ("c", "total"))
    lp = np.log(np.where(c, c * factor[np.minimum(c, len(factor) - 1)], 1.0) / total)
    lp[c == 0] = unsqueeze(row["rest"], int((c == 0).sum()), np.float64)
    return lp


def put(c: np.ndarray, total: np.ndarray, lp: np.ndarray) -> dict[str, bytes]:
    return {"c": squeezed_counts(c), "total": squeezed_counts(total), "rest": squeeze(lp[c == 0])}


@dataclass(frozen=True)
class Split:
    """How n-grams are spread over ``parts``: by the token before the last, and where that is frequent by the one before it too.

    All n-grams of a context are in one part, and so are all that back off to one another wherever ``salts`` is 1.
    """

    order: int
    parts: int
    salts: np.ndarray  # by token, at most 65,536

    def of(self, near: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix64((near.astype(np.uint64) << np.uint64(32)) + salt.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def part(self, key: np.ndarray, order: int | None = None) -> np.ndarray:
        """The part of each n-gram; of shorter ones only where their own tokens tell."""
        order = order or self.order
        if self.order == 1:
            return np.zeros(len(key), np.int64)
        near = (key >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)
        salt = mix64(key >> np.uint64(32) & np.uint64(0xFFFF)) % self.salts[near].astype(np.uint64) if order > 2 else np.zeros(len(key), np.uint64)
        return self.of(near, salt)


@dataclass
class Corpus:
    """``encoded`` texts; ``messages``: the n-grams of each block for each part; ``grams``: their sums, a row a part."""

    vocab: int
    split: Split
    encoded: DataFrame
    messages: DataFrame
    grams: DataFrame


MESSAGE = "part long, block long, n long, ngrams binary, counts binary"
GRAMS = "part long, n long, ngrams binary, counts binary, few array<long>"


def count(spark: SparkSession, docs: DataFrame, vocabulary: str, s: Settings) -> Corpus:
    """Count all n-grams of the longest order.

    They are counted inside each block first. A block's n-grams travel as one compressed message a part, at some 2 bytes
    each; a part holds those of about ``_PART`` tokens, whatever the corpus' size.
    """
    vocab, order = bytebpe.load(vocabulary).vocab, s.order
    encoded = written(spark, blocks(docs, vocabulary), "encoded", compression="zstd")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocab + 2, np.int64)
        for b in batches:
            for part in runs(b.column("ids")):
                key, bounds = keys(part, 1, vocab)
                n += np.bincount(key.astype(np.int64), minlength=vocab + 2)
                n[vocab] += (order - 1) * (len(bounds) - 1)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[have])], names=["tok", "n"])

    frequent = np.zeros(vocab + 2, np.int64)
    for tok, n in encoded.select("ids").mapInArrow(tokens, "tok long, n long").groupBy("tok").agg(F.sum("n")).collect():  # at most a row a token
        frequent[tok] = n
    split = Split(order, max(1, int(-(-frequent.sum() // _PART))), np.maximum(1, -(-frequent // _PART)))
    shared = spark.sparkContext.broadcast(split)

    def send(block: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = shared.value.part(key)
        order = np.argsort(part, kind="stable")
        key, n, part = key[order], n[order], part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        rows = [(int(part[a]), block, int(z - a), squeeze(key[a:z]), squeeze(n[a:z])) for a, z in zip(cuts[:-1], cuts[1:]) if z > a]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "n", "ngrams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, held = None, []
        for b in batches:
            block = b.column("block").to_numpy()
            for x in np.unique(block).tolist():
                if x != open_block and held:
                    yield send(open_block, *held[0])
                    held = []
                open_block = x
                for part in runs(b.column("ids").filter(pa.array(block == x))):
                    held = [merged([*held, np.unique(keys(part, order, vocab)[0], return_counts=True)])]
        if held:
            yield send(open_block, *held[0])

    messages = written(spark, encoded.select("block", "ids").mapInArrow(run, MESSAGE), "messages")

    def add(rows: pa.Table) -> pa.Table:
        got = [(unsqueeze(k, n, np.uint64), unsqueeze(c, n, np.int64)) for n, k, c in zip(*(rows.column(x).to_pylist() for x in ("n", "ngrams", "counts")))]
        key, n = merged(got)
        few = np.bincount(n[n <= s.discounted + 1], minlength=s.discounted + 2)
        return pa.table({"part": rows.column("part").slice(0, 1), "n": [len(key)], "ngrams": [squeeze(key)], "counts": [squeeze(n)], "few": pa.array([few.tolist()], pa.list_(pa.int64()))})

    return Corpus(vocab, split, encoded, messages, written(spark, messages.groupBy("part").applyInArrow(add, GRAMS), "grams"))


def discounts(counts: dict[int, int], k: int) -> dict[int, float]:
    """What to multiply the counts 1 to ``k`` with, by Good-Turing's r* = (r + 1) n(r+1) / n(r), rescaled so that the whole mass of the unseen is kept.

    Where the counts of counts are too thin for that (any factor outside 0 to 1), every count loses 1/2 instead.
    """
    n = [0, *(counts.get(r, 0) for r in range(1, k + 2))]
    try:
        common = (k + 1) * n[k + 1] / n[1]
        found = {r: ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) for r in range(1, k + 1)}
    except ZeroDivisionError:
        found = {1: 0.0}
    return found if all(0 < d < 1 for d in found.values()) else {r: 1 - 0.5 / r for r in range(1, k + 1)}


def suffix(ctx: Column, order: int) -> Column:
    """The context of the n-gram of that order."""
    return ctx.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def _tables(spark: SparkSession, top: DataFrame, vocab: int, highest: int, s: Settings, folder: str) -> tuple[Model, DataFrame]:
    """The model of orders 1 to ``highest`` from the counts (ctx, tok, c) of the highest, and ``lp`` of all its n-grams."""
    lower, unseen = None, 0.0
    for order in range(1, highest + 1):
        table = top if order == highest else top.groupBy(suffix(F.col("ctx"), order).alias("ctx"), "tok").agg(F.sum("c").alias("c"))
        few = {r.c: r.n for r in table.where(F.col("c") <= s.discounted + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts(few, s.discounted)
        factor = F.element_at(F.create_map(*[x for r, f in d.items() for x in (F.lit(r).cast("long"), F.lit(f))]), F.col("c"))
        kept = F.col("c") >= s.least(order)
        whole = table.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(F.when(kept, F.col("c") * F.coalesce(factor, F.lit(1.0))).otherwise(0.0)).alias("mass"))
        # a context without any discounted count still leaves room for one more event
        whole = whole.select("ctx", F.when(F.col("mass") >= F.col("total"), F.col("total") + 1).otherwise(F.col("total")).alias("total"))
        probs = table.where(kept).join(whole, "ctx").select("ctx", "tok", (F.col("c") * F.coalesce(factor, F.lit(1.0)) / F.col("total")).alias("p"))
        if order == 1:
            seen = probs.agg(F.count("*"), F.sum("p")).first()
            missing = vocab + 1 - seen[0]  # the end mark is an event, the begin mark is not
            unseen = float(np.log(max(1.0 - (seen[1] or 0.0), 1e-300) / missing)) if missing > 0 else 0.0
            if missing <= 0:  # every event was seen: nothing to back off to, so the mass returns to them
                probs = probs.withColumn("p", F.col("p") / F.lit(seen[1]))
        else:
            low = probs.withColumn("low", suffix(F.col("ctx"), order - 1)).join(lower.select(F.col("ctx").alias("low"), "tok", F.col("lp").alias("low_lp")), ["low", "tok"])
            backs = low.groupBy("ctx").agg(F.sum("p").alias("used"), F.sum(F.exp("low_lp")).alias("low_used"))
            backs = backs.select("ctx", F.log(F.greatest(1 - F.col("used"), F.lit(1e-300)) / F.greatest(1 - F.col("low_used"), F.lit(1e-300))).alias("la"))
            backs.write.parquet(f"{folder}/backoffs/ngram_order={order}")
        probs.select("ctx", "tok", F.log("p").alias("lp")).write.parquet(f"{folder}/grams/ngram_order={order}")
        model = Model(s, vocab, unseen, spark.read.parquet(f"{folder}/grams"), spark.read.parquet(f"{folder}/backoffs") if order > 1 else None)
        before, lower = lower, written(spark, evaluate(model, table.select("ctx", "tok"), order), "lower")
        if before is not None:
            discard(before)
    return model, lower


SOLVED = "part long, n long, ngrams binary, c binary, total binary, rest binary, n_ctx long, ctx binary, la binary"


def train(spark: SparkSession, corpus: Corpus, settings: Settings = Settings()) -> Model:
    """The model of all n-grams of the corpus.

    Shorter orders, whose tables grow less and less, are made by joins; the longest is solved part by part, as a part has
    whole contexts. Only counts of counts, ``discounted + 1`` numbers an order, reach the driver, and for order 2 the
    unigrams, at most one a token.
    """
    s, split, vocab = settings, corpus.split, corpus.vocab
    order, folder = s.order, new_folder(spark, "katz")
    shared = spark.sparkContext.broadcast(split)
    highest = max(1, order - 1)
    mask = np.uint64((1 << 16 * highest) - 1)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, k, c in zip(*(b.column(x).to_pylist() for x in ("n", "ngrams", "counts"))):
                key, n = merged([(unsqueeze(k, n, np.uint64) & mask, unsqueeze(c, n, np.int64))])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int32), n)], names=["ctx", "tok", "c"])

    shorter = corpus.grams.select("n", "ngrams", "counts").mapInArrow(shorten, "ctx long, tok int, c long").groupBy("ctx", "tok").agg(F.sum("c").alias("c"))
    shorter = written(spark, shorter, "shorter")
    model, lower = _tables(spark, shorter, vocab, highest, s, folder)
    sums = corpus.grams.select(F.posexplode("few").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()
    factor = np.ones(s.discounted + 2)
    for r, d in discounts({r.c: r.n for r in sums if r.c}, s.discounted).items():
        factor[r] = d
    least = s.least(order)

    def solve(row: dict, low_key: np.ndarray, low_lp: np.ndarray) -> pa.Table:
        key, c = unsqueeze(row["ngrams"], row["n"], np.uint64), unsqueeze(row["counts"], row["n"], np.int64)
        lp = low_lp = low_lp[np.searchsorted(low_key, key & mask)]
        own, total, ctx, la = np.zeros(len(key), np.int64), np.ones(len(key), np.int64), np.zeros(0, np.uint64), np.zeros(0)
        if order > 1:
            kept = c >= least
            own = np.where(kept, c, 0)
            first = np.flatnonzero(np.diff(key >> np.uint64(16), prepend=np.uint64(1 << 63)))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            worth = own * factor[np.minimum(c, s.discounted + 1)]
            total, mass = np.add.reduceat(c, first), np.add.reduceat(worth, first)
            total = np.where(mass >= total, total + 1, total)[of]
            used, low_used = np.add.reduceat(worth / total, first), np.add.reduceat(np.where(kept, np.exp(low_lp), 0.0), first)
            some = np.logical_or.reduceat(kept, first)
            weight = np.where(some, np.log(np.maximum(1 - used, 1e-300) / np.maximum(1 - low_used, 1e-300)), 0.0)
            lp = weight[of] + low_lp
            ctx, la = (key[first] >> np.uint64(16))[some], weight[some]
        out = {"part": row["part"], "n": row["n"], "ngrams": row["ngrams"]} | put(own, total, lp) | {"n_ctx": len(ctx), "ctx": squeeze(ctx), "la": squeeze(la)}
        return pa.table({k: [v] for k, v in out.items()})

    grams = corpus.grams.select("part", "n", "ngrams", "counts")
    if order == 2:
        rows = lower.toPandas().sort_values("tok")
        every = spark.sparkContext.broadcast((rows.tok.to_numpy().astype(np.uint64), rows.lp.to_numpy()))
        solved = grams.groupBy("part").applyInArrow(lambda part: solve(part.to_pylist()[0], *every.value), SOLVED)
    else:

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = b.column("ctx").to_numpy().astype(np.uint64) << np.uint64(16) | b.column("tok").to_numpy().astype(np.uint64)
                row, part = np.arange(len(key)), shared.value.part(key, highest)
                if order == 3:  # the token that salts is not in the shorter n-gram: it goes to all parts it may be asked in
                    near = (key >> np.uint64(16)).astype(np.int64)
                    salts = shared.value.salts[near]
                    row = np.repeat(row, salts)
                    salt = np.arange(len(row)) - np.repeat(np.cumsum(salts) - salts, salts)
                    row, part = np.unique(np.column_stack([row, shared.value.of(near[row], salt)]), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key[row].astype(np.int64)), b.column("lp").take(pa.array(row))], names=["at", "low", "lp"])

        def meet(part: pa.Table, low: pa.Table) -> pa.Table:
            low = low.sort_by("low")
            return pa.concat_tables(solve(row, low.column("low").to_numpy().astype(np.uint64), low.column("lp").to_numpy()) for row in part.to_pylist()) if part.num_rows else pa.table(part.schema.empty_table())

        placed = lower.select("ctx", "tok", "lp").mapInArrow(place, "at long, low long, lp double")
        solved = grams.groupBy("part").cogroup(placed.groupBy("at")).applyInArrow(meet, SOLVED)
    solved = written(spark, solved, "solved")
    discard(shorter, lower, corpus.grams)
    model.solved, model.factor = solved, factor
    if order == 1:
        return model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                kept = unsqueezed_counts(r["c"], r["n"]) > 0
                key, lp = unsqueeze(r["ngrams"], r["n"], np.uint64)[kept], values(r, factor)[kept]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int32), lp)], names=["ctx", "tok", "lp"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unsqueeze(r["ctx"], r["n_ctx"], np.uint64).astype(np.int64)), pa.array(unsqueeze(r["la"], r["n_ctx"], np.float64))], names=["ctx", "la"])

    for name, f, shape in (("grams", rows, "ctx long, tok int, lp double"), ("backoffs", weights, "ctx long, la double")):
        solved.mapInArrow(f, shape).write.option("compression", "zstd").parquet(f"{folder}/{name}/ngram_order={order}")
    model.grams, model.backoffs = (spark.read.parquet(f"{folder}/{name}") for name in ("grams", "backoffs"))
    return model


def evaluate(model: Model, grams: DataFrame, order: int) -> DataFrame:
    """``lp`` of distinct n-grams (``ctx``, ``tok``): the table's where it has one, else the context's backoff weight and, recursively, the shorter n-gram's."""
    own = model.grams.where(F.col("ngram_order") == order).select("ctx", "tok", F.col("lp").alias("own"))
    if order == 1:
        return grams.join(own, ["ctx", "tok"], "left").select("ctx", "tok", F.coalesce("own", F.lit(model.unseen)).alias("lp"))
    shorter = evaluate(model, grams.select(suffix(F.col("ctx"), order - 1).alias("ctx"), "tok").distinct(), order - 1)
    weights = model.backoffs.where(F.col("ngram_order") == order).select("ctx", "la")
    found = grams.join(own, ["ctx", "tok"], "left").join(weights, "ctx", "left").withColumn("low", suffix(F.col("ctx"), order - 1))
    found = found.join(shorter.select(F.col("ctx").alias("low"), "tok", F.col("lp").alias("low_lp")), ["low", "tok"])
    return found.select("ctx", "tok", F.coalesce("own", F.coalesce("la", F.lit(0.0)) + F.col("low_lp")).alias("lp"))


def score_blocks(model: Model, corpus: Corpus) -> DataFrame:
    """One row a text: tokens with the end mark, log-probability and perplexity.

    Each part answers every message with the values of its n-grams, and each block scores its texts with the answers; no
    table is held whole anywhere.
    """
    order, vocab, factor = corpus.split.order, corpus.vocab, model.factor

    def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
        rows, names = part.to_pylist(), ["to", "n", "ngrams", *VALUES]
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
        if not rows or not asked.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        (row,) = rows
        key, c, total, lp = unsqueeze(row["ngrams"], row["n"], np.uint64), unsqueezed_counts(row["c"], row["n"]), unsqueezed_counts(row["total"], row["n"]), values(row, factor)
        out = []
        for block, n, own in zip(*(asked.column(x).to_pylist() for x in ("block", "n", "ngrams"))):
            at = np.searchsorted(key, unsqueeze(own, n, np.uint64))
            out.append((block, n, own, *put(c[at], total[at], lp[at]).values()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    solved = model.solved.select(F.col("part").alias("at"), F.col("n").alias("n"), F.col("ngrams").alias("ngrams"), *VALUES)
    answers = corpus.messages.select("part", "block", "n", "ngrams").groupBy("part").cogroup(solved.groupBy("at")).applyInArrow(answer, "to long, n long, ngrams binary, c binary, total binary, rest binary")

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = np.concatenate([unsqueeze(r["ngrams"], r["n"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
        lp = np.concatenate([values(r, factor) for r in rows] or [np.zeros(0)])
        rank = np.argsort(known, kind="stable")
        known, lp = known[rank], lp[rank]
        ids, blobs = texts.column("id").combine_chunks(), texts.column("ids").combine_chunks()
        total, length = [], []
        for part in runs(blobs):
            key, bounds = keys(part, order, vocab)
            total.append(np.add.reduceat(lp[np.searchsorted(known, key)], bounds[:-1]))
            length.append(np.diff(bounds))
        total, length = np.concatenate(total or [np.zeros(0)]), np.concatenate(length or [np.zeros(0, np.int64)])
        return pa.table([ids, pa.array(length), pa.array(total), pa.array(np.exp(-total / np.maximum(length, 1)))], names=["doc_id", "n_tokens", "log_prob", "perplexity"])

    return corpus.encoded.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(run, SCHEMA)


def score_documents(
    spark: SparkSession, docs: DataFrame, vocabulary: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Train on all texts and score each of them whole.

    One row a document: ``n_tokens`` with the end mark, natural ``log_prob`` of all of them, and ``perplexity``. A null
    or empty text has no tokens: 0, null and null. Null ids and repeated rows have a row each, and repeated rows count
    each time in the model. An empty table gives no row. For every context the probabilities of all events sum to 1.
    """
    s = settings
    if not 1 <= s.order <= 4:
        raise ValueError("order must be from 1 to 4")
    rows = id_text(docs, id_col, text_col)
    corpus = count(spark, rows, vocabulary, s)
    model = train(spark, corpus, s)
    blank = rows.where("text is null or text = ''").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("log_prob"), F.lit(None).cast("double").alias("perplexity"))
    return score_blocks(model, corpus).unionByName(blank)
