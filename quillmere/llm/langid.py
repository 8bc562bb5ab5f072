"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded, gather, id_text, mix64, no_null, slices, split_chunks

_RUN = 16_384
SCHEMA = "doc_id long, predicted string, confidence double, rejected boolean"


@dataclass(frozen=True)
class Settings:
    """``max_train`` bounds the labelled rows that the classifier is fitted on; ``held_out`` of them calibrate it.

    ``least`` is the calibrated probability under which a prediction is rejected.
    """

    buckets: int = 1 << 16
    dims: int = 16
    shortest: int = 2
    longest: int = 5
    epochs: int = 5
    rate: float = 2.0
    max_train: int = 2400
    held_out: float = 0.45
    least: float = 0.5
    seed: int = 11


@dataclass
class Model:
    """The last class, after those of ``languages``, is that of texts in none of them."""

    languages: list[str]
    table: np.ndarray  # buckets x classes: what one subword adds to each class's score
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float  # on held-out labelled rows


def subwords(pieces: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each piece's subwords, end to end, and the pieces' bounds; a run of pieces at a time, as working on one takes some hundred times its bytes."""
    flat, sizes = zip(*(_subwords(pieces.slice(a, _RUN), s) for a in range(0, max(1, len(pieces)), _RUN)))
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for at in sizes]))])


def _subwords(pieces: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The same for one run.

    A piece is its letters in lower case between boundary marks; a subword is any run of ``shortest`` to ``longest``
    bytes of it. A piece without letters has none.
    """
    words = pc.replace_substring_regex(pc.utf8_lower(pieces), r"[^\pL\pM]+", "")
    marked = pc.if_else(pc.equal(words, ""), "", pc.binary_join_element_wise("<", words, ">", ""))
    n = len(marked)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, offsets, data = marked.buffers()
    at = np.frombuffer(offsets, np.int32)[marked.offset : marked.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.uint64) if data is not None else np.zeros(0, np.uint64)
    at = at - at[0]
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))  # bytes left in the word
    owner = np.repeat(np.arange(n), np.diff(at))
    gram, found, owners = raw.copy(), [], []
    for size in range(2, s.longest + 1):
        gram[: len(raw) - size + 1] |= raw[size - 1 :] << np.uint64(8 * (size - 1))
        if size >= s.shortest:
            fits = room >= size
            found.append((mix64(gram[fits] + np.uint64(size << 56)) % np.uint64(s.buckets)).astype(np.int32))
            owners.append(owner[fits])
    flat, who = np.concatenate(found), np.concatenate(owners)
    return flat[np.argsort(who, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, zero for an empty run."""
    return np.diff(np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])[bounds], axis=0)


#: First letters of runs of 256 that are letters in other scripts.
_SCRIPTS = (0x0410, 0x4E00, 0x5A00, 0x6F00, 0xAC00, 0xB900, 0xC600)


def foreign(text: str) -> str:
    """The text made into one of no known language: its characters in another order, its letters swapped for each other, or moved to another script.

    Which of the three, and how, depends on the text alone.
    """
    draw = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    kind = draw.integers(3)
    if kind == 0:
        return "".join(draw.permutation(list(text)).tolist())
    letters = sorted({c for c in text if c.isalpha()})
    if kind == 1:
        return text.translate(dict(zip(map(ord, letters), draw.permutation(letters).tolist()))) if letters else text
    first = _SCRIPTS[draw.integers(len(_SCRIPTS))]
    return text.translate({ord(c): chr(first + (ord(c) * 7) % (64 if first < 0x4E00 else 256)) for c in letters})


def features(docs: DataFrame, s: Settings) -> DataFrame:
    """``label``, the buckets of a text and their shares; a text without letters has none. Every fourth text, by a hash of it, also comes made foreign, without a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, limit=1 << 20)):
            texts = no_null(b.column("text"))
            strange = [foreign(t) for t in texts.to_pylist() if zlib.crc32(t.encode()) >> 8 & 3 == 0]
            for labels, part in ((b.column("label"), texts), (pa.nulls(len(strange), pa.string()), pa.array(strange, pa.string()))):
                codes, bounds, pieces = split_chunks(part)
                flat, at = subwords(pieces, s)
                ids, shares = [], []
                for i in range(len(part)):
                    total = np.bincount(gather(flat, at, codes[bounds[i] : bounds[i + 1]])[0], minlength=s.buckets)
                    k = np.flatnonzero(total)
                    ids.append(k.astype(np.int32))
                    shares.append((total[k] / max(1, total.sum())).astype(np.float32))
                yield pa.RecordBatch.from_arrays([labels, pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["label", "ids", "shares"])

    return docs.select("label", "text").mapInArrow(run, "label string, ids array<int>, shares array<float>")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(labels: list[str | None], ids: list[np.ndarray], shares: list[np.ndarray], s: Settings) -> Model:
    """Stochastic gradient descent, a document a step, then a temperature from the held-out rows.

    Rows without a label are texts of no known language and a class like the languages. The temperature makes held-out
    probabilities right on average, so one threshold serves any number of rows and languages.
    """
    languages = sorted({x for x in labels if x is not None})
    n = len(languages) + 1
    place = {x: k for k, x in enumerate([*languages, None])}
    y = np.array([place[x] for x in labels])
    draw = np.random.default_rng(s.seed)
    order = draw.permutation(len(y))
    held = order[: int(len(y) * s.held_out)]
    kept = order[len(held) :]
    embed = draw.uniform(-1 / s.dims, 1 / s.dims, (s.buckets, s.dims)).astype(np.float32)
    weights, bias = np.zeros((s.dims, n), np.float32), np.zeros(n, np.float32)
    steps, step = s.epochs * len(kept), 0
    for _ in range(s.epochs):
        for i in draw.permutation(kept):
            rate = np.float32(s.rate * (1 - step / steps))
            step += 1
            rows = embed[ids[i]]
            hidden = shares[i] @ rows
            g = _softmax(hidden @ weights + bias)
            g[y[i]] -= 1
            back = weights @ g
            weights -= rate * np.outer(hidden, g)
            bias -= np.float32(0.05) * rate * g
            embed[ids[i]] = rows - rate * np.outer(shares[i] * np.float32(len(shares[i]) ** 0.5), back)
    table = embed @ weights
    judged = held if len(held) else kept
    scores = np.array([shares[i] @ table[ids[i]] for i in judged]).reshape(len(judged), -1) + bias
    grid = np.geomspace(0.2, 5, 60)
    loss = [-np.log(_softmax(scores / t)[np.arange(len(judged)), y[judged]] + 1e-12).mean() for t in grid]
    named = y[judged] < n - 1
    accuracy = float((scores[named, : n - 1].argmax(axis=1) == y[judged][named]).mean()) if named.any() else 1.0
    return Model(languages, table.astype(np.float32), bias, float(grid[int(np.argmin(loss))]), s.least, accuracy)


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Fit on at most ``max_train`` labelled rows, chosen by a hash of id and text, and on foreign ones made of a quarter of them; their whole texts count.

    Only hashed features of the chosen rows reach the driver, at most ``buckets`` numbers a row. None if no row has
    a label and letters.
    """
    s = settings
    chosen = bounded(docs).where(F.col(f"`{label_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label")
    )
    place = F.xxhash64(F.col("id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(s.seed))
    cut = chosen.select(place.alias("place"), "label").orderBy("place", "label").limit(s.max_train).agg(F.max("place")).first()[0]
    chosen = chosen.where(place <= cut)
    got = features(chosen, s).toArrow() if cut is not None else pa.table({"label": [], "ids": pa.array([], pa.list_(pa.int32())), "shares": pa.array([], pa.list_(pa.float32()))})
    ids, shares = (got.column(c).combine_chunks() for c in ("ids", "shares"))
    at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
    ids, shares = ids.flatten().to_numpy(), shares.flatten().to_numpy()
    rows = [(label, ids[x:y], shares[x:y]) for label, x, y in zip(got.column("label").to_pylist(), at, at[1:]) if y > x]
    if not any(r[0] is not None for r in rows):
        return None
    rows.sort(key=lambda r: (r[0] is None, r[0] or "", len(r[1]), r[1][:4].tolist(), r[2][:4].tolist()))  # whatever order they came in
    return fit([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], s)


def scores(texts: pa.Array, model: Model, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities of each text, the last for no known language, and its number of subwords."""
    codes, bounds, pieces = split_chunks(texts)
    per_piece = np.zeros((len(pieces), len(model.bias) + 1))
    for first in range(0, len(pieces), _RUN):
        flat, at = subwords(pieces.slice(first, _RUN), s)
        per_piece[first : first + _RUN] = np.column_stack([_sums(model.table[flat], at), np.diff(at)])
    total = _sums(per_piece[codes], bounds)
    n = total[:, -1]
    return _softmax((total[:, :-1] / np.maximum(n, 1)[:, None] + model.bias) / model.temperature), n


def identify(
    spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None
) -> DataFrame:
    """One row a document: predicted language, calibrated confidence, and whether it is rejected.

    The classifier is fitted on a bounded sample of the labelled rows unless ``model`` is given; every whole text is
    then judged, without a shuffle. A document is rejected when the calibrated probability of its most likely language is
    under ``least``, as with texts of no known language, or when it has no letters (null and empty texts too): then
    prediction and confidence are null. So one labelled language is enough: the other class is "none of them". Equal
    scores go to the language that sorts first. Without any labelled row nothing can be told: all predictions are null,
    none rejected. Null ids and repeated rows have a row each. An empty table gives no row.
    """
    s = settings
    model = model or train(docs, s, id_col, text_col, label_col)
    if model is None:
        return id_text(docs, id_col, text_col).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("rejected"))
    shared = spark.sparkContext.broadcast(model)  # buckets x languages floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.languages)
        for b in (x for batch in batches for x in slices(batch)):
            p, n = scores(b.column("text"), m, s)
            none = pa.array(n == 0)
            best = p[:, :-1].argmax(axis=1)
            sure = p[np.arange(len(p)), best]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pc.if_else(none, None, names.take(pa.array(best))), pc.if_else(none, None, pa.array(sure)), pa.array((n == 0) | (sure < m.threshold))],
                names=["doc_id", "predicted", "confidence", "rejected"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_identified(
    spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``identify`` doesn't reject: null and empty texts go, null ids stay.

    Without any labelled row all rows stay.
    """
    model = model or train(docs, settings, id_col, text_col, label_col)
    if model is None:
        return docs
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, text_col)):
            p, n = scores(b.column(text_col), shared.value, settings)
            yield b.filter(pa.array((n > 0) & (p[:, :-1].max(axis=1) >= shared.value.threshold)))

    return bounded(docs).mapInArrow(run, docs.schema)
