"""Exact top-k by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bounded, discard, filesystem, new_folder, publish, written

SCHEMA = "query_id long, neighbor_id long, score double"
BLOCK = "dims int, uri string, n long, low array<double>, high array<double>"
_SLACK = 2e-6  # more than rounding, the rotation's and the sums' error move a score
_SAMPLE = 4096  # vectors that the axes are fitted on
_SHARE = 64  # blocks of rows that a task meets


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec``, an id once. Left out: null ids, null or empty vectors, and vectors with a null, NaN or infinity."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>").alias("vec"))
    rows = rows.where("id is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    return rows.groupBy("id").agg(F.max("vec").alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal_axes(rows: DataFrame, seed: int = 3) -> dict[int, np.ndarray]:
    """For each length of vector, the directions of most variance, as columns; from at most ``_SAMPLE`` vectors.

    Any rotation leaves inner products as they are, so the sample decides how early a search stops, not what it finds.
    """
    drawn = bounded(rows).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(_SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    lengths, axes = drawn.value_lengths().to_numpy(), {}
    for dims in np.unique(lengths).tolist():
        x = matrix(drawn.filter(pa.array(lengths == dims))).astype(np.float64)
        if np.isfinite(x).all():
            axes[dims] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return axes


def save_blocks(spark: SparkSession, rows: DataFrame, axes: dict[int, np.ndarray], size: int, folder: str) -> DataFrame:
    """Files of at most ``size`` vectors of one length, each with its rotated coordinates' lists in ascending order; their index.

    The index has the extremes of every coordinate, so that a block which can't matter to a query needs no reading.
    """
    shared = spark.sparkContext.broadcast(axes)  # dims x dims numbers a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}

        def save(dims: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            uri = f"{folder}/block-{uuid.uuid4().hex}.npz"
            y = rotated(x, shared.value.get(dims))
            buffer = io.BytesIO()
            np.savez(buffer, ids=ids, x=x, order=np.argsort(y, axis=0, kind="stable").astype(np.int32))
            publish(uri, lambda out: out.write(buffer.getvalue()))
            ends = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (y.min(axis=0), y.max(axis=0))]
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([uri]), pa.array([len(ids)], pa.int64()), *ends], names=["dims", "uri", "n", "low", "high"])

        for b in batches:
            lengths = b.column("vec").value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == dims))
                held = kept.setdefault(dims, [])
                held.append((part.column("id").to_numpy(), matrix(part.column("vec")).astype(np.float32)))
                if sum(len(i) for i, _ in held) >= size:
                    ids, x = (np.concatenate(c) for c in zip(*held))
                    whole = len(ids) // size * size
                    for a in range(0, whole, size):
                        yield save(dims, ids[a : a + size], x[a : a + size])
                    kept[dims] = [(ids[whole:], x[whole:])]
        for dims, held in kept.items():
            ids, x = (np.concatenate(c) for c in zip(*held))
            if len(ids):
                yield save(dims, ids, x)

    return rows.mapInArrow(run, BLOCK)


def rotated(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    x = x.astype(np.float64)
    return x if axes is None else x @ axes


def load_block(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        z = np.load(io.BytesIO(f.read()))
    return z["ids"], z["x"].astype(np.float64), z["order"]


class Best:
    """The k best neighbours of each query so far: scores rounded to 6 places, equal scores by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows that this query has not met before."""
        keep = (scores >= self.scores[q, -1] - _SLACK) & (ids != self.queries[q])
        if not keep.any():
            return
        ids, scores = np.concatenate([self.ids[q], ids[keep]]), np.concatenate([self.scores[q], np.round(scores[keep], 6)])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[best], scores[best]


def reach(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that each query (rotated) can score with a row whose coordinates are from ``low`` to ``high``."""
    return np.maximum(y, 0) @ high + np.minimum(y, 0) @ low


def errors(q: np.ndarray, longest: float) -> np.ndarray:
    """More than the sums of doubles can err by, for each query and rows up to a length."""
    return 1e-12 * np.sqrt((q * q).sum(axis=1)) * longest


def search(q: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, order: np.ndarray, axes: np.ndarray | None, best: Best, first: int = 8) -> dict[str, int]:
    """Let one block of rows compete for every query (``q``, and ``y`` rotated); tells by what each search ended.

    The lists of a query are read from the end that its sign favours, to a depth that doubles. A row is scored when it
    first shows in a list. No row still unseen at depth d can score above the sum of q_i times the value at depth d of
    list i: when that can't beat the kth result, the query is done; or when no row is left unseen.
    """
    n = len(x)
    ordered = np.take_along_axis(rotated(x, axes), order, axis=0)
    slack = _SLACK + errors(q, np.sqrt((x * x).sum(axis=1).max()))
    ended = {"bound": 0, "all seen": 0}
    for k in range(len(q)):
        up, down = np.flatnonzero(y[k] > 0), np.flatnonzero(y[k] < 0)
        seen, left, a, b = np.zeros(n, bool), n, 0, min(first, n)
        while left and reach(y[k], ordered[a], ordered[n - 1 - a]) >= best.scores[k, -1] - slack[k]:
            new = np.zeros(n, bool)
            new[order[n - b : n - a][:, up]] = True
            new[order[a:b][:, down]] = True
            if b == n:  # a query of zeros has no lists
                new[:] = True
            new &= ~seen
            rows = np.flatnonzero(new)
            seen |= new
            left -= len(rows)
            best.add(k, ids[rows], x[rows] @ q[k])
            a, b = b, min(2 * b, n)
        ended["bound" if left else "all seen"] += 1
    return ended


def top_k(
    spark: SparkSession, df: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 8192
) -> DataFrame:
    """The ``k`` rows of ``df`` of greatest inner product with each query, itself left out: ``query_id``, ``rank``, ``neighbor_id``, ``score``.

    Exact: a score is the inner product in double precision rounded to 6 places, and equal scores go to the lower id.
    ``queries`` has the same columns as ``df``; without it, every row is a query. Vectors are rotated to the axes of most
    variance, ordered by the first, and written in blocks with their sorted lists. A task takes a block of queries and
    at most 64 blocks of rows, the most promising first; a block that by its extremes has nothing for any query of the
    task is not read.

    Rows with a null id or vector, an empty vector, or a null, NaN or infinity in it are neither queries nor results. Rows with
    the same id count once, with the greatest vector in array order; a query leaves out the row of its own id. Only
    vectors of equal length meet. With fewer than k others, all of them are returned; an empty table gives no row.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = written(spark, vectors(df, id_col, vec_col), "vectors")
    asked = rows if queries is None else written(spark, vectors(queries, id_col, vec_col), "queries")
    axes, folder = principal_axes(rows), new_folder(spark, "blocks")
    n_asked, cores = asked.count(), spark.sparkContext.defaultParallelism

    def blocks(table: DataFrame, size: int) -> DataFrame:
        lead = F.lit(0.0)
        for dims, a in axes.items():  # the first rotated coordinate; vectors near in it share a block
            along = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(v)) for v in a[:, 0]]), lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)
            lead = F.when(F.size("vec") == dims, along).otherwise(lead)
        spread = table.withColumn("lead", lead).repartitionByRange(F.size("vec"), "lead").sortWithinPartitions(F.size("vec"), "lead")
        return written(spark, save_blocks(spark, spread.select("id", "vec"), axes, size, folder), "index")

    index = blocks(rows, block)
    ask = blocks(asked, int(np.clip(-(-n_asked // (4 * cores)), 64, block)))
    discard(*({id(t): t for t in (rows, asked)}.values()))
    shares = max(1, -(-index.count() // _SHARE))
    others = index.select("dims", F.pmod(F.xxhash64("uri"), F.lit(shares)).alias("share"), F.struct("uri", "low", "high").alias("rows"))
    others = others.groupBy("dims", "share").agg(F.sort_array(F.collect_list("rows")).alias("rows"))
    work = ask.select("dims", F.col("uri").alias("query")).join(others, "dims")
    work = work.repartition(max(1, min(ask.count() * shares, 100_000)), "query", "share")
    shared = spark.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, query, others in zip(*(b.column(c).to_pylist() for c in ("dims", "query", "rows"))):
                turn = shared.value.get(dims)
                names, q, _ = load_block(query)
                y, best = rotated(q, turn), Best(names, k)
                low, high = (np.array([o[c] for o in others]) for c in ("low", "high"))
                slack = _SLACK + errors(q, np.sqrt((np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=1).max()))
                most = np.array([reach(y, *ends) for ends in zip(low, high)])
                for place in np.argsort(-most.max(axis=1), kind="stable"):
                    open_ = np.flatnonzero(most[place] >= best.scores[:, -1] - slack)
                    if len(open_):
                        part = Best(names[open_], k)
                        part.scores, part.ids = best.scores[open_], best.ids[open_]
                        search(q[open_], y[open_], *load_block(others[place]["uri"]), turn, part)
                        best.scores[open_], best.ids[open_] = part.scores, part.ids
                real = np.isfinite(best.scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)[real.ravel()]), pa.array(best.ids[real]), pa.array(best.scores[real])], names=["query_id", "neighbor_id", "score"])

    found = work.select("dims", "query", "rows").mapInArrow(run, SCHEMA)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "score")


def brute(x: pd.DataFrame, k: int) -> list[tuple[int, int, int, float]]:
    """The same from all pairs, for tests: ``x`` has ``id`` and ``vec``."""
    out = []
    for q, v in zip(x.id, x.vec):
        all_of = sorted((-round(float(np.dot(np.float64(v), np.float64(w))), 6), i) for i, w in zip(x.id, x.vec) if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(all_of[:k], 1)]
    return out
