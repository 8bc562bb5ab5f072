"""Near-duplicate vectors by a flat, robust-pruned graph built on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bounded, discard, mix64, written
from .components import components
from .topk import matrix, vectors

PAIRS = "id_a long, id_b long, similarity double"
CLASSES = "vec_id long, class_id long, links long, recall double"


@dataclass(frozen=True)
class Settings:
    """Pairs of cosine at least ``threshold``; about ``shard`` vectors a cluster; each vector in its ``overlap`` nearest clusters.

    Clusters: at most ``centres``, fitted in ``rounds`` on about ``drawn`` vectors for each; one that gathers more than four
    times ``shard`` members is cut by hash into several shards, each of which all its queries visit. A query visits the
    clusters of its own shards and those up to ``route`` less near than the nearest. Graph: ``degree`` edges pruned with
    ``alpha`` from the ``candidates`` nearest. Search: from ``medoids`` nodes with ``beam`` entries, then nodes up to
    ``margin`` under the threshold are all expanded. ``audit`` vectors, or more until ``partnered`` of them have partners,
    measure the recall on at most ``partners`` each; under ``recall`` it is built again with more overlap, wider routes and
    beams, ``attempts`` times at most, and under ``least`` then fails.
    """

    threshold: float = 0.95
    shard: int = 1500
    overlap: int = 2
    centres: int = 65_536
    drawn: int = 64
    rounds: int = 4
    route: float = 0.06
    degree: int = 24
    alpha: float = 1.2
    candidates: int = 64
    medoids: int = 16
    beam: int = 24
    margin: float = 0.05
    audit: int = 1024
    partnered: int = 100
    partners: int = 32
    recall: float = 0.95
    least: float = 0.9
    attempts: int = 3
    seed: int = 5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cluster(spark: SparkSession, rows: DataFrame, n: int, s: Settings) -> np.ndarray:
    """Centres of spherical k-means, fitted on at most about ``centres * drawn`` vectors chosen by a hash of the id."""
    k = max(1, min(s.centres, -(-n // s.shard)))
    place = F.xxhash64("id", F.lit(s.seed))
    first = rows.orderBy(place, "id").limit(k).select("vec").toArrow().column("vec").combine_chunks()
    centres = unit(matrix(first).astype(np.float64)).astype(np.float32)
    if k == 1:
        return centres
    sample, share = rows.select("id", "vec"), s.drawn * k / n
    if share < 1:
        sample = sample.where(F.pmod(F.xxhash64("id", F.lit(s.seed + 2)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample, dims = written(spark, sample.select("vec"), "sample"), centres.shape[1]
    for _ in range(s.rounds):
        now = spark.sparkContext.broadcast(centres)  # at most `centres` vectors

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((k, dims)), np.zeros(k, np.int64)
            for b in batches:
                for a in range(0, b.num_rows, 1024):
                    x = matrix(b.column("vec").slice(a, 1024))
                    own = (x @ now.value.T).argmax(axis=1)
                    np.add.at(total, own, x)
                    count += np.bincount(own, minlength=k)
            have = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(list(total[have]), pa.list_(pa.float64()))], names=["cluster", "total"])

        parts = sample.mapInArrow(sums, "cluster long, total array<double>").select("cluster", F.posexplode("total"))
        parts = parts.groupBy("cluster", "pos").agg(F.sum("col").alias("x")).toPandas()
        total = np.zeros((k, dims))
        total[parts.cluster, parts.pos] = parts.x
        some = (total * total).sum(axis=1) > 0
        centres = centres.copy()
        centres[some] = unit(total[some])
    discard(sample)
    return centres


def robust_prune(x: np.ndarray, node: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of each ``node`` out of ``near`` (closest first, -1 for none): keep the closest, drop what is nearer to it by ``alpha`` than to the node, go on."""
    alive = (near >= 0) & (near != node[:, None])
    y = x[near]
    own = 2 - 2 * np.einsum("nd,nkd->nk", x[node], y)
    rows, out = np.arange(len(node)), np.full((len(node), degree), -1, np.int64)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, k] = near[rows, pick][some]
        apart = 2 - 2 * np.einsum("nd,nkd->nk", y[rows, pick], y)
        alive &= ~(alpha**2 * apart <= own)
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, s: Settings) -> np.ndarray:
    """Edges of a shard, -1 for none."""
    n = len(x)
    width, out = min(n - 1, s.candidates), [np.full((0, s.degree), -1, np.int64)]
    for a in range(0, n, 256):
        node = np.arange(a, min(n, a + 256))
        if width == 0:
            out.append(np.full((len(node), s.degree), -1, np.int64))
            continue
        sims = x[node] @ x.T
        sims[np.arange(len(node)), node] = -np.inf
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        order = np.lexsort((near, -np.take_along_axis(sims, near, axis=1)), axis=1)
        out.append(robust_prune(x, node, np.take_along_axis(near, order, axis=1), s.degree, s.alpha))
    return np.concatenate(out)


def medoids(x: np.ndarray, k: int) -> np.ndarray:
    """Members nearest to the means of ``k`` parts of a shard, found in two rounds from evenly spaced members."""
    centres = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64))]
    for _ in range(2):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        some = (total * total).sum(axis=1) > 0
        centres = centres.copy()
        centres[some] = unit(total[some])
    return np.unique((x @ centres.T).argmax(axis=0))


def greedy(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, s: Settings, wide: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, node and similarity of all nodes met within the range that is expanded.

    All queries go in step: best-first from ``starts``, ``wide`` entries of the beam expanded at a time, until the beam holds
    none that isn't; then every node met within the range is expanded, and what these lead to, until nothing is new.
    """
    n, nq, least = len(x), len(queries), s.threshold - s.margin
    met, spread, last = np.zeros((nq, n), bool), np.zeros((nq, n), bool), np.zeros((nq, n), np.int16)
    sims = queries @ x[starts].T
    order = np.argsort(-sims, axis=1, kind="stable")[:, : s.beam]
    pool, val = starts[order], np.take_along_axis(sims, order, axis=1)
    done = np.zeros(pool.shape, bool)
    met[:, starts] = True
    q, c = np.nonzero(sims >= least)
    found = [(q, starts[c], sims[q, c])]
    live = np.arange(nq)
    while len(live):
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :wide]  # the pool is sorted, so these are the nearest
        open_ = ~np.take_along_axis(done[live], pick, axis=1)
        node = np.where(open_, np.take_along_axis(pool[live], pick, axis=1), -1)
        done[live[:, None], pick] = True
        r, c = np.nonzero(open_)
        spread[live[r], node[r, c]] = True
        near = np.where(node[:, :, None] >= 0, edges[node], -1).reshape(len(live), -1)
        col = np.broadcast_to(np.arange(near.shape[1], dtype=np.int16), near.shape)
        last[live[:, None], near] = col  # of equal ones in a row the last counts
        fresh = (near >= 0) & ~met[live[:, None], near] & (last[live[:, None], near] == col)
        r, c = np.nonzero(fresh)
        to = near[r, c]
        met[live[r], to] = True
        score = np.full(near.shape, -np.inf, np.float32)
        score[r, c] = got = np.einsum("nd,nd->n", queries[live[r]], x[to])
        hit = got >= least
        found.append((live[r[hit]], to[hit], got[hit]))
        ids, vals = np.concatenate([pool[live], near], axis=1), np.concatenate([val[live], score], axis=1)
        old = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argsort(-vals, axis=1, kind="stable")[:, : s.beam]
        if pool.shape[1] < best.shape[1]:
            pad = ((0, 0), (0, best.shape[1] - pool.shape[1]))
            pool, val, done = np.pad(pool, pad), np.pad(val, pad, constant_values=-np.inf), np.pad(done, pad, constant_values=True)
        pool[live], val[live], done[live] = (np.take_along_axis(v, best, axis=1) for v in (ids, vals, old))
        live = live[(~done[live]).any(axis=1)]
    q, node, _ = (np.concatenate(c) for c in zip(*found))
    open_ = ~spread[q, node]
    q, node = q[open_], node[open_]
    while len(q):
        near, who = edges[node], np.repeat(q, edges.shape[1])
        near = near.ravel()
        fresh = near >= 0
        fresh[fresh] = ~met[who[fresh], near[fresh]]
        key = np.unique(who[fresh] * n + near[fresh])
        q, node = key // n, key % n
        met[q, node] = True
        score = np.einsum("nd,nd->n", queries[q], x[node])
        hit = score >= least
        q, node = q[hit], node[hit]
        found.append((q, node, score[hit]))
    return tuple(np.concatenate(c) for c in zip(*found))


def in_range(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of one graph, within the range that is expanded; several hundred queries at a time."""
    starts, out, step = medoids(x, s.medoids), [(np.zeros(0, np.int64),) * 2], max(16, min(512, (4 << 20) // max(1, len(x))))
    for a in range(0, len(queries), step):
        q, node, _ = greedy(x, edges, starts, queries[a : a + step], s)
        out.append((q + a, node))
    return tuple(np.concatenate(c) for c in zip(*out))


def _pairs_once(spark: SparkSession, rows: DataFrame, n: int, s: Settings) -> DataFrame:
    """Pairs of nodes, each once and verified, as a written table.

    What is in one task is bounded: the members of a shard, and a few thousand queries at a time. Copies of a query go to
    every cluster that may hold a partner, so that a pair is missed only where neither finds the other's shards.
    """
    centres = spark.sparkContext.broadcast(cluster(spark, rows, n, s))
    k = len(centres.value)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                sims = matrix(part.column("vec")) @ centres.value.T
                over = min(s.overlap, k)
                least = np.partition(sims, k - over, axis=1)[:, k - over]
                row, to = np.nonzero(sims >= np.minimum(least, sims.max(axis=1) - s.route)[:, None])
                take, own = pa.array(row), sims[row, to] >= least[row]
                yield pa.RecordBatch.from_arrays([pa.array(to), part.column("id").take(take), part.column("vec").take(take), pa.array(own)], names=["cluster", "id", "vec", "member"])

    routed = written(spark, rows.select("id", "vec").mapInArrow(route, "cluster long, id long, vec array<float>, member boolean"), "routed")
    sizes = routed.groupBy("cluster").agg(F.sum(F.col("member").cast("long")).alias("m"), F.count("*").alias("q"))
    sizes = F.broadcast(sizes.select("cluster", F.ceil(F.greatest(F.col("m"), F.lit(1)) / (4 * s.shard)).alias("subs"), F.ceil(F.col("q") / 8192).alias("chunks")))  # a row a cluster
    placed = routed.join(sizes, "cluster").withColumn("sub", F.pmod(F.xxhash64("id", F.lit(s.seed)), F.col("subs")))
    members = placed.where("member").select("cluster", "sub", "chunks", "id", "vec")

    def graph(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        ids = part.column("id").to_numpy()
        edges = build(matrix(part.column("vec").combine_chunks()), s)
        have = edges >= 0
        at = np.concatenate([[0], np.cumsum(have.sum(axis=1))]).astype(np.int32)
        return pa.table({"id": ids, "edges": pa.ListArray.from_arrays(pa.array(at), pa.array(ids[edges[have]]))})

    lists = members.select("cluster", "sub", "id", "vec").groupBy("cluster", "sub").applyInArrow(graph, "id long, edges array<long>")
    united = written(spark, lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "graph")
    held = members.join(united, "id").select("cluster", "sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "vec", "edges")
    asks = placed.select(F.col("cluster").alias("of"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("at"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("run"), F.col("id").alias("query"), F.col("vec").alias("asked"))

    def visit(asked: pa.Table, part: pa.Table) -> pa.Table:
        if not asked.num_rows or not part.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["id_a", "id_b", "similarity"])
        part, asked = part.sort_by("id"), asked.sort_by("query")
        ids, names = part.column("id").to_numpy(), asked.column("query").to_numpy()
        x, queries = (matrix(c.combine_chunks()) for c in (part.column("vec"), asked.column("asked")))
        lists = part.column("edges").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        to = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        edges = np.full((len(ids), max(1, sizes.max())), -1, np.int64)
        edges[np.arange(edges.shape[1]) < sizes[:, None]] = np.where(ids[to] == flat, to, -1)  # ends in other shards are followed there
        q, node = in_range(x, edges, queries, s)
        apart = names[q] != ids[node]
        q, node = q[apart], node[apart]
        sim = np.empty(len(q))
        for a in range(0, len(q), 1 << 16):
            u, v = (unit(t[i[a : a + (1 << 16)]].astype(np.float64)) for t, i in ((queries, q), (x, node)))
            sim[a : a + len(u)] = np.round((u * v).sum(axis=1), 6)
        kept = sim >= s.threshold
        one, other = names[q[kept]], ids[node[kept]]
        return pa.table([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(sim[kept])], names=["id_a", "id_b", "similarity"])

    found = asks.groupBy("of", "at", "run").cogroup(held.groupBy("cluster", "sub", "chunk")).applyInArrow(visit, PAIRS)
    pairs = written(spark, found.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity")), "pairs")
    discard(routed, united)
    return pairs


def audit(spark: SparkSession, rows: DataFrame, pairs: DataFrame, s: Settings) -> float | None:
    """Recall of ``pairs`` among unequal vectors, on partners of sampled vectors, found by comparing these with all.

    The sample of ``s.audit`` vectors grows eightfold, twice at most, until ``s.partnered`` of them have partners; of each one's
    partners those of least hash count, ``s.partners`` at most. None if no partner is seen.
    """
    whole = rows.count()
    for more in (1, 8, 64):
        size = s.audit * more
        sample = rows.orderBy(F.xxhash64("id", F.lit(s.seed + 1)), "id").limit(size).select("id", "vec").toArrow()
        if not sample.num_rows:
            return None
        shared = spark.sparkContext.broadcast((sample.column("id").to_numpy(), unit(matrix(sample.column("vec").combine_chunks()).astype(np.float64))))

        def partners(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            for b in batches:
                met = []
                for a in range(0, b.num_rows, 256):
                    other, y = b.column("id").to_numpy()[a : a + 256], unit(matrix(b.column("vec").slice(a, 256)).astype(np.float64))
                    q, o = np.nonzero(np.round(x @ y.T, 6) >= s.threshold)
                    apart = ids[q] != other[o]
                    met.append((ids[q][apart], other[o][apart]))
                q, o = (np.concatenate(c) for c in zip(*met)) if met else (np.zeros(0, np.int64),) * 2
                turn = mix64(q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + o.astype(np.uint64)).astype(np.int64)
                order = np.lexsort((turn, q))
                q, o, turn = q[order], o[order], turn[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                few = place < s.partners
                yield pa.RecordBatch.from_arrays([pa.array(v[few]) for v in (q, o, turn)], names=["query", "node", "turn"])

        true = rows.select("id", "vec").mapInArrow(partners, "query long, node long, turn long")
        true = true.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("turn", "node"))).where(F.col("place") <= s.partners)
        true = written(spark, true.select("query", "node"), "audit")
        if more == 64 or size >= whole or true.select("query").distinct().count() >= s.partnered:
            break
        discard(true)
    both = true.select(F.least("query", "node").alias("id_a"), F.greatest("query", "node").alias("id_b")).distinct()
    n = both.count()
    met = both.join(pairs, ["id_a", "id_b"], "left_semi").count()
    discard(true)
    return met / n if n else None


@dataclass
class Found:
    """``rows`` (id, node, copies): the node that stands for each vector, the least id among its equals, and how many are equal.
    ``pairs`` (id_a, id_b, similarity): nodes within the threshold. ``recall``: what the audit says of them."""

    rows: DataFrame
    pairs: DataFrame
    recall: float | None


def similar(spark: SparkSession, df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> Found | None:
    """The pairs of unequal vectors whose cosine, rounded to 6 places, is at least ``threshold``, as pairs of nodes, and the nodes' members.

    The pairs are found by graph search and each is verified exactly, so none is wrong; some may be missed, and an audit
    against all vectors measures how many: under 0.9 of them it raises. Vectors that are equal once scaled to length 1 are one node.
    """
    s = settings
    rows = vectors(bounded(df), id_col, vec_col)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec")).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            real = norm > 0
            y = (x[real] / norm[real, None] + 0.0).astype(np.float32)
            bits, keys = y.view(np.uint32).astype(np.uint64), []
            for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                key = np.full(len(y), salt, np.uint64)
                for d in range(y.shape[1]):
                    key = mix64(key * np.uint64(salt | 1) + bits[:, d])
                keys.append(pa.array(key.astype(np.int64)))
            at = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(real)), pa.ListArray.from_arrays(at, pa.array(y.ravel())), *keys], names=["id", "vec", "h", "g"])

    every = rows.where(F.size("vec") == lengths.d).select("id", "vec").mapInArrow(scaled, "id long, vec array<float>, h long, g long")
    every = written(spark, every, "unit")
    # equal vectors (by a 128-bit hash) are one node of the graph, and need no search to meet
    equal = every.groupBy("h", "g").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    rows = every.join(equal, ["h", "g"], "left").select("id", F.coalesce("least", "id").alias("node"), F.coalesce("n", F.lit(1)).alias("copies"), "vec")
    rows = written(spark, rows, "nodes")
    discard(every)
    nodes = rows.where("id = node").select("id", "vec")
    n = nodes.count()
    if not n:
        return None
    best, best_recall = None, -1.0
    for _ in range(s.attempts):
        pairs = _pairs_once(spark, nodes, n, s)
        got = audit(spark, nodes, pairs, s)
        if got is None or got > best_recall:
            best, best_recall = pairs, got
        if got is None or got >= s.recall:
            break
        s = replace(s, overlap=s.overlap + 1, route=s.route + 0.04, beam=2 * s.beam)
    if best_recall is not None and best_recall < s.least:
        raise RuntimeError(f"the audit found a recall of {best_recall:.3f} among unequal vectors, under {s.least}")
    return Found(rows.select("id", "node", "copies"), best, best_recall)


def near_duplicates(spark: SparkSession, df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a vector: ``vec_id``, ``class_id`` (the least id that near pairs lead to), ``links`` and ``recall``.

    ``links`` counts the other vectors, copies too, whose cosine with this one, rounded to 6 places, is at least
    ``threshold``; see ``similar`` for how they are found. ``recall`` is the audited share of the true pairs among unequal
    vectors that was found, at least 0.9, and null where the audit met no true pair. Every vector is a query.

    Left out: null ids, null, empty, zero vectors and such with a null, NaN or infinity. Rows of one id are one vector, the
    greatest in array order. Only vectors of the most frequent length are compared (of equally frequent ones, the
    longest), others have no row. An empty table gives no row.
    """
    found = similar(spark, df, settings, id_col, vec_col)
    if found is None:
        return spark.createDataFrame([], CLASSES)
    nodes = found.rows.where("id = node").select(F.col("node").alias("partner"), "copies")
    both = found.pairs.select(F.col("id_a").alias("node"), F.col("id_b").alias("partner")).union(found.pairs.select("id_b", "id_a"))
    links = both.join(nodes, "partner").groupBy("node").agg(F.sum("copies").alias("others"))
    classes = components(spark, found.pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "classes").withColumnRenamed("id", "node")
    known = links.join(classes, "node", "left")  # of nodes that have a partner
    rows = found.rows.join(known, "node", "left")
    return rows.select(
        F.col("id").alias("vec_id"), F.coalesce("root", "node").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.lit(found.recall).cast("double").alias("recall")
    )
