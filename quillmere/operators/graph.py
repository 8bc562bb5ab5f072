"""Proximity graphs: build, search, block layout and reachability.

A walk goes from node to node, so it can't be spread over hops: graphs are built and searched whole inside a shard,
and shards and queries are what runs side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir


def _apart(x: np.ndarray, rows, q: np.ndarray) -> np.ndarray:
    return ((x[rows] - q) ** 2).sum(axis=-1)


def greedy_search(x: np.ndarray, graph: list, start: int, q: np.ndarray, k: int, width: int) -> tuple[list[int], list[int], int]:
    """The ``k`` nearest met, the nodes in the order they were expanded, and how many were fetched: a node that was dropped and comes back counts again."""
    pool, done, order, fetched = [(float(_apart(x, start, q)), start)], set(), [], 1
    while True:
        nxt = next((p for p in pool if p[1] not in done), None)
        if nxt is None:
            return [i for _, i in pool[:k]], order, fetched
        done.add(nxt[1])
        order.append(nxt[1])
        held = {i for _, i in pool}
        fresh = list(dict.fromkeys(int(j) for j in graph[nxt[1]] if j not in held))
        if fresh:
            fetched += len(fresh)
            pool = heapq.nsmallest(width, pool + list(zip(_apart(x, fresh, q).tolist(), fresh)))


def greedy_walks(x: np.ndarray, graph: list, start: int, queries: np.ndarray, k: int, width: int, block: int = 256) -> list[tuple[list[int], int, int]]:
    """``greedy_search`` of many queries side by side: the nodes found, how many were expanded and how many fetched, query by query.

    Every step takes each query's nearest node that isn't expanded, so the steps of a block are as many as its longest walk.
    """
    n = len(x)
    degree = max(1, max(map(len, graph), default=1))
    edges = np.full((n + 1, degree), n, np.int64)  # n stands for no node
    for i, g in enumerate(graph):
        own = list(dict.fromkeys(map(int, g)))
        edges[i, : len(own)] = own
    padded = np.vstack([x, np.full((1, x.shape[1]), np.inf)])
    out = []
    for a in range(0, len(queries), block):
        q = np.asarray(queries[a : a + block], np.float64)
        m = len(q)
        ids, dist = np.full((m, width), n, np.int64), np.full((m, width), np.inf)
        ids[:, 0], dist[:, 0] = start, ((q - x[start]) ** 2).sum(axis=1)
        done = np.zeros((m, n + 1), bool)
        done[:, n] = True
        hops, fetched = np.zeros(m, np.int64), np.ones(m, np.int64)
        live = np.arange(m)
        while len(live):
            waits = ~np.take_along_axis(done[live], ids[live], axis=1)
            some = waits.any(axis=1)
            live, waits = live[some], waits[some]
            if not len(live):
                break
            node = ids[live, waits.argmax(axis=1)]
            done[live, node] = True
            hops[live] += 1
            near = edges[node]
            near = np.where((near[:, :, None] == ids[live][:, None, :]).any(axis=2), n, near)  # nodes that are held
            fetched[live] += (near < n).sum(axis=1)
            apart = np.where(near < n, ((padded[np.minimum(near, n - 1)] - q[live, None]) ** 2).sum(axis=2), np.inf)
            both, far = np.concatenate([ids[live], near], axis=1), np.concatenate([dist[live], apart], axis=1)
            order = np.lexsort((both, far), axis=1)[:, :width]
            ids[live], dist[live] = np.take_along_axis(both, order, axis=1), np.take_along_axis(far, order, axis=1)
        out += [([i for i in row[:k].tolist() if i < n], int(h), int(f)) for row, h, f in zip(ids, hops, fetched)]
    return out


def shard_count(n: int) -> int:
    """How many shards ``n`` rows are cut into, so that every query can walk every shard: of 250 rows each up to 64 shards, which then grow to 50,000 rows each."""
    return max(1, min(n // 250, 64), -(-n // 50_000))


def robust_prune(x: np.ndarray, node: int, candidates, degree: int, alpha: float) -> list[int]:
    """Nearest first (equal ones by number); each choice drops the candidates that are ``alpha`` times nearer to it than to the node. Distances are squared, and so is alpha."""
    rest = np.array(sorted(set(map(int, candidates)) - {node}), np.int64)
    own = _apart(x, rest, x[node])
    order = np.lexsort((rest, own))
    rest, own, out = rest[order], own[order], []
    while len(rest) and len(out) < degree:
        best = int(rest[0])
        out.append(best)
        keep = alpha * alpha * _apart(x, rest, x[best]) > own
        keep[0] = False
        rest, own = rest[keep], own[keep]
    return out


def medoid(x: np.ndarray) -> int:
    return int(_apart(x, slice(None), x.mean(axis=0)).argmin())


def build(x: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, seed: int = 0) -> tuple[list[list[int]], int]:
    """A graph over all rows and its entry: random edges first, then two passes, with alpha 1 and ``alpha``."""
    n = len(x)
    draw = np.random.default_rng(seed)
    graph = [[int(j) for j in draw.permutation(n)[: degree + 1] if j != i][:degree] for i in range(n)]
    start = medoid(x) if n else 0
    for a in (1.0, alpha):
        for i in draw.permutation(n):
            i = int(i)
            _, met, _ = greedy_search(x, graph, start, x[i], 1, width)
            graph[i] = robust_prune(x, i, met + graph[i], degree, a)
            for j in graph[i]:
                if i not in graph[j]:
                    graph[j].append(i)
                    if len(graph[j]) > degree:
                        graph[j] = robust_prune(x, j, graph[j], degree, a)
    return graph, start


def build_shards(vectors: DataFrame, degree: int = 16, width: int = 32, alpha: float = 1.2, seed: int = 0) -> DataFrame:
    """``shard``, ``node``, ``vec``, ``neighbors``, ``entry`` from ``shard``, ``row_id``, ``vec``: a graph for each shard."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", ignore_index=True)
        graph, start = build(np.stack(pdf.vec.to_numpy()).astype(float), degree, width, alpha, seed)
        ids = pdf.row_id.to_numpy()
        return pd.DataFrame({"shard": pdf.shard, "node": ids, "vec": pdf.vec, "neighbors": [ids[g] for g in graph], "entry": ids[start]})

    return vectors.select("shard", "row_id", F.col("vec").cast("array<double>").alias("vec")).groupBy("shard").applyInPandas(one, "shard long, node long, vec array<double>, neighbors array<long>, entry long")


def search_shards(nodes: DataFrame, queries: DataFrame | pd.DataFrame, k: int, width: int, deletes: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """``query_id``, ``row_id``, ``dist``: every query walks every shard's graph; the best of all shards are kept.

    Walks pass through rows of ``deletes``, which then take no place. ``shards`` is their number where it is known.
    """
    from pyspark.sql import Window as W

    if isinstance(queries, pd.DataFrame):
        queries = nodes.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(queries.query_id, queries.vec)], "query_id long, vec array<double>")
    shards = shards or (nodes.agg(F.max("shard")).first()[0] or 0) + 1
    asks = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("at"))
    if deletes is None:
        rows = nodes.withColumn("gone", F.lit(False))
    else:
        rows = nodes.join(deletes.select(F.col("row_id").alias("node"), F.lit(True).alias("gone")).distinct(), "node", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))

    def one(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(pdf):
            pdf = pdf.sort_values("node", ignore_index=True)
            x, ids, gone = np.stack(pdf.vec.to_numpy()), pdf.node.to_numpy(), pdf.gone.to_numpy()
            graph = [np.searchsorted(ids, g) for g in pdf.neighbors]
            start = int(np.searchsorted(ids, pdf.entry[0]))
            walks = greedy_walks(x, graph, start, np.stack(asked.asked.to_numpy()), max(k, width), width) if len(asked) else []
            for name, q, (met, _, _) in zip(asked.query_id, asked.asked, walks):
                met = [i for i in met if not gone[i]][:k]
                found += [(name, ids[i], d) for i, d in zip(met, _apart(x, met, q).tolist())]
        return pd.DataFrame(found, columns=["query_id", "row_id", "dist"])

    rows = rows.select(F.col("shard").cast("long").alias("shard"), "node", "vec", "neighbors", "entry", "gone")
    found = rows.groupBy("shard").cogroup(asks.groupBy("at")).applyInPandas(one, "query_id long, row_id long, dist double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "row_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


class StoredGraph:
    """Graphs of shards, stored: ``nodes`` (shard, slot, row_id, vec, edges as slots, entry) sorted by shard and slot, and ``directory`` (row_id, shard, slot)."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    @property
    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    @staticmethod
    def save(nodes: DataFrame, path: str, block: int = 16) -> StoredGraph:
        """Store what ``build_shards`` gives, each shard laid out in blocks of neighbours (``bnf``); its shards are places by hash or number, from 0."""

        def lay_out(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node", ignore_index=True)
            ids = pdf.node.to_numpy()
            local = [np.searchsorted(ids, g).tolist() for g in pdf.neighbors]
            slots = np.array(bnf(local, block))
            return pd.DataFrame({"shard": pdf.shard, "slot": slots, "row_id": ids, "vec": pdf.vec, "edges": [slots[g] if len(g) else [] for g in local], "entry": slots[np.searchsorted(ids, pdf.entry[0])]})

        out = StoredGraph(nodes.sparkSession, path)
        rows = nodes.select("shard", "node", "vec", "neighbors", "entry").groupBy("shard").applyInPandas(lay_out, "shard long, slot long, row_id long, vec array<double>, edges array<long>, entry long")
        rows.sortWithinPartitions("shard", "slot").write.parquet(f"{path}/nodes")
        out.nodes.select("row_id", "shard", "slot").hint("rebalance", "row_id").sortWithinPartitions("row_id").write.parquet(f"{path}/directory")
        return out

    def search(self, queries: DataFrame, k: int, width: int, start_row_id: int | None = None) -> DataFrame:
        """``query_id``, ``shard``, ``row_id``, ``dist``, ``hops``, ``fetches``: each query's walk over each shard's stored records, from its entry or from a row's slot, which the directory tells."""
        seed = None if start_row_id is None else self.directory.where(F.col("row_id") == start_row_id).first()
        if start_row_id is not None and seed is None:
            raise KeyError(f"no node has row id {start_row_id}")
        rows = self.nodes if seed is None else self.nodes.where(F.col("shard") == seed.shard)
        shards = [seed.shard] if seed else list(range(self.nodes.agg(F.max("shard")).first()[0] + 1))
        asks = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("asked"), F.explode(F.sequence(F.lit(shards[0]).cast("long"), F.lit(shards[-1]).cast("long"))).alias("at"))

        def walk(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(pdf):
                pdf = pdf.sort_values("slot", ignore_index=True)
                x, ids, edges = np.stack(pdf.vec.to_numpy()), pdf.row_id.to_numpy(), pdf.edges.to_list()
                start = int(pdf.entry[0]) if seed is None else int(seed.slot)
                walks = greedy_walks(x, edges, start, np.stack(asked.asked.to_numpy()), k, width) if len(asked) else []
                for name, q, (met, hops, fetched) in zip(asked.query_id, asked.asked, walks):
                    found += [(name, pdf.shard[0], ids[i], d, hops, fetched) for i, d in zip(met, _apart(x, met, q).tolist())]
            return pd.DataFrame(found, columns=["query_id", "shard", "row_id", "dist", "hops", "fetches"])

        return rows.groupBy("shard").cogroup(asks.groupBy("at")).applyInPandas(walk, "query_id long, shard long, row_id long, dist double, hops long, fetches long")


def bnp(graph: list, block: int) -> list[int]:
    """The slot of every node when blocks are filled in order of number, each node with its neighbours while there is room."""
    slots, used = [-1] * len(graph), 0
    for u, edges in enumerate(graph):
        if slots[u] >= 0:
            continue
        slots[u], used = used, used + 1
        for v in edges:
            if used % block == 0:
                break
            if slots[v] < 0:
                slots[v], used = used, used + 1
    return slots


def overlap_ratio(graph: list, slots: list[int], block: int) -> float:
    """Mean share of a node's block that its edges reach; a node alone in its block has 0."""
    n = len(graph)
    total = 0.0
    for u, edges in enumerate(graph):
        b = slots[u] // block
        size = min(block, n - b * block)
        if size > 1:
            total += sum(slots[v] // block == b for v in edges) / (size - 1)
    return total / n if n else 0.0


def bnf(graph: list, block: int, rounds: int = 8, least_gain: float = 0.001) -> list[int]:
    """From ``bnp``, move every node to the block with most of its neighbours that has room (equal ones by number), a round at a time; the best layout met."""
    n = len(graph)
    blocks = max(1, -(-n // block))
    slots = bnp(graph, block)
    own = [s // block for s in slots]
    best, best_ratio = slots, overlap_ratio(graph, slots, block)
    last = best_ratio
    for _ in range(max(1, rounds)):
        filled: list[list[int]] = [[] for _ in range(blocks)]
        for u, edges in enumerate(graph):
            votes: dict[int, int] = {}
            for v in edges:
                votes[own[v]] = votes.get(own[v], 0) + 1
            wanted = sorted(votes, key=lambda b: (-votes[b], b))
            home = next((b for b in wanted if len(filled[b]) < block), None)
            if home is None:
                home = next(b for b in range(blocks) if len(filled[b]) < block)
            filled[home].append(u)
        order = [u for members in filled for u in members]
        slots = [0] * n
        for s, u in enumerate(order):
            slots[u] = s
        for b, members in enumerate(filled):
            for u in members:
                own[u] = b
        ratio = overlap_ratio(graph, slots, block)
        if ratio > best_ratio:
            best, best_ratio = slots, ratio
        gain, last = ratio - last, ratio
        if gain < least_gain:
            break
    return best


def overlap(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """``overlap_ratio`` of a table of edges (``src``, ``dst``) under ``layout`` (``node``, ``block``)."""
    sizes = layout.groupBy("block").agg(F.count("*").alias("size"))
    inside = edges.join(layout.select(F.col("node").alias("src"), F.col("block").alias("b1")), "src").join(layout.select(F.col("node").alias("dst"), F.col("block").alias("b2")), "dst")
    hits = inside.where("b1 = b2").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("hits"))
    rows = layout.join(hits, "node", "left").join(sizes, "block")
    share = F.when(F.col("size") > 1, F.coalesce("hits", F.lit(0)) / (F.col("size") - 1)).otherwise(0.0)
    return rows.agg(F.coalesce(F.avg(share), F.lit(0.0)).alias("overlap"))


def reachable(edges: DataFrame, start: int) -> DataFrame:
    """``node``: all that can be reached from ``start``; a round for each step outward, each ended by a checkpoint."""
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    seen = front = spark.createDataFrame([(start,)], "node long")
    while True:
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.union(front).checkpoint()
