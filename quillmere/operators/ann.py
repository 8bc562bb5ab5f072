"""Vector search: exact, inverted lists over clusters, closure replication, quantized scan and rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rabitq, vector

DISTANCES = {"l2": vector.l2sq, "ip": vector.neg_ip, "cosine": vector.neg_cosine}


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def exact(vectors: DataFrame, query: Column, k: int | None = None, metric: str = "l2") -> DataFrame:
    """``row_id``, ``dist``: all rows, or the ``k`` nearest (equal distances by row id), by a scan without a shuffle of vectors."""
    rows = vectors.select("row_id", DISTANCES[metric](F.col("vec"), query).alias("dist"))
    return rows if k is None else rows.orderBy("dist", "row_id").limit(k)


def packed(centroids: DataFrame) -> DataFrame:
    """All centroids (``cid``, ``centroid``) in one row, to be sent to every executor: their number is a build parameter."""
    return F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("cid", "centroid"))).alias("centroids")))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``row_id``, ``vec``, ``cid``, ``dist``: the nearest centroid (equal ones by number). No shuffle."""
    best = F.array_min(F.transform("centroids", lambda c: F.struct(vector.l2sq(F.col("vec"), c["centroid"]).alias("dist"), c["cid"].alias("cid"))))
    return vectors.crossJoin(packed(centroids)).select("row_id", "vec", best.alias("b")).select("row_id", "vec", "b.cid", "b.dist")


def closure(vectors: DataFrame, centroids: DataFrame, epsilon: float = 10.0, replicas: int = 8, rng: bool = True) -> DataFrame:
    """``row_id``, ``cid``, ``dist``: the clusters that hold a vector, up to ``replicas``.

    In order of squared distance, a centroid is taken while it is at most ``1 + epsilon`` times as far as the nearest;
    with ``rng``, only if it is no nearer to the centroid before it in that order (taken or not) than to the vector.
    All inside the row, so nothing is shuffled.
    """
    order = F.array_sort(F.transform("centroids", lambda c: F.struct(vector.l2sq(F.col("vec"), c["centroid"]).alias("dist"), c["cid"].alias("cid"), c["centroid"].alias("centroid"))))
    rows = vectors.crossJoin(packed(centroids)).select("row_id", order.alias("o"))
    if rng:
        rows = rows.withColumn("t", F.filter("o", lambda x, i: (i == 0) | (x["dist"] <= vector.l2sq(F.get(F.col("o"), i - 1)["centroid"], x["centroid"]))))
    else:
        rows = rows.withColumn("t", F.col("o"))
    near = F.slice(F.filter("t", lambda x: x["dist"] <= (1 + epsilon) * F.col("o")[0]["dist"]), 1, replicas)
    return rows.select("row_id", F.explode(near).alias("x")).select("row_id", "x.cid", "x.dist")


def replication(assigned: DataFrame) -> DataFrame:
    """Entries a row: 1 where there are none."""
    return assigned.agg(F.coalesce(F.count("*") / F.nullif(F.count_distinct("row_id"), F.lit(0)), F.lit(1.0)).alias("factor"))


def probe(centroids: DataFrame, query: Column, n: int) -> DataFrame:
    """The ``n`` nearest centroids."""
    return centroids.select("cid", vector.l2sq(F.col("centroid"), query).alias("dist")).orderBy("dist", "cid").limit(n)


def ivf(assigned: DataFrame, centroids: DataFrame, query: Column, probes: int, k: int, metric: str = "l2", deletes: DataFrame | None = None) -> DataFrame:
    """Exact distances in the nearest clusters only; a row in several of them counts once; deleted rows are left out of the result."""
    rows = assigned.join(F.broadcast(probe(centroids, query, probes).select("cid")), "cid", "left_semi")
    found = rows.select("row_id", DISTANCES[metric](F.col("vec"), query).alias("dist")).groupBy("row_id").agg(F.min("dist").alias("dist"))
    if deletes is not None:
        found = found.join(deletes.select("row_id"), "row_id", "left_anti")
    return found.orderBy("dist", "row_id").limit(k)


def rerank(candidates: DataFrame, vectors: DataFrame, query: Column, k: int, metric: str = "l2") -> DataFrame:
    """Candidates by exact distance."""
    return exact(vectors.join(candidates.select("row_id"), "row_id", "left_semi"), query, k, metric)


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """``cid``, ``dim``, ``mean``, ``n``: coordinate means of each cluster, added up before they are shuffled."""
    return assigned.select("cid", F.posexplode("vec").alias("dim", "x")).groupBy("cid", "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def seeds(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Places of ``k`` rows by k-means++: each with a chance that grows with its squared distance from those before; any, if all are 0."""
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(x)))]
    apart = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        total = apart.sum()
        chosen.append(int(draw.choice(len(x), p=apart / total) if total > 0 else draw.choice(np.setdiff1d(np.arange(len(x)), chosen))))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def kmeans(vectors: DataFrame, k: int, rounds: int = 10, seed: int = 0, sample: int = 64) -> DataFrame:
    """``cid``, ``centroid``: k-means++ seeds from at most ``sample * k`` rows (chosen by a hash), then Lloyd rounds over all rows.

    Sums are made inside the partitions. A cluster that gets no row takes the row that is farthest from its own centroid
    (equal ones by row id), so none is empty while there are distinct rows enough. ``k`` centroids are held by the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("row_id").cast("long").alias("row_id"), F.col("vec").cast("array<double>").alias("vec"))
    matrix = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
    drawn = rows.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(sample * k).toArrow().column("vec").combine_chunks()
    if not len(drawn):
        return spark.createDataFrame([], "cid int, centroid array<double>")
    x = matrix(drawn)
    centres = x[seeds(x, k, seed)]
    k, dims = centres.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, total, count, far = shared.value, np.zeros((k, dims)), np.zeros(k, np.int64), []
            for b in (batch.slice(a, 2048) for batch in batches for a in range(0, batch.num_rows, 2048)):
                y, ids = matrix(b.column("vec")), b.column("row_id").to_numpy()
                d = (y * y).sum(axis=1)[:, None] - 2 * y @ now.T + (now * now).sum(axis=1)
                own = d.argmin(axis=1)
                np.add.at(total, own, y)
                count += np.bincount(own, minlength=k)
                far += [(-float(d[i, own[i]]), int(ids[i]), y[i]) for i in np.lexsort((ids, -d[np.arange(len(y)), own]))[:k]]
                far = sorted(far, key=lambda f: f[:2])[:k]
            have = np.flatnonzero(count)
            out = [(int(c), int(count[c]), 0.0, 0, total[c]) for c in have] + [(-1, 0, -f[0], f[1], f[2]) for f in far]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=["cid", "n", "dist", "row_id", "vec"])

        parts = rows.mapInArrow(sums, "cid long, n long, dist double, row_id long, vec array<double>").persist()
        each = parts.where("cid >= 0").select("cid", "n", F.posexplode("vec")).groupBy("cid", "pos").agg(F.sum("col").alias("x"), F.sum("n").alias("n")).toPandas()
        new, count = np.zeros((k, dims)), np.zeros(k)
        new[each.cid, each.pos], count[each.cid] = each.x, each.n
        empty = np.flatnonzero(count == 0)
        new[count > 0] /= count[count > 0, None]
        if len(empty):
            far = [r.vec for r in parts.where("cid < 0").orderBy(F.desc("dist"), "row_id").limit(len(empty)).collect()]
            new[empty[: len(far)]] = far
            new[empty[len(far) :]] = centres[empty[len(far) :]]
        parts.unpersist()
        if np.array_equal(new, centres):
            break
        centres = new
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cid int, centroid array<double>")


def medoid(vectors: DataFrame) -> DataFrame:
    """The row nearest the coordinate mean."""
    mean = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    mean = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    rows = vectors.crossJoin(F.broadcast(mean)).select("row_id", vector.l2sq(F.col("vec"), F.col("mean")).alias("dist"))
    return rows.agg(F.min(F.struct("dist", "row_id")).alias("b")).select("b.row_id", "b.dist")


def encode(spark: SparkSession, assigned: DataFrame, centroids: DataFrame, descriptor: rabitq.Descriptor) -> DataFrame:
    """Quantized lists: ``cid``, ``row_id``, ``code``, factors and, above one bit, ``ex_code`` and its factors.

    Centroids and vectors are rotated, then residuals quantized, in Arrow batches.
    """
    rows = {r.cid: np.array(r.centroid, np.float64) for r in centroids.collect()}
    rotated = spark.sparkContext.broadcast({c: descriptor.rotate(v[None])[0] for c, v in rows.items()})
    extra = descriptor.bit_width - 1
    schema = "cid int, row_id long, code binary, f_add double, f_rescale double, f_error double, ex_code binary, f_add_ex double, f_rescale_ex double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = descriptor.rotate(b.column("vec").flatten().to_numpy().reshape(b.num_rows, -1))
            c = np.array([rotated.value[i] for i in b.column("cid").to_pylist()])
            one = rabitq.quantize_one_bit(x, c, descriptor.metric)
            n = b.num_rows
            ex = rabitq.quantize_ex(x, c, extra, descriptor.metric) if extra else {"ex_code": np.zeros((n, 0), np.uint8), "f_add_ex": np.zeros(n), "f_rescale_ex": np.zeros(n)}
            columns = [b.column("cid").cast(pa.int32()), b.column("row_id").cast(pa.int64()), pa.array([r.tobytes() for r in one["code"]])]
            columns += [pa.array(one[f]) for f in ("f_add", "f_rescale", "f_error")]
            columns += [pa.array([r.tobytes() for r in ex["ex_code"]], pa.binary()), pa.array(ex["f_add_ex"]), pa.array(ex["f_rescale_ex"])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return assigned.select("cid", "row_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, schema)


def scan(spark: SparkSession, codes: DataFrame, centroids: DataFrame, descriptor: rabitq.Descriptor, query: list[float], probes: int) -> DataFrame:
    """``row_id``, ``estimate``, ``lower_bound``, ``upper_bound`` of the rows in the nearest clusters, the best of each row.

    The clusters are chosen on the driver from the centroids, so that a store partitioned by ``cid`` reads only theirs.
    """
    q = np.array(query, np.float64)
    rows = {r.cid: np.array(r.centroid, np.float64) for r in centroids.collect()}
    chosen = sorted(rows, key=lambda c: (((q - rows[c]) ** 2).sum() if descriptor.metric == "l2" else -(q @ rows[c]), c))[:probes]
    rotated = {c: descriptor.rotate(rows[c][None])[0] for c in chosen}
    rq, extra = descriptor.rotate(q[None])[0], descriptor.bit_width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids = b.column("cid").to_numpy()
            for c in np.unique(cids):
                part = b.filter(pa.array(cids == c))
                one = {"code": np.array([np.frombuffer(x, np.uint8) for x in part.column("code").to_pylist()])} | {f: part.column(f).to_numpy() for f in ("f_add", "f_rescale", "f_error")}
                if extra:
                    ex = {"ex_code": np.array([np.frombuffer(x, np.uint8) for x in part.column("ex_code").to_pylist()])} | {f: part.column(f).to_numpy() for f in ("f_add_ex", "f_rescale_ex")}
                    found = rabitq.estimate_boosted(one, ex, extra, rq, rotated[int(c)], descriptor.metric)
                else:
                    found = rabitq.estimate(one, rq, rotated[int(c)], descriptor.metric)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), *map(pa.array, found)], names=["row_id", "estimate", "lower_bound", "upper_bound"])

    rows_in = codes.where(F.col("cid").isin(*chosen))
    found = rows_in.mapInArrow(run, "row_id long, estimate double, lower_bound double, upper_bound double")
    return found.groupBy("row_id").agg(F.min(F.struct("estimate", "lower_bound", "upper_bound")).alias("e")).select("row_id", "e.*")
