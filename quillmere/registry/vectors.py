"""Vector, graph and fusion queries over ``embeddings``.

Searches ask for every row whose id is divisible by 50, against all rows, over an index that is stored once a session and
folder. Its centroids are the first ceil(sqrt(n)) vectors, so that SQL can say the same; each vector is in the lists of its 4
nearest, and 3 in 10 lists are probed. Single steps (assignment, closure, factors) are shown with 16 fixed centroids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import rabitq, sql, vector
from ..operators import ann, fusion, graph, search, vector_index
from ..storage import new_folder
from . import lexical, query, table


def vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))


def centroids(spark, d):
    return vecs(spark, d).where("row_id < 16").select(F.col("row_id").alias("cid"), F.col("vec").alias("centroid"))


def asked(spark, d, row_id: int = 0):
    """One vector as a literal: a point lookup, pushed down to the scan."""
    return ann.literal(vecs(spark, d).where(F.col("row_id") == row_id).first().vec)


_STORED: dict[tuple[str, str, int], vector_index.VectorIndex] = {}


def stored(spark, d, bits: int = 1) -> vector_index.VectorIndex:
    key = (spark.sparkContext.applicationId, d, bits)
    if key not in _STORED:
        rows = vecs(spark, d)
        k = int(np.ceil(np.sqrt(rows.count())))
        first = rows.where(F.col("row_id") < k).select(F.col("row_id").alias("cid"), F.col("vec").alias("centroid"))
        _STORED[key] = vector_index.VectorIndex.build(spark, new_folder(spark, "vectors"), rows, first, bits=bits)
    return _STORED[key]


def every_50th(spark, d):
    return vecs(spark, d).where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "vec")


def rounded(found):
    return found.select("query_id", "row_id", F.round("dist", 6).alias("dist"), "place")


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


E0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
BASE = f"""WITH v AS (SELECT vec_id AS row_id, embedding AS vec FROM embeddings), c AS (SELECT vec_id AS cid, embedding AS centroid FROM embeddings WHERE vec_id < 16),
 q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"""
ASSIGN = BASE + f""", d AS (SELECT row_id, vec, cid, centroid, {l2('vec', 'centroid')} AS dist FROM v, c),
 a AS (SELECT row_id, arg_min(cid, (dist, cid)) AS cid, min(dist) AS dist FROM d GROUP BY row_id)"""


@query("s6_flat_vector", "SELECT vec_id AS row_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE vec_id = 7")
def _(spark, d):
    return vecs(spark, d).where("row_id = 7").select("row_id", F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double")), 6).alias("total"))


@query("f16_l2", BASE + f" SELECT row_id, round({l2('vec', 'qv')}, 6) AS dist FROM v, q")
def _(spark, d):
    return ann.exact(vecs(spark, d), asked(spark, d)).select("row_id", F.round("dist", 6).alias("dist"))


@query("f17_ip", BASE + f" SELECT row_id, round(-{ip('vec', 'qv')}, 6) AS dist FROM v, q")
def _(spark, d):
    return ann.exact(vecs(spark, d), asked(spark, d), metric="ip").select("row_id", F.round("dist", 6).alias("dist"))


@query("f18_cosine", BASE + f" SELECT row_id, round(-{ip('vec', 'qv')} / (sqrt({ip('vec', 'vec')}) * sqrt({ip('qv', 'qv')})), 6) AS dist FROM v, q")
def _(spark, d):
    return ann.exact(vecs(spark, d), asked(spark, d), metric="cosine").select("row_id", F.round("dist", 6).alias("dist"))


ASKED = "asked AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0)"
EXACT = f"SELECT query_id, row_id, {l2('vec', 'qv')} AS dist, row_number() OVER (PARTITION BY query_id ORDER BY {l2('vec', 'qv')}, row_id) AS place FROM v, asked WHERE row_id <> query_id"


@query("o7_exact_topk", BASE + f", {ASKED} SELECT query_id, row_id, round(dist, 6) AS dist, CAST(place AS INTEGER) AS place FROM ({EXACT}) WHERE place <= 10")
def _(spark, d):
    return rounded(vector_index.exact(vecs(spark, d), every_50th(spark, d), 10, others=True))


@query("j6_assign", ASSIGN + " SELECT row_id, cid, round(dist, 6) AS dist FROM a")
def _(spark, d):
    return ann.assign(vecs(spark, d), centroids(spark, d)).select("row_id", "cid", F.round("dist", 6).alias("dist"))


@query("a8_lloyd_step", ASSIGN + ", x AS (SELECT a.cid, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM a JOIN v USING (row_id)) SELECT cid, CAST(dim AS INTEGER) AS dim, round(avg(x::DOUBLE), 6) AS mean, count(*) AS n FROM x GROUP BY cid, dim")
def _(spark, d):
    rows = ann.assign(vecs(spark, d), centroids(spark, d)).withColumn("vec", F.col("vec").cast("array<double>"))
    return ann.lloyd_step(rows).select("cid", "dim", F.round("mean", 6).alias("mean"), "n")


@query("a9_inertia", ASSIGN + " SELECT round(sum(dist), 6) AS inertia FROM a")
def _(spark, d):
    return ann.assign(vecs(spark, d), centroids(spark, d)).agg(F.round(F.sum("dist"), 6).alias("inertia"))


@query("a10_medoid", BASE + f""", m AS (SELECT list(m ORDER BY dim) AS mean FROM (SELECT dim, avg(x::DOUBLE) AS m FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM v) GROUP BY dim))
SELECT row_id, round({l2('vec', 'mean')}, 6) AS dist FROM v, m ORDER BY {l2('vec', 'mean')}, row_id LIMIT 1""")
def _(spark, d):
    return ann.medoid(vecs(spark, d)).select("row_id", F.round("dist", 6).alias("dist"))


IVF = f"""WITH v AS (SELECT vec_id AS row_id, embedding AS vec FROM embeddings), {ASKED},
 size AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS k, ceil(0.3::DOUBLE * ceil(sqrt(count(*)))) AS probes FROM embeddings),
 c AS (SELECT vec_id AS cid, embedding AS centroid FROM embeddings, size WHERE vec_id < k),
 lists AS (SELECT row_id, cid FROM (SELECT row_id, cid, row_number() OVER (PARTITION BY row_id ORDER BY {l2('vec', 'centroid')}, cid) AS r FROM v, c) WHERE r <= 4),
 probed AS (SELECT query_id, cid, dist FROM (SELECT query_id, cid, {l2('qv', 'centroid')} AS dist, row_number() OVER (PARTITION BY query_id ORDER BY {l2('qv', 'centroid')}, cid) AS r FROM asked, c), size WHERE r <= probes),
 met AS (SELECT DISTINCT query_id, row_id FROM probed JOIN lists USING (cid)),
 near AS (SELECT query_id, row_id, {l2('vec', 'qv')} AS dist FROM met JOIN asked USING (query_id) JOIN v USING (row_id))"""


def _top(where: str = "true") -> str:
    return f"SELECT query_id, row_id, round(dist, 6) AS dist, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS place FROM near WHERE {where}) WHERE place <= 10"


@query("o2_nprobe", IVF + " SELECT query_id, cid, round(dist, 6) AS dist FROM probed")
def _(spark, d):
    ix = stored(spark, d)
    cids, centres = ix.centroids()
    rows = ix.probed(every_50th(spark, d), int(np.ceil(ix.options.probes * len(cids))))
    centroids = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(cids, centres)], "cid long, centroid array<double>")
    return rows.join(F.broadcast(centroids), "cid").select("query_id", "cid", F.round(vector.l2sq(F.col("asked"), F.col("centroid")), 6).alias("dist"))


@query("v5_ivf", IVF + _top("row_id <> query_id"))
def _(spark, d):
    return rounded(stored(spark, d).search(every_50th(spark, d), 10, others=True))


@query("p11_ann_deleted", IVF + _top("row_id <> query_id AND row_id % 7 <> 0"))
def _(spark, d):
    gone = vecs(spark, d).where("row_id % 7 = 0").select("row_id")
    return rounded(stored(spark, d).search(every_50th(spark, d), 10, deletes=gone, others=True))


@query("v8_recall", IVF + f""", e AS (SELECT * FROM ({EXACT}) WHERE place <= 10), g AS ({_top('row_id <> query_id')})
SELECT count(*) AS queries, round(avg(recall), 6) AS recall, min(recall) AS least FROM (SELECT e.query_id, count(g.row_id) / 10.0::DOUBLE AS recall FROM e LEFT JOIN g USING (query_id, row_id) GROUP BY 1)""")
def _(spark, d):
    """The share of each query's true 10 nearest that the index finds: mean and least over all queries."""
    q = every_50th(spark, d)
    found = stored(spark, d).search(q, 10, others=True).select("query_id", "row_id", F.lit(1).alias("met"))
    each = vector_index.exact(vecs(spark, d), q, 10, others=True).join(found, ["query_id", "row_id"], "left").groupBy("query_id").agg((F.count("met") / 10).alias("recall"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.min("recall").alias("least"))


CLOSURE = BASE + f""", d AS (SELECT row_id, cid, centroid, {l2('vec', 'centroid')} AS dist FROM v, c),
 o AS (SELECT *, row_number() OVER w AS rn, lag(centroid) OVER w AS prev, first_value(dist) OVER w AS d1 FROM d WINDOW w AS (PARTITION BY row_id ORDER BY dist, cid)),
 t AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, cid) AS k FROM o WHERE rn = 1 OR dist <= {l2('prev', 'centroid')}),
 r AS (SELECT row_id, cid, dist FROM t WHERE dist <= (1 + 0.2) * d1 AND k <= 8)"""


@query("j7_closure", CLOSURE + " SELECT row_id, cid, round(dist, 6) AS dist FROM r")
def _(spark, d):
    return ann.closure(vecs(spark, d), centroids(spark, d), 0.2, 8).select("row_id", "cid", F.round("dist", 6).alias("dist"))


@query("a11_replication", CLOSURE + " SELECT round(count(*) / count(DISTINCT row_id), 6) AS factor FROM r")
def _(spark, d):
    return ann.replication(ann.closure(vecs(spark, d), centroids(spark, d), 0.2, 8)).select(F.round("factor", 6).alias("factor"))


@query("a12_group", CLOSURE + " SELECT cid, count(*) AS n, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS members FROM r GROUP BY cid")
def _(spark, d):
    rows = ann.closure(vecs(spark, d), centroids(spark, d), 0.2, 8)
    return rows.groupBy("cid").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("row_id")).cast("array<string>"), ",").alias("members"))


FACTORS = ASSIGN + f""", r AS (SELECT a.row_id, centroid, list_transform(list_zip(vec, centroid), lambda z: z[1]::DOUBLE - z[2]::DOUBLE) AS r FROM a JOIN v USING (row_id) JOIN c USING (cid)),
 x AS (SELECT row_id, centroid, r, list_transform(r, lambda y: CASE WHEN y > 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS x FROM r),
 s AS (SELECT row_id, centroid, x, {ip('r', 'r')} AS l2, {ip('r', 'x')} AS along, {ip('centroid', 'x')} AS across FROM x),
 k AS (SELECT row_id, centroid, x, CASE WHEN along = 0 THEN 0.0::DOUBLE ELSE l2 + 2 * l2 * across / along END AS f_add, CASE WHEN along = 0 THEN 0.0::DOUBLE ELSE -2 * l2 / along END AS f_rescale,
  CASE WHEN along = 0 THEN 0.0::DOUBLE ELSE 2 * sqrt(l2) * 1.9 * sqrt(greatest((l2 * 16 / (along * along) - 1) / 63, 0)) END AS f_error FROM s)"""


def factors(spark, d):
    """One-bit codes (as centred signs) and factors by columns alone, unrotated."""
    cs = F.broadcast(centroids(spark, d))
    rows = ann.assign(vecs(spark, d), centroids(spark, d)).join(cs, "cid")
    rows = rows.withColumn("r", F.zip_with("vec", "centroid", lambda a, b: a.cast("double") - b.cast("double")))
    rows = rows.withColumn("x", F.transform("r", lambda y: F.when(y > 0, F.lit(0.5)).otherwise(F.lit(-0.5))))
    rows = rows.select("row_id", "centroid", "x", vector.dot(F.col("r"), F.col("r")).alias("l2"), vector.dot(F.col("r"), F.col("x")).alias("along"), vector.dot(F.col("centroid"), F.col("x")).alias("across"))
    l2_, along, across, zero = F.col("l2"), F.col("along"), F.col("across"), F.lit(0.0)
    guard = lambda value: F.when(along == 0, zero).otherwise(value)
    return rows.select(
        "row_id", "centroid", "x", guard(l2_ + 2 * l2_ * across / along).alias("f_add"), guard(-2 * l2_ / along).alias("f_rescale"),
        guard(2 * F.sqrt(l2_) * 1.9 * F.sqrt(F.greatest((l2_ * 16 / (along * along) - 1) / 63, zero))).alias("f_error"),
    )


@query("f33_factors", FACTORS + " SELECT row_id, round(f_add, 6) AS f_add, round(f_rescale, 6) AS f_rescale, round(f_error, 6) AS f_error FROM k")
def _(spark, d):
    return factors(spark, d).select("row_id", *[F.round(c, 6).alias(c) for c in ("f_add", "f_rescale", "f_error")])


@query("f37_estimate", FACTORS + f" SELECT row_id, round(f_add + {l2('qv', 'centroid')} + f_rescale * {ip('x', 'qv')}, 6) AS estimate, round(f_error * sqrt({l2('qv', 'centroid')}), 6) AS bound FROM k, q")
def _(spark, d):
    q = asked(spark, d)
    apart = vector.l2sq(q, F.col("centroid"))
    value = F.col("f_add") + apart + F.col("f_rescale") * vector.dot(F.col("x"), q)
    return factors(spark, d).select("row_id", F.round(value, 6).alias("estimate"), F.round(F.col("f_error") * F.sqrt(apart), 6).alias("bound"))


EDGES = "e AS (SELECT vec_id AS src, (vec_id * 3 + k * k) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings, (VALUES (1), (2), (3), (4)) t(k))"


def edges(spark, d):
    n = vecs(spark, d).count()
    ks = F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k")
    return vecs(spark, d).select(F.col("row_id").alias("src"), ks).select("src", F.expr(f"(src * 3 + k * k) % {n}").alias("dst"))


@query("a13_overlap", f"""WITH {EDGES}, s AS (SELECT vec_id // 16 AS block, count(*) AS size FROM embeddings GROUP BY 1),
 h AS (SELECT vec_id, size, (SELECT count(*) FROM e WHERE src = vec_id AND dst // 16 = vec_id // 16) AS hits FROM embeddings JOIN s ON vec_id // 16 = block)
SELECT round(avg(CASE WHEN size > 1 THEN hits / (size - 1) ELSE 0 END), 6) AS overlap FROM h""")
def _(spark, d):
    layout = vecs(spark, d).select(F.col("row_id").alias("node"), F.expr("row_id div 16").alias("block"))
    return graph.overlap(edges(spark, d), layout).select(F.round("overlap", 6).alias("overlap"))


@query("g8_reach", f"WITH RECURSIVE {EDGES}, r AS (SELECT 0::BIGINT AS node UNION SELECT dst FROM e JOIN r ON src = node) SELECT node FROM r")
def _(spark, d):
    return graph.reachable(edges(spark, d).where("src <> dst"), 0)


@query("j2_bitmap_join", "SELECT label, count(*) AS n FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'en' GROUP BY label")
def _(spark, d):
    english = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(english, "vec_id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


def by_distance(spark, d, ranking_id: int, row_id: int, k: int = 50):
    return fusion.ranked(ann.exact(vecs(spark, d), asked(spark, d, row_id), k), ranking_id, "dist", "row_id")


def _rank_sql(ranking_id: int, row_id: int, k: int = 50) -> str:
    q = f"(SELECT embedding FROM embeddings WHERE vec_id = {row_id})"
    return f"SELECT {ranking_id} AS ranking_id, vec_id AS row_id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM (SELECT vec_id, {l2('embedding', q)} AS dist FROM embeddings ORDER BY dist, vec_id LIMIT {k})"


@query("h1_rrf", f"SELECT row_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ({_rank_sql(0, 1)} UNION ALL {_rank_sql(1, 2)} UNION ALL {_rank_sql(2, 3)}) GROUP BY row_id")
def _(spark, d):
    rankings = by_distance(spark, d, 0, 1).union(by_distance(spark, d, 1, 2)).union(by_distance(spark, d, 2, 3))
    return fusion.fuse(rankings).select("row_id", F.round("score", 6).alias("score"))


@query("x6_sql_rrf", f"SELECT row_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ({_rank_sql(0, 1)} UNION ALL {_rank_sql(1, 2)}) GROUP BY row_id")
def _(spark, d):
    """The fusion as an SQL aggregate."""
    sql.register(spark)
    by_distance(spark, d, 0, 1).union(by_distance(spark, d, 1, 2)).createOrReplaceTempView("qm_rankings")
    return spark.sql("SELECT row_id, round(rrf_score(rank, 60), 6) AS score FROM qm_rankings GROUP BY row_id")


@query("h2_rrf_asym", f"SELECT row_id, round(sum(1.0::DOUBLE / (CASE ranking_id WHEN 0 THEN 10 ELSE 90 END + rank)), 6) AS score FROM ({_rank_sql(0, 1)} UNION ALL {_rank_sql(1, 2)}) GROUP BY row_id")
def _(spark, d):
    ks = spark.createDataFrame([(0, 10), (1, 90)], "ranking_id int, k int")
    return fusion.fuse(by_distance(spark, d, 0, 1).union(by_distance(spark, d, 1, 2)), ks).select("row_id", F.round("score", 6).alias("score"))


def hybrid(spark, d, keep=None):
    """BM25 top 100 and vector top 100 over the same row ids, fused."""
    words, near = lexical.scored(spark, d, ["of"]), ann.exact(vecs(spark, d), asked(spark, d))
    if keep is not None:
        words, near = words.where(keep), near.where(keep)
    a = fusion.ranked(search.top(words, 100), 0, F.desc("score"), "row_id")
    b = fusion.ranked(near.orderBy("dist", "row_id").limit(100), 1, "dist", "row_id")
    return fusion.best(fusion.fuse(a.union(b)), 10)


def _hybrid_sql(keep: str) -> str:
    scored = lexical._bm25_sql("p.term = 'of'").partition("WITH ")[2]
    return f"""(WITH {scored}, near AS (SELECT vec_id AS row_id, {l2('embedding', E0)} AS dist FROM embeddings),
 a AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM scored WHERE {keep} ORDER BY score DESC, row_id LIMIT 100),
 b AS (SELECT row_id, row_number() OVER (ORDER BY dist, row_id) AS rank FROM near WHERE {keep} ORDER BY dist, row_id LIMIT 100),
 f AS (SELECT row_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY row_id)
SELECT row_id, round(s, 6) AS score FROM f ORDER BY s DESC, row_id LIMIT 10)"""


@query("h3_hybrid", _hybrid_sql("true"))
def _(spark, d):
    return hybrid(spark, d).select("row_id", F.round("score", 6).alias("score"))


SWEEP = (1, 10, 100, 1000)


@query("p13_sweep", " UNION ALL ".join(f"SELECT {s} AS permille, * FROM {_hybrid_sql(f'row_id % 1000 < {s}')}" for s in SWEEP))
def _(spark, d):
    out = None
    for s in SWEEP:
        part = hybrid(spark, d, F.col("row_id") % 1000 < s).select(F.lit(s).alias("permille"), "row_id", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


# Without SQL: results that the writer's random choices decide; tests check their properties.


@query("v2_kmeans")
def _(spark, d):
    return ann.kmeans(vecs(spark, d), 16)


def candidates(spark, d, bits: int):
    """Rows whose bounds leave them among the 10 nearest of some query, out of the probed lists' codes."""
    return stored(spark, d, bits).scan(every_50th(spark, d), 11)  # the query's own row is one


@query("v4_rabitq_scan")
def _(spark, d):
    return candidates(spark, d, 1)


@query("f34_multibit")
def _(spark, d):
    return candidates(spark, d, 4)


@query("j4_rerank")
def _(spark, d):
    """The scan's candidates by exact distance."""
    return rounded(stored(spark, d).scan_rerank(every_50th(spark, d), 10, 11, others=True))


@query("f30_rotation")
def _(spark, d):
    descriptor = rabitq.Descriptor.fht(64)

    @F.pandas_udf("array<double>")
    def rotate(v: pd.Series) -> pd.Series:
        return pd.Series(list(descriptor.rotate(np.stack(v.to_numpy()))))

    return vecs(spark, d).select("row_id", rotate("vec").alias("rotated"))


@query("g3_vamana")
def _(spark, d):
    """A graph for each shard of about 250 vectors."""
    shards = F.greatest(F.lit(1), F.expr(f"{vecs(spark, d).count()} div 250"))
    rows = vecs(spark, d).withColumn("shard", F.pmod(F.xxhash64("row_id"), shards))
    return graph.build_shards(rows).select("shard", "node", "neighbors", "entry")


@query("g4_stored_graph")
def _(spark, d):
    """Walks over stored, laid-out shards, with their hops and fetches."""
    rows = vecs(spark, d)
    shards = graph.shard_count(rows.count())
    nodes = graph.build_shards(rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards))))
    return graph.StoredGraph.save(nodes, new_folder(spark, "graph")).search(every_50th(spark, d), 10, 32)


@query("g6_bnf")
def _(spark, d):
    """Nearest-neighbour edges laid out in blocks of 16, a shard at a time."""
    shards = F.greatest(F.lit(1), F.expr(f"{vecs(spark, d).count()} div 500"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", ignore_index=True)
        x = np.stack(pdf.vec.to_numpy()).astype(float)
        near = np.argsort(-(x @ x.T), axis=1, kind="stable")[:, 1:9].tolist()
        return pd.DataFrame({"shard": pdf.shard, "row_id": pdf.row_id, "slot": graph.bnf(near, 16)})

    rows = vecs(spark, d).withColumn("shard", F.pmod(F.xxhash64("row_id"), shards))
    return rows.groupBy("shard").applyInPandas(one, "shard long, row_id long, slot long")


@query("o3_candidates_ranked")
def _(spark, d):
    return stored(spark, d, 7).scan_best(every_50th(spark, d), 10, 11, others=True)
