import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmere import registry
from quillmere.functions import rabitq
from quillmere.operators import ann, fusion, graph, search, vector_index
from quillmere.operators.index import doc_lengths, postings

DATA = os.environ.get("QUILLMERE_TESTDATA", "/root/testdata/sf0.001")
X = np.array([[4, -8, 14, 2, -6, 8, -1, 16]]) / 4
C = np.array([1, -2, 4, 2, -2, 3, 0, 6]) / 2


def test_one_bit_numbers():
    a, b = rabitq.quantize_one_bit(X, C), rabitq.quantize_one_bit(X, C, "ip")
    assert a["code"].tolist() == [[0xA5]] == b["code"].tolist()
    assert np.allclose([a["f_add"][0], a["f_rescale"][0], a["f_error"][0]], [20.095108, -3.6956523, 1.7686613], atol=1e-4)
    assert np.allclose([b["f_add"][0], b["f_rescale"][0], b["f_error"][0]], [0.3913045, -1.8478261, 0.8843306], atol=1e-4)
    x, c = np.array([[(i - 8) * 0.37 for i in range(16)]]), np.array([(i - 5) * 0.21 for i in range(16)])
    q = rabitq.quantize_one_bit(x, c)
    assert q["code"].tolist() == [[0, 15]] and np.allclose([q["f_add"][0], q["f_rescale"][0], q["f_error"][0]], [31.530863, -5.020838, 2.85029], atol=1e-3)


def test_multi_bit_numbers():
    a, b = rabitq.quantize_ex(X, C, 2), rabitq.quantize_ex(X, C, 2, "ip")
    assert "".join(map(str, a["ex_code"][0])) == "11322132" == "".join(map(str, b["ex_code"][0]))
    assert np.allclose([a["f_add_ex"][0], a["f_rescale_ex"][0], b["f_add_ex"][0], b["f_rescale_ex"][0]], [21.20035, -0.7943925, 0.9439252, -0.3971963], atol=1e-4)


def test_a_vector_on_its_centre_is_finite():
    for metric in rabitq.METRICS:
        q = rabitq.quantize_one_bit(C[None], C, metric)
        assert np.isfinite([q["f_add"][0], q["f_rescale"][0], q["f_error"][0]]).all() and q["f_error"][0] == 0
        assert rabitq.quantize_ex(C[None], C, 3, metric)["f_rescale_ex"][0] == 0


@pytest.mark.parametrize("d", [rabitq.Descriptor.fht(64), rabitq.Descriptor.fht(100), rabitq.Descriptor.matrix(48)])
def test_rotation_keeps_products(d):
    x = np.random.default_rng(1).standard_normal((20, d.dims))
    assert np.allclose(d.rotate(x) @ d.rotate(x).T, x @ x.T, atol=1e-4) and d.rotate(x).shape[1] == d.padded


@pytest.mark.parametrize("bits", [1, 3, 5])
@pytest.mark.parametrize("metric", rabitq.METRICS)
def test_bounds_hold_and_more_bits_are_nearer(bits, metric):
    draw = np.random.default_rng(bits)
    d = rabitq.Descriptor.fht(64, metric, bits)
    x, c = d.rotate(draw.standard_normal((2000, 64))), d.rotate(draw.standard_normal((1, 64)) * 0.1)[0]
    q = d.rotate(draw.standard_normal((1, 64)))[0]
    one = rabitq.quantize_one_bit(x, c, metric)
    found = rabitq.estimate(one, q, c, metric) if bits == 1 else rabitq.estimate_boosted(one, rabitq.quantize_ex(x, c, bits - 1, metric), bits - 1, q, c, metric)
    true = ((x - q) ** 2).sum(axis=1) if metric == "l2" else 1 - x @ q  # the constant 1 of the inner product's factor stays in
    assert ((found[1] <= true) & (true <= found[2])).mean() > 0.9
    if bits > 1:
        assert np.abs(found[0] - true).mean() < np.abs(rabitq.estimate(one, q, c, metric)[0] - true).mean()


def test_shared_scale_is_close():
    t = rabitq.calibrate(64, 3)
    x = np.random.default_rng(3).standard_normal((50, 64))
    a, b = rabitq.quantize_ex(x, np.zeros(64), 3), rabitq.quantize_ex(x, np.zeros(64), 3, scale=t)
    assert np.abs(a["ex_code"].astype(int) - b["ex_code"]).max() <= 2


def test_descriptor_is_checked():
    for bad in ({"dims": 0}, {"dims": 8, "metric": "x"}, {"dims": 8, "bit_width": 9}, {"dims": 8, "payload": b"1"}):
        with pytest.raises(ValueError):
            rabitq.Descriptor(**bad)


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(0)
    centres = np.array([[np.cos(b * 13 + d) * 6 for d in range(24)] for b in range(10)])
    x = np.repeat(centres, 40, axis=0) + draw.standard_normal((400, 24)) * 0.3
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>").cache()
    return x, vecs, ann.kmeans(vecs, 10)


def test_recall_rises_with_probes(spark, clustered):
    x, vecs, centroids = clustered
    assigned = ann.assign(vecs, centroids)
    q = ann.literal(x[5])
    want = {r.row_id for r in ann.exact(vecs, q, 10).collect()}
    recalls = [len(want & {r.row_id for r in ann.ivf(assigned, centroids, q, p, 10).collect()}) for p in (1, 4, 10)]
    assert recalls == sorted(recalls) and recalls[-1] == 10


@pytest.mark.parametrize("bits", [1, 4])
def test_quantized_scan_then_rerank(spark, clustered, bits):
    x, vecs, centroids = clustered
    d = rabitq.Descriptor.fht(24, "l2", bits)
    codes = ann.encode(spark, ann.assign(vecs, centroids), centroids, d)
    found = ann.scan(spark, codes, centroids, d, x[7].tolist(), 10)
    assert found.count() == 400
    top = found.orderBy("estimate", "row_id").limit(60)
    best = [r.row_id for r in ann.rerank(top, vecs, ann.literal(x[7]), 10).orderBy("dist", "row_id").collect()]
    assert len(set(best) & {r.row_id for r in ann.exact(vecs, ann.literal(x[7]), 10).collect()}) >= 9


def test_closure_keeps_the_nearest_and_caps(spark, clustered):
    x, vecs, centroids = clustered
    rows = ann.closure(vecs, centroids, 10.0, 3, rng=False)
    assert rows.groupBy("row_id").count().agg(F.max("count")).first()[0] <= 3
    nearest = {r.row_id: r.cid for r in ann.assign(vecs, centroids).collect()}
    assert all(r.cid == nearest[r.row_id] for r in rows.groupBy("row_id").agg(F.min_by("cid", "dist").alias("cid")).collect())
    assert ann.replication(rows.where("false")).first().factor == 1.0


FIVE = np.array([[0, 0], [1, 0], [0, 1], [1, 1], [2, 2]], float)
EDGES = [[1, 2], [0, 3], [3, 0], [1, 4], [3]]


def test_walk_over_five_nodes():
    assert graph.greedy_search(FIVE, EDGES, 0, np.array([0.9, 0.1]), 1, 2) == ([1], [0, 1], 4)


def test_prune_drops_what_a_choice_covers():
    line = np.arange(5.0)[:, None]
    assert graph.robust_prune(line, 0, [1, 2, 3, 4, 0], 3, 1.0) == [1]
    assert graph.robust_prune(line, 0, [4, 3, 2, 1], 2, 3.0) == [1, 2]


def test_built_graph_has_bounded_degree_and_recall():
    x = np.random.default_rng(2).standard_normal((300, 16))
    edges, start = graph.build(x, 12, 30)
    assert max(map(len, edges)) <= 12 and all(i not in e for i, e in enumerate(edges))
    hits = 0
    for q in x[:40] + 0.01:
        true = set(np.argsort(((x - q) ** 2).sum(axis=1))[:5].tolist())
        hits += len(true & set(graph.greedy_search(x, edges, start, q, 5, 40)[0]))
    assert hits / 200 > 0.9


def test_walks_side_by_side_are_the_walks_one_by_one():
    draw = np.random.default_rng(8)
    x = draw.standard_normal((200, 6))
    x[50:60] = x[40:50]  # ties
    edges, start = graph.build(x, 8, 20)
    q = np.concatenate([draw.standard_normal((30, 6)), x[40:45]])
    for k, width in ((5, 12), (12, 12), (3, 300)):
        got = graph.greedy_walks(x, edges, start, q, k, width, block=16)
        want = [graph.greedy_search(x, edges, start, v, k, width) for v in q]
        assert got == [(met, len(order), fetched) for met, order, fetched in want]
    assert graph.greedy_walks(FIVE, EDGES, 0, np.array([[0.9, 0.1]]), 1, 2) == [([1], 2, 4)]
    assert graph.greedy_walks(np.array([[10, 0], [6, 0], [9, 9], [0, 0.5]], float), [[1, 2], [0, 2, 3], [], [2]], 0, np.zeros((1, 2)), 1, 2) == [([3], 3, 6)]


def test_walks_grow_no_faster_than_the_rows():
    assert [graph.shard_count(n) for n in (0, 100, 500, 2000, 16_000)] == [1, 1, 2, 8, 64]
    walks = [n // 50 * graph.shard_count(n) for n in (100_000, 600_000, 3_000_000)]
    assert walks[1] <= 6 * walks[0] and walks[2] <= 30 * walks[0]


def test_layouts_place_every_node_once():
    draw = np.random.default_rng(4)
    g = [draw.choice(50, 4, replace=False).tolist() for _ in range(50)]
    a, b = graph.bnp(g, 8), graph.bnf(g, 8)
    assert sorted(a) == sorted(b) == list(range(50))
    assert graph.overlap_ratio(g, b, 8) >= graph.overlap_ratio(g, a, 8)


def test_shards_search(spark):
    x = np.random.default_rng(5).standard_normal((200, 8))
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "row_id long, shard long, vec array<double>")
    nodes = graph.build_shards(rows, 10, 30)
    got = graph.search_shards(nodes, pd.DataFrame({"query_id": [0], "vec": [x[3]]}), 5, 40).collect()
    assert {r.row_id for r in got} == set(np.argsort(((x - x[3]) ** 2).sum(axis=1))[:5].tolist())


def test_reachable(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4)], "src long, dst long")
    assert sorted(r.node for r in graph.reachable(e, 0).collect()) == [0, 1, 2]


def test_fusion_order_and_ties(spark):
    rows = spark.createDataFrame([(0, r, i) for r, i in enumerate([1, 2, 3], 1)] + [(1, r, i) for r, i in enumerate([3, 1, 2], 1)], "ranking_id int, rank int, row_id long")
    assert [r.row_id for r in fusion.best(fusion.fuse(rows), 9).collect()] == [1, 3, 2]
    twice = rows.union(spark.createDataFrame([(0, 9, 1)], rows.schema))
    assert fusion.fuse(twice).where("row_id = 1").first().score == fusion.fuse(rows).where("row_id = 1").first().score
    with pytest.raises(Exception, match="has no k"):
        fusion.fuse(rows, spark.createDataFrame([(0, 60)], "ranking_id int, k int")).collect()


def test_hybrid_of_words_and_vectors(spark):
    texts = ["widget widget", "widget of many other words here", "one", "two", "three", "four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vecs = spark.createDataFrame([(i, [float(np.float32(s / 10))] * 64) for i, s in enumerate(map(int, "352146"))], "row_id long, vec array<double>")
    words = fusion.ranked(search.top(search.bm25(postings(docs), doc_lengths(docs), ["widget"]), 10), 0, F.desc("score"), "row_id")
    near = ann.exact(vecs, ann.literal([0.0] * 64), 10)
    want = sorted((64 * int(c) ** 2 / 100, i) for i, c in enumerate("352146"))
    assert [(round(r.dist, 2), r.row_id) for r in near.orderBy("dist").collect()] == want
    got = fusion.best(fusion.fuse(words.union(fusion.ranked(near, 1, "dist", "row_id"))), 6).collect()
    assert [r.row_id for r in got] == [0, 1, 3, 2, 4, 5]
    assert [round(r.score, 6) for r in got] == [0.032266, 0.031514, 0.016393, 0.016129, 0.015625, 0.015152]


def test_sql_functions(spark):
    from quillmere.functions import sql

    sql.register(spark)
    assert [round(x, 6) for x in spark.sql("SELECT bm25(3D, 41D, 1L, 4L, 40D), bm25_quantized(3D, 41L, 1L, 4L, 40D), l2sq(array(1D, 2D), array(3D, 5D)), neg_ip(array(1D, 2D), array(3D, 5D)), rrf(1L, 60L)").first()] == [0.601988, 0.859981, 13.0, -13.0, round(1 / 61, 6)]
    df = spark.createDataFrame([(X[0].tolist(), C.tolist())], "v array<double>, c array<double>")
    e = df.selectExpr("rabitq_encode(v, c) AS e", "v", "c")
    assert round(e.selectExpr("e.f_add").first()[0], 4) == 20.0951
    low, high = e.selectExpr("rabitq_estimate(e.code, e.f_add, e.f_rescale, e.f_error, v, c) AS x").selectExpr("x.lower_bound", "x.upper_bound").first()
    assert low <= 0.5 and high >= -0.5
    vectors = "array(array(0D,0D),array(1D,0D),array(0D,1D),array(1D,1D),array(2D,2D))"
    edges = "array(array(1,2),array(0,3),array(3,0),array(1,4),array(3))"
    assert [r.node for r in spark.sql(f"SELECT node FROM greedy_search({vectors}, {edges}, 0, array(0.9D, 0.1D), 1, 2)").collect()] == [1]


@pytest.fixture(scope="module")
def indexed(spark, clustered, tmp_path_factory):
    x, vecs, centroids = clustered
    return vector_index.VectorIndex.build(spark, str(tmp_path_factory.mktemp("vectors")), vecs, centroids, replicas=2, part=30)


def nearest_of_all(x, asked, k, leave_out=()):
    x = x.astype(np.float32).astype(float)
    out = {}
    for q in asked:
        d = ((x - x[q]) ** 2).sum(axis=1)
        out[q] = [i for i in np.lexsort((np.arange(len(x)), d)).tolist() if i != q and i not in leave_out][:k]
    return out


def places(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r.query_id, []).append(r.row_id)
    return out


def test_stored_index_searches_all_rows(spark, clustered, indexed):
    x, vecs, _ = clustered
    asked = vecs.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    names = range(0, 400, 50)
    want = nearest_of_all(x, names, 10)
    assert places(vector_index.exact(vecs, asked, 10, others=True)) == want
    assert indexed.lists().groupBy("row_id").count().where("count <> 2").count() == 0 and indexed._table("sizes").agg(F.max("parts")).first()[0] > 1
    assert places(indexed.search(asked, 10, probes=1.0, others=True)) == want
    gone = vecs.where("row_id % 3 = 0").select("row_id")
    assert places(indexed.search(asked, 10, probes=1.0, deletes=gone, others=True)) == nearest_of_all(x, names, 10, set(range(0, 400, 3)))
    assert places(indexed.search(asked, 500, probes=1.0)) == {q: [q, *n] for q, n in nearest_of_all(x, names, 400).items()}
    share = indexed.needed(vecs, 10)
    got = places(indexed.search(asked, 10, probes=share, others=True))
    assert 0 < share <= 1 and sum(len(set(got[q]) & set(want[q])) for q in names) >= 0.9 * 80
    assert vector_index.VectorIndex(spark, indexed.path).options == indexed.options and indexed.options.replicas == 2
    assert indexed.search(asked.where("false"), 10).collect() == []


@pytest.mark.parametrize("bits", [1, 4])
def test_stored_codes_keep_the_nearest(spark, clustered, tmp_path, bits):
    x, vecs, centroids = clustered
    ix = vector_index.VectorIndex.build(spark, str(tmp_path / "ix"), vecs, centroids, bits=bits)
    asked = vecs.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    found = ix.scan(asked, 11, probes=1.0)
    rows = found.collect()
    apart = ((x.astype(np.float32)[[r.query_id for r in rows]].astype(float) - x.astype(np.float32)[[r.row_id for r in rows]]) ** 2).sum(axis=1)
    inside = [r.lower_bound - 1e-6 <= d <= r.upper_bound + 1e-6 for r, d in zip(rows, apart)]
    assert np.mean(inside) > 0.9 and len(rows) < 8 * 400
    got, want = places(ix.rerank(found, vecs, asked, 10, others=True)), nearest_of_all(x, range(0, 400, 50), 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 80


def test_no_pair_of_the_scan_is_shuffled(spark, clustered, tmp_path):
    x, vecs, centroids = clustered
    ix = vector_index.VectorIndex.build(spark, str(tmp_path / "ix"), vecs, centroids, replicas=3)
    asked = vecs.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    found = ix.scan(asked, 11, probes=0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan  # the codes by row, and nothing after
    rows = [tuple(r) for r in found.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    key = lambda df: sorted((r.query_id, r.row_id, r.place, round(r.dist, 3)) for r in df.collect())
    assert key(ix.scan_rerank(asked, 10, 11, probes=0.5, others=True)) == key(ix.rerank(found, vecs, asked, 10, others=True))
    best = {}
    for q, r, e, *_ in rows:
        best.setdefault(q, []).append((e, r))
    got = {}
    for r in ix.scan_best(asked, 5, 11, probes=0.5).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.estimate, r.row_id))
    assert got == {q: sorted(b)[:5] for q, b in best.items()}
    gone = vecs.where("row_id % 3 = 0").select("row_id")
    assert not [r for r in ix.scan(asked, 11, probes=0.5, deletes=gone).collect() if r.row_id % 3 == 0]
    assert ix.scan(asked.where("false"), 11).collect() == [] and ix.scan(asked, 1000, probes=1.0).count() == 8 * 400


def test_probed_lists_are_pushed_to_the_scan(indexed):
    plan = indexed.lists([1, 2])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cid, [1,2])]" in plan or "PushedFilters: [In(cid" in plan


@pytest.mark.parametrize("name", ["v5_ivf", "j4_rerank", "o3_candidates_ranked", "p12_graph_deleted"])
def test_recall_over_every_50th_row(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    registry.load()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding.to_numpy())
    gone = set(range(0, len(x), 7)) if name == "p12_graph_deleted" else set()
    want = nearest_of_all(x, range(0, len(x), 50), 10, gone)
    got = {}
    for r in registry.QUERIES[name](spark, DATA).collect():
        got.setdefault(r.query_id, set()).add(r.row_id)
    assert set(got) == set(want) and sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 10 * len(want)


def test_kmeans_leaves_no_cluster_empty(spark):
    draw = np.random.default_rng(12)
    x = np.concatenate([np.zeros((300, 4)), np.eye(4) * 50, draw.standard_normal((20, 4)) * 0.01 + 9])
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>").repartition(3)
    centroids = ann.kmeans(vecs, 6, rounds=6)
    assert centroids.count() == 6 and ann.assign(vecs, centroids).select("cid").distinct().count() == 6
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "row_id long, vec array<double>")
    assert {tuple(r.centroid) for r in ann.kmeans(same, 3).collect()} == {(1.0, 2.0)}
    assert len(set(ann.seeds(np.ones((5, 2)), 3).tolist())) == 3 and ann.kmeans(same.where("false"), 3).collect() == []


def test_a_dropped_node_that_comes_back_is_fetched_again():
    x = np.array([[10, 0], [6, 0], [9, 9], [0, 0.5]], float)
    found, order, fetched = graph.greedy_search(x, [[1, 2], [0, 2, 3], [], [2]], 0, np.array([0.0, 0.0]), 1, 2)
    assert found == [3] and order == [0, 1, 3] and fetched == 6  # 0, 1, 2, 2 again, 3, 2 again


def test_stored_graph_walks_as_the_built_one(spark, clustered, tmp_path):
    x, vecs, _ = clustered
    nodes = graph.build_shards(vecs.where("row_id < 200").withColumn("shard", F.col("row_id") % 2), degree=8)
    stored = graph.StoredGraph.save(nodes, str(tmp_path / "g"))
    assert sorted((r.shard, r.slot) for r in stored.directory.collect()) == [(s, k) for s in (0, 1) for k in range(100)]
    asked = vecs.where("row_id % 50 = 0 and row_id < 200").withColumnRenamed("row_id", "query_id")
    rows = stored.search(asked, 5, 20).collect()
    held = {s: {r.node: r for r in nodes.where(F.col("shard") == s).collect()} for s in (0, 1)}
    for s, by_id in held.items():
        ids = sorted(by_id)
        y, g = np.array([by_id[i].vec for i in ids]), [[ids.index(j) for j in by_id[i].neighbors] for i in ids]
        for q in (0, 50, 100, 150):
            met, order, fetched = graph.greedy_search(y, g, ids.index(by_id[ids[0]].entry), x[q], 5, 20)
            own = [r for r in rows if r.shard == s and r.query_id == q]
            assert {r.row_id for r in own} == {ids[i] for i in met} and {(r.hops, r.fetches) for r in own} == {(len(order), fetched)}
    near = stored.search(asked.where("query_id = 50"), 1, 20, start_row_id=50).collect()
    assert [(r.row_id, r.shard) for r in near] == [(50, 0)]
    with pytest.raises(KeyError):
        stored.search(asked, 1, 5, start_row_id=999)


def test_indexes_merge(spark, clustered, tmp_path):
    x, vecs, centroids = clustered
    build = lambda name, rows: vector_index.VectorIndex.build(spark, str(tmp_path / name), rows, centroids, replicas=2)
    a, b, whole = build("a", vecs.where("row_id < 250")), build("b", vecs.where("row_id >= 250")), build("w", vecs)
    both = vector_index.VectorIndex.merged(spark, str(tmp_path / "ab"), [a, b])
    keys = lambda ix: sorted((r.cid, r.row_id, r.f_add) for r in ix.lists().collect())
    assert keys(both) == keys(whole) and both.options == whole.options
    few = centroids.where("cid < 5")
    moved = vector_index.VectorIndex.merged(spark, str(tmp_path / "m"), [a, b], few)
    assert {r.cid for r in moved.lists().select("cid").distinct().collect()} <= set(range(5)) and moved.lists().count() == 800
    with pytest.raises(ValueError):
        vector_index.VectorIndex.merged(spark, str(tmp_path / "x"), [a, moved])
