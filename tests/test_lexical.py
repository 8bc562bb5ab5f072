import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import scoring, text
from quillmere.functions.porter2 import stem
from quillmere.operators import index, search
from quillmere.operators.index import Index

DOCS = [(0, "the dog runs in the park"), (1, "a cat sleeps on the mat"), (2, "the dog and the cat play in the park")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    ix = Index(spark, str(tmp_path_factory.mktemp("ix")))
    ix.add_field(docs, "body", text.ENGLISH)
    return ix


def ids(df):
    return sorted(r.row_id for r in df.collect())


STEMS = "run: run runs running | swim: swimming swim | quick: quick quickly | whale: whale whales | relat: relational | generous: generously | happi: happy | hope: hoping | hop: hopping | sky: skies | die: dying | tie: ties | cri: cries | consist: consistency | knackeri: knackeries | is: is"


@pytest.mark.parametrize("word, want", [(w, part.split(":")[0].strip()) for part in STEMS.split("|") for w in part.split(":")[1].split()] + [("", ""), ("'", "'")])
def test_stem(word, want):
    assert stem(word) == want


def test_english_chain(spark):
    df = spark.createDataFrame([(0, "The whales swim quickly."), (1, None), (2, "")], "doc_id long, text string")
    got = [(r.row_id, r.pos, r.term) for r in text.tokens(df, text.ENGLISH).orderBy("row_id", "pos").collect()]
    assert got == [(0, 0, "whale"), (0, 1, "swim"), (0, 2, "quick")]
    assert [r.dl for r in index.doc_lengths(df, text.ENGLISH).orderBy("row_id").collect()] == [3, 0, 0]


def test_lookup_and_phrases(stored):
    post = stored.postings("body")
    assert ids(search.lookup(post, "dog")) == [0, 2] and ids(search.lookup(post, "cat")) == [1, 2] and ids(search.lookup(post, "giraffe")) == []
    assert ids(search.phrase(post, ["dog", "cat"])) == [2]
    assert ids(search.phrase(post, ["dog", "park"])) == []
    assert ids(search.phrase(post, ["park"])) == [0, 2] and ids(search.phrase(post, [])) == []
    assert ids(search.all_terms(post, ["dog", "park", "dog"])) == [0, 2]
    assert [tuple(r) for r in search.skip(post, "dog", 1).collect()] == [(2, 1)] and search.skip(post, "dog", 3).collect() == []


def test_negative_idf_puts_the_longer_row_first(stored):
    found = search.bm25(stored.postings("body"), stored.doc_lengths("body"), ["park"])
    assert [r.row_id for r in search.top(found, 5).collect()] == [2, 0]
    assert all(r.score < 0 for r in found.collect())


def test_sql_view_and_unknown_field(spark, stored):
    stored.register("body", "words")
    assert [tuple(r) for r in spark.sql("SELECT row_id, term_freq FROM words WHERE term = 'park' ORDER BY row_id").collect()] == [(0, 1), (2, 1)]
    got = spark.sql("SELECT term, count(*) AS n FROM words WHERE term IN ('cat', 'dog', 'mat') GROUP BY term ORDER BY term").collect()
    assert [tuple(r) for r in got] == [("cat", 2), ("dog", 2), ("mat", 1)]
    plan = spark.sql("SELECT row_id FROM words WHERE term = 'park'")._jdf.queryExecution().toString()
    assert "EqualTo(term,park)" in plan and "positions" not in plan.split("ReadSchema")[1]
    with pytest.raises(KeyError):
        stored.postings("title")


def test_a_field_is_written_once(stored, docs):
    with pytest.raises(Exception, match="(?i)exist"):
        stored.add_field(docs, "body")


def test_scores(spark):
    row = spark.createDataFrame([(40.0, 41.0, 3.0, 4, 1)], "avdl double, dl double, tf double, big long, n long")
    avdl, dl, tf, big, n = map(F.col, row.columns)
    got = row.select(scoring.idf(n, big), scoring.bm25(tf, dl, n, big, avdl), scoring.idf_positive(n, big), scoring.bm25_quantized(tf, dl, n, big, avdl)).first()
    assert [round(x, 6) for x in got] == [0.847298, 0.601988, 1.203973, 0.859981]


def test_byte4_is_monotone_and_exact_below_41(spark):
    got = [r[0] for r in spark.range(0, 6000).select(scoring.byte4(F.col("id"))).collect()]
    assert got[:41] == list(range(41)) and got[41] == 40
    assert all(a <= b for a, b in zip(got, got[1:])) and len(set(got)) <= 256


def test_positions_of_repeated_terms(spark):
    df = spark.createDataFrame([(7, "a b a a")], "doc_id long, text string")
    post = index.postings(df)
    assert {r.term: (r.tf, r.positions) for r in post.collect()} == {"a": (3, [0, 2, 3]), "b": (1, [1])}
    assert ids(search.phrase(post, ["a", "a"])) == [7] and ids(search.phrase(post, ["a", "b", "a", "a"])) == [7] and ids(search.phrase(post, ["b", "b"])) == []


def test_profile_is_checked_and_described():
    with pytest.raises(ValueError):
        text.Profile(tokenizer="none")
    assert json.loads(json.dumps(text.ENGLISH.to_dict()))["stemmer"] == "english"


def test_ordinals_are_dense_in_byte_order(spark):
    df = spark.createDataFrame([(w,) for w in ["b", "é", "a", "Z", "aa", "日"]], "term string")
    got = {r.term: r.ordinal for r in index.ordinals(df).collect()}
    assert got == {w: i for i, w in enumerate(sorted(got, key=lambda w: w.encode()))}


def test_ordinals_of_many_terms_are_dense(spark, tmp_path):
    """Ranges that are drawn twice, for a wide table and for its terms alone, have other bounds each time."""
    spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("term"), F.col("id").alias("doc_freq")).repartition(3).write.parquet(str(tmp_path / "t"))
    got = index.ordinals(spark.read.parquet(str(tmp_path / "t"))).toArrow().sort_by("term")
    assert got.num_rows == 100_000 and np.array_equal(got.column("ordinal").to_numpy(), np.arange(100_000))


def test_full_case_folding_and_descriptors(spark):
    df = spark.createDataFrame([(0, "Straße STRASSE ΣΑΣ"), (1, None)], "doc_id long, text string")
    full = text.Profile("unicode", "full")
    assert [r.w for r in df.orderBy("doc_id").select(text.analyze(F.col("text"), full).alias("w")).collect()] == [["strasse", "strasse", "σασ"], None]
    for p in (text.ASCII, text.ENGLISH, full):
        assert text.Profile.from_dict(json.loads(json.dumps(p.to_dict()))) == p
    with pytest.raises(ValueError):
        text.Profile.from_dict(text.ASCII.to_dict() | {"dictionary": "zh"})
    with pytest.raises(ValueError):
        text.Profile(case="title")


def test_the_english_chain_is_the_same_as_a_column_in_sql_and_as_rows(spark):
    from quillmere.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([(0, "The whales were swimming quickly to the park."), (1, ""), (2, None)], "doc_id long, text string")
    df.createOrReplaceTempView("chain_docs")
    column = {r.doc_id: r.w for r in df.select("doc_id", text.analyze(F.col("text"), text.ENGLISH).alias("w")).collect()}
    by_sql = {r.doc_id: r.w for r in spark.sql("SELECT doc_id, stemmed(without_stopwords(analyze(text, 'boundary'))) AS w FROM chain_docs").collect()}
    assert column == by_sql and column[0] == [r.term for r in text.tokens(df, text.ENGLISH).orderBy("pos").collect()] and column[2] is None
    with pytest.raises(Exception, match="no such profile"):
        spark.sql("SELECT analyze('a', 'x')").collect()


def test_boundaries(spark):
    df = spark.createDataFrame([("ab c",), ("é1",), ("",), (None,), ("x",)], "text string")
    got = [r.b for r in df.select(text.boundaries(F.col("text")).alias("b")).collect()]
    assert got == [[2, 3], [1], [], None, []]


def test_boundaries_are_added_up_in_arrow(spark):
    import pyarrow as pa

    sizes = [[2, 1, 3], None, [], [5], [1, 1], None, [4, 4, 4]]
    assert text._ends.func(pa.array([[9], *sizes], pa.list_(pa.int32())).slice(1)).to_pylist() == [[2, 3], None, [], [], [1], None, [4, 8]]
    assert text._ends.func(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


@pytest.mark.parametrize("profile", [text.ASCII, text.Profile("unicode"), text.ENGLISH])
def test_postings_in_the_row_equal_grouped_tokens(spark, profile):
    rows = [(0, "The dog, the DOG and the  cat-dog 1a"), (1, None), (2, ""), (3, "é ab́ Kelvin K x9"), (4, "end"), (5, "start" + " word" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.term, r.row_id): (r.tf, r.dl, r.positions) for r in index.postings(df, profile).collect()}
    want, dl = {}, {}
    for r in text.tokens(df, profile).orderBy("row_id", "pos").collect():
        want.setdefault((r.term, r.row_id), []).append(r.pos)
        dl[r.row_id] = dl.get(r.row_id, 0) + 1
    assert got == {k: (len(p), dl[k[1]], p) for k, p in want.items()}
    assert index.postings(df.where("false"), profile).collect() == []


@pytest.mark.parametrize("profile", [text.ASCII, text.ENGLISH])
def test_stored_postings_are_made_in_sorted_runs_without_a_shuffle(spark, tmp_path, profile, monkeypatch):
    monkeypatch.setattr(index, "RUN", 3000)
    df = spark.createDataFrame([(i, f"é w{i % 7} dog w{i % 13} the dogs" if i % 5 else None) for i in range(300, 0, -1)], "doc_id long, text string")
    rows = index.postings(df.coalesce(1), profile, runs=True)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = [(r.term, r.row_id) for r in rows.collect()]
    key = lambda r: (r.term, r.row_id, r.tf, r.dl, r.positions)
    assert sorted(map(key, rows.collect())) == sorted(map(key, index.postings(df, profile).collect()))
    assert 1 <= sum(a > b for a, b in zip(got, got[1:])) < 12
    ix = Index(spark, str(tmp_path / "ix"))
    ix.add_field(df, "body", profile)
    assert sorted(map(key, ix.postings("body").collect())) == sorted(map(key, rows.collect()))
    assert {(r.term, r.doc_freq) for r in ix.terms("body").collect()} >= {("dog", 240)} and ix.stats("body").first().n_docs == 300


def test_texts_are_spread_without_a_sort(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("x").alias("lang")).coalesce(1).write.parquet(str(tmp_path / "d"))
    df = index.spread(spark.read.parquet(str(tmp_path / "d")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "hashpartitioning(doc_id" in plan and df.columns == ["doc_id", "text"] and df.count() == 100


def test_postings_are_put_in_order_by_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(index, "ORDERED", 10)
    post = spark.createDataFrame([(f"t{i % 9}", i // 9, 1) for i in range(900)], "term string, row_id long, tf int")
    rows = index.numbered(index.by_term(post, 900))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(term#") == 1 and "90)" in rows._jdf.queryExecution().toString()
    assert sorted((r.term, r.place) for r in rows.collect()) == sorted((f"t{t}", k) for t in range(9) for k in range(100))


def test_no_position_of_a_phrase_becomes_a_row(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(list("abc"), draw.integers(0, 30))) for _ in range(80)]
    post = index.postings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for terms in (["a", "b"], ["a", "b", "b"], ["c", "c", "c"], ["a", "b", "a", "c"], ["a", "x"]):
        found = search.phrase(post, terms)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        assert ids(found) == [i for i, t in enumerate(texts) if f" {' '.join(terms)} " in f" {t} "]


def test_corpus_lines(spark, tmp_path):
    import gzip

    from quillmere.sources import jsonl

    lines = [json.dumps({"text": f"t{i}", "id": i}) for i in range(20)]
    lines[3], lines[4] = "", "no json"
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    got = {r.line_no: r.text for r in jsonl.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {i: f"t{i}" for i in range(20) if i not in (3, 4)}
    assert {r.line_no for r in jsonl.read_corpus(spark, str(tmp_path), "text string, id long", stride=4).where("id >= 0").collect()} == {0, 8, 12, 16}


def test_checksums_and_field_ids(spark):
    import xxhash

    from quillmere.functions import checksum

    rows = spark.createDataFrame([("",), ("abc",), (None,)], "t string").select("t", checksum.checksum(F.col("t").cast("binary")).alias("h")).collect()
    assert {r.t: r.h if r.h is None else r.h % (1 << 64) for r in rows} == {"": xxhash.xxh3_64_intdigest(b""), "abc": xxhash.xxh3_64_intdigest(b"abc"), None: None}
    assert checksum.field_id("body") == xxhash.xxh3_64_intdigest(b"body") != 0
    with pytest.raises(ValueError):
        checksum.field_id("")


def test_dictionary_segmentation(spark):
    counts = {"研究": 50, "研究生": 20, "生命": 40, "命": 5, "起源": 30, "的": 200, "生": 5}
    df = spark.createDataFrame([("研究生命的起源。研究生",), ("命运 abc",), ("",), (None,)], "t string")
    got = [r.w for r in df.select(text.dictionary_words(F.col("t"), counts).alias("w")).collect()]
    assert got == [["研究", "生命", "的", "起源", "研究生"], ["命", "运", "a", "b", "c"], [], None]
    for run in ("研究生命", "生命研究生的", "xyz"):  # the best of all cuts
        w, n = {k: float(np.log(350 / c)) for k, c in counts.items()}, len(run)
        cuts = ([run[a:b] for a, b in zip([0, *c], [*c, n])] for m in range(1 << (n - 1)) for c in [[i + 1 for i in range(n - 1) if m >> i & 1]])
        dear = 10 + max(w.values())
        cost = lambda ps: sum(w.get(p, dear if len(p) == 1 else float("inf")) for p in ps)
        assert np.isclose(cost(text.segments(run, w, 3)), min(map(cost, cuts)))
