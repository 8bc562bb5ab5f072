from collections import Counter
from math import exp, isclose, log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmere.llm import bytebpe, katz, queries, vocab
from quillmere.llm._common import id_text

BYTES = vocab.path("byte_bpe_50k.tiktoken")


def brute(texts, order, k=5, min_count=2):
    """Katz by dictionaries; gives a function p(context, token)."""
    enc = bytebpe.load(BYTES)
    v = enc.vocab
    grams = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        ids = [int(x) for x in enc.encoding.encode_ordinary(t or "")]
        if not ids:
            continue
        ids = [v] * (order - 1) + ids + [v + 1]
        for i in range(order - 1, len(ids)):
            for n in grams:
                grams[n][tuple(ids[i - n + 1 : i + 1])] += 1
    totals, d = {n: Counter() for n in grams}, {}
    for n, g in grams.items():
        d[n] = katz.discounts(Counter(g.values()), k)
        for x, c in g.items():
            totals[n][x[:-1]] += c
    least = lambda n: min_count if n >= 3 else 1

    def own(x):
        n, c = len(x), grams[len(x)][x]
        if c < least(n):
            return None
        h, mass = totals[n][x[:-1]], masses[n][x[:-1]]
        return c * d[n].get(c, 1.0) / (h + 1 if mass >= h else h)

    masses = {n: Counter() for n in grams}
    for n, g in grams.items():
        for x, c in g.items():
            if c >= least(n):
                masses[n][x[:-1]] += c * d[n].get(c, 1.0)
    seen = {n: {} for n in grams}
    for n, g in grams.items():
        for x, c in g.items():
            if c >= least(n):
                seen[n].setdefault(x[:-1], []).append(x[-1])
    floor = (1 - sum(own((w,)) for w in seen[1][()])) / (v + 1 - len(seen[1][()]))
    weights = {}

    def p(h, w):
        x = (*h, w)
        got = own(x)
        if got is not None:
            return got
        if not h:
            return floor
        if h not in weights:
            used = seen[len(x)].get(h)
            weights[h] = 1.0 if used is None else (1 - sum(own((*h, u)) for u in used)) / (1 - sum(p(h[1:], u) for u in used))
        return weights[h] * p(h[1:], w)

    return p, v, enc


TEXTS = ["the cat sat on the mat", "the cat sat on the hat", "the dog sat on the mat the dog sat on the mat", "a cat", "", None, "Ünïcode the the the", "the cat sat on the mat"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, tok string").repartition(2)
    got = {r.doc_id: r for r in katz.score_documents(spark, docs, BYTES, katz.Settings(order=order)).collect()}
    p, v, enc = brute(TEXTS, order)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if not t:
            assert (got[i].n_tokens, got[i].log_prob, got[i].perplexity) == (0, None, None)
            continue
        ids = [v] * (order - 1) + list(enc.encoding.encode_ordinary(t)) + [v + 1]
        want = sum(log(p(tuple(ids[k - order + 1 : k]), ids[k])) for k in range(order - 1, len(ids)))
        assert got[i].n_tokens == len(ids) - order + 1
        assert isclose(got[i].log_prob, want, rel_tol=1e-9)
        assert isclose(got[i].perplexity, exp(-want / got[i].n_tokens), rel_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_context_sums_to_one(spark, order):
    enc = bytebpe.load(BYTES)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    s = katz.Settings(order=order)
    model = katz.train(spark, katz.count(spark, id_text(docs), BYTES, s), s)
    the, cat = enc.encoding.encode_ordinary(" the")[0], enc.encoding.encode_ordinary(" cat")[0]
    contexts = [0] if order == 1 else [the, cat, 7, enc.vocab] if order == 2 else [(the << 16) + cat, (7 << 16) + the, (enc.vocab << 16) + enc.vocab]
    contexts += [(enc.vocab << 32) + (the << 16) + cat] if order == 4 else []
    events = spark.range(enc.vocab + 2).where(f"id <> {enc.vocab}").selectExpr("cast(id as int) tok")
    for ctx in contexts:
        lp = katz.evaluate(model, events.selectExpr(f"{ctx}L ctx", "tok"), order).toPandas().lp
        assert len(lp) == enc.vocab + 1 and isclose(np.exp(lp).sum(), 1, rel_tol=1e-9)


def test_discounts():
    n = {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}
    d = katz.discounts(n, 5)
    common = 6 * 5 / 100
    assert isclose(d[1], (2 * 40 / 100 - common) / (1 - common)) and all(0 < x < 1 for x in d.values())
    assert katz.discounts({}, 5) == {r: 1 - 0.5 / r for r in range(1, 6)}


def test_keys_pad_and_mark():
    blobs = pa.array([np.array([5, 6], "<u2").tobytes(), np.array([7], "<u2").tobytes()])
    key, bounds = katz.keys(blobs, 2, 10)
    assert bounds.tolist() == [0, 3, 5]
    assert key.tolist() == [(10 << 16) + 5, (5 << 16) + 6, (6 << 16) + 11, (10 << 16) + 7, (7 << 16) + 11]


def test_many_parts_give_the_same(spark, monkeypatch):
    """Parts of a few tokens, so that frequent ones are salted, and blocks of a few texts."""
    texts = [t for t in TEXTS if t] * 2 + ["the mat the cat the hat the dog the park", "on the on the on the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for order in (1, 2, 3, 4):
        s = katz.Settings(order=order)
        want = {r.doc_id: r.log_prob for r in katz.score_documents(spark, docs, BYTES, s).collect()}
        monkeypatch.setattr(katz, "_PART", 9)
        monkeypatch.setattr(katz, "_RUN", 4)
        assert order == 1 or katz.count(spark, id_text(docs), BYTES, s).split.salts.max() > 1
        got = {r.doc_id: r.log_prob for r in katz.score_documents(spark, docs, BYTES, s).collect()}
        monkeypatch.undo()
        assert set(got) == set(want) and all(isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_katz_awkward(spark):
    """Null ids, repeated rows, a very long text, and columns that are called as ours."""
    long = "the cat sat on the mat and " * 60_000
    rows = [(None, "the cat sat"), (1, "the cat sat"), (1, "the cat sat"), (2, None), (3, ""), (4, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("ctx", "tok", "n", "block", "part", "id"):
        df = df.withColumn(name, F.lit("x"))
    got = katz.score_documents(spark, df, BYTES, katz.Settings(order=3, min_count=1)).collect()
    assert sorted((r.doc_id, r.log_prob is None) for r in got if r.doc_id is not None) == [(1, False), (1, False), (2, True), (3, True), (4, False)]
    assert [r.log_prob is None for r in sorted((r for r in got if r.doc_id is None), key=lambda r: r.n_tokens)] == [True, False]
    p, v, enc = brute([t for _, t in rows], 3, min_count=1)
    ids = [v, v, *enc.encoding.encode_ordinary(long), v + 1]
    assert isclose(next(r.log_prob for r in got if r.doc_id == 4), sum(log(p(tuple(ids[k - 2 : k]), ids[k])) for k in range(2, len(ids))), rel_tol=1e-9)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_documents(spark, docs, BYTES).collect() == []


def test_the_query_is_of_order_3_with_all_counts(spark, tmp_path):
    texts = [*TEXTS, "the cat sat on the mat and the dog sat on the hat"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_prob for r in queries.op9_katz(spark, str(tmp_path)).collect()}
    p, v, enc = brute(texts, 3, min_count=1)
    for i, t in enumerate(texts):
        if t:
            ids = [v, v, *enc.encoding.encode_ordinary(t), v + 1]
            assert isclose(got[i], sum(log(p(tuple(ids[k - 2 : k]), ids[k])) for k in range(2, len(ids))), rel_tol=1e-9)
