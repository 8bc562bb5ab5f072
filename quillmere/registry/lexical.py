"""Lexical queries over a stored index of ``documents`` (and two more fields) with ASCII words, built once a session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring, sql, text
from ..operators import index, search
from ..storage import bounded, new_folder, written
from . import query, table

TOK = """tok AS (SELECT doc_id AS row_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents))"""
POST = f"WITH {TOK}, post AS (SELECT term, row_id, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY term, row_id)"
LENGTHS = """, dls AS (SELECT doc_id AS row_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS dl FROM documents),
 st AS (SELECT count(*) AS n_docs, avg(dl) AS avdl FROM dls)"""
PLACED = POST + ", placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY term ORDER BY row_id) - 1 AS INTEGER) AS place FROM post)"
IDF = "ln((n_docs - df + 0.5) / (df + 0.5))"
SAT = "tf / (tf + 1.2 * (0.25 + 0.75 * dl / avdl))"
TERMS = ["the", "thetion", "oning"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


FIELDS = {"body": "documents", "benchmark": "benchmark", "conversations": "conversations"}
_STORED: dict[tuple[str, str, str], index.Index] = {}


def stored(spark: SparkSession, d: str, field: str = "body") -> index.Index:
    """The index of the folder's table for ``field``, in the session's shared folder."""
    key = (spark.sparkContext.applicationId, d, field)
    if key not in _STORED:
        ix = index.Index(spark, new_folder(spark, "index"))
        rows = table(spark, d, FIELDS[field])
        if field == "conversations":
            rows = rows.withColumn("doc_id", F.col("conv_id") * 1_000_000 + F.col("turn"))
        elif field == "benchmark":
            rows = rows.withColumnRenamed("item_id", "doc_id")
        ix.add_field(rows, field)
        _STORED[key] = ix
    return _STORED[key]


def post(spark: SparkSession, d: str, positions: bool = False) -> DataFrame:
    rows = stored(spark, d).postings("body")
    return rows.select("term", "row_id", "tf", "positions") if positions else rows.select("term", "row_id", "tf")


def scored(spark: SparkSession, d: str, terms: list[str], profile: str = "plain") -> DataFrame:
    ix = stored(spark, d)
    return search.bm25(ix.postings("body"), ix.doc_lengths("body"), terms, profile, ix.stats("body"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return text.tokens(docs(spark, d))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).doc_lengths("body")


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).terms("body")


@query("s2_scan", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def _(spark, d):
    return docs(spark, d).where("lang = 'fr'").select("doc_id", "lang")


@query("s3_postings", POST + " SELECT term, row_id, tf FROM post")
def _(spark, d):
    return post(spark, d)


@query("s4_dictionary", POST + " SELECT term, doc_freq, row_number() OVER (ORDER BY term COLLATE \"C\") - 1 AS ordinal FROM (SELECT term, count(*) AS doc_freq FROM post GROUP BY term)")
def _(spark, d):
    return index.ordinals(dictionary(spark, d).select("term", "doc_freq")).select("term", "doc_freq", "ordinal")


@query("s16_corpus_stride", "SELECT doc_id, text FROM documents WHERE doc_id % 4 = 0")
def _(spark, d):
    return docs(spark, d).where("doc_id % 4 = 0").select("doc_id", "text")


@query("p2_term_eq", POST + " SELECT row_id, tf FROM post WHERE term = 'the'")
def _(spark, d):
    return search.lookup(post(spark, d), "the").select("row_id", "tf")


@query("p3_term_in", POST + " SELECT term, count(*) AS doc_freq FROM post WHERE term IN ('the', 'der', 'les') GROUP BY term")
def _(spark, d):
    return dictionary(spark, d).where(F.col("term").isin("the", "der", "les")).select("term", "doc_freq")


@query("p4_lookup_miss", POST + " SELECT row_id, tf FROM post WHERE term = 'giraffe'")
def _(spark, d):
    return search.lookup(post(spark, d), "giraffe").select("row_id", "tf")


@query("p5_positions", f"WITH {TOK} SELECT row_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tok WHERE term = 'of' GROUP BY row_id")
def _(spark, d):
    return search.lookup(post(spark, d, True), "of").select("row_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("p6_skip", POST + " SELECT min(row_id) AS row_id, min_by(tf, row_id) AS tf FROM post WHERE term = 'the' AND row_id >= 100 HAVING min(row_id) IS NOT NULL")
def _(spark, d):
    return search.skip(post(spark, d), "the", 100)


@query("p7_positions_for_doc", f"WITH {TOK} SELECT pos FROM tok WHERE term = 'the' AND row_id = 1")
def _(spark, d):
    return post(spark, d, True).where("term = 'the' and row_id = 1").select(F.explode(F.col("positions").cast("array<bigint>")).alias("pos"))


@query("p14_stopwords", f"WITH {TOK} SELECT row_id, count(*) AS kept FROM tok WHERE term NOT IN ({', '.join(repr(w) for w in text.STOPWORDS)}) GROUP BY row_id")
def _(spark, d):
    kept = text.without_stopwords(text.ascii_words(F.col("text")))
    return docs(spark, d).select(F.col("doc_id").alias("row_id"), F.size(kept).cast("long").alias("kept")).where("kept > 0")


@query("f2_lowercase", "SELECT doc_id, lower(text) AS folded FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.lower("text").alias("folded"))


@query("f1_unicode_words", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS n FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.unicode_words(F.col("text"))).cast("long").alias("n"))


_ENDS = "SELECT doc_id, sum(len(p)) OVER (PARTITION BY doc_id ORDER BY i) AS place, i, n FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '{}') AS ps FROM documents))"


@query("f1_boundary_words")
def _(spark, d):
    """Words by the JVM's boundary analysis, whose rules no other engine has."""
    return docs(spark, d).select("doc_id", F.size(text.boundary_words(F.col("text"))).alias("n"))


@query("f8_agreement", f"""WITH a AS (SELECT doc_id, place FROM ({_ENDS.format('[a-z0-9]+|[^a-z0-9]+')}) WHERE i < n), b AS (SELECT doc_id, place FROM ({_ENDS.format('[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')}) WHERE i < n),
 ored AS (SELECT doc_id, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1), anded AS (SELECT doc_id, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1)
SELECT d.doc_id, CASE WHEN ored.n IS NULL THEN 1.0::DOUBLE ELSE round(coalesce(anded.n, 0)::DOUBLE / ored.n, 6) END AS agreement FROM documents d LEFT JOIN ored USING (doc_id) LEFT JOIN anded USING (doc_id)""")
def _(spark, d):
    """Of two segmenters' boundaries inside each text, the share that both have."""
    a, b = text.boundaries(F.col("text")), text.boundaries(F.col("text"), r"\p{L}\p{N}")
    return bounded(docs(spark, d)).select("doc_id", F.round(text.agreement(a, b), 6).alias("agreement"))


@query("a1_term_freq", POST + " SELECT row_id, term, CAST(tf AS BIGINT) AS tf FROM post")
def _(spark, d):
    return tokens(spark, d).groupBy("row_id", "term").agg(F.count("*").alias("tf"))


@query("a2_doc_freq", POST + " SELECT term, count(*) AS doc_freq FROM post GROUP BY term")
def _(spark, d):
    return dictionary(spark, d).select("term", "doc_freq")


@query("a3_doc_len", "SELECT doc_id AS row_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS dl FROM documents")
def _(spark, d):
    return lengths(spark, d)


@query("a4_collection", "SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))), 6) AS avdl FROM documents")
def _(spark, d):
    return stored(spark, d).stats("body").select("n_docs", F.round("avdl", 6).alias("avdl"))


@query("a5_cf", POST + " SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def _(spark, d):
    return dictionary(spark, d).select("term", "cf")


@query("a6_vocab", f"WITH {TOK} SELECT count(DISTINCT term) AS vocabulary, count(*) AS n_tokens FROM tok")
def _(spark, d):
    return dictionary(spark, d).agg(F.count("*").alias("vocabulary"), F.sum("cf").alias("n_tokens"))


@query("a15_percentiles", "SELECT quantile_disc(l, 0.5) AS p50, quantile_disc(l, 0.9) AS p90, quantile_disc(l, 0.99) AS p99 FROM (SELECT n_chars AS l FROM documents)")
def _(spark, d):
    cols = ", ".join(f"percentile_disc({p}) within group (order by n_chars) as p{n}" for p, n in ((0.5, 50), (0.9, 90), (0.99, 99)))
    return docs(spark, d).selectExpr(*[f"cast({c.split(' as ')[0]} as bigint) as {c.split(' as ')[1]}" for c in cols.split(", ")])


@query("a16_segments", POST + " SELECT row_id // 250 AS segment_id, count(*) AS n_postings FROM post GROUP BY 1")
def _(spark, d):
    return post(spark, d).groupBy(F.expr("row_id div 250").alias("segment_id")).agg(F.count("*").alias("n_postings"))


@query("a17_df_decile", POST + """, t AS (SELECT term, count(*) AS doc_freq FROM post GROUP BY term)
SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n_terms, min(doc_freq) AS lowest, max(doc_freq) AS highest FROM (
  SELECT doc_freq, least(10, (row_number() OVER (ORDER BY doc_freq, term COLLATE "C") - 1) * 10 // (SELECT count(*) FROM t) + 1) AS decile FROM t) GROUP BY 1""")
def _(spark, d):
    """Terms with the same frequency share a row of the histogram, so the deciles come from running sums over distinct frequencies, not from a sort of all terms."""
    h = dictionary(spark, d).groupBy("doc_freq").agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("total"))
    w = W.orderBy("doc_freq").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = h.withColumn("until", F.sum("n").over(w)).crossJoin(F.broadcast(total))
    cut = h.select("*", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("decile"))
    # places p (from 0) of decile k: floor(10 p / total) = k - 1
    low = F.ceil((F.col("decile") - 1) * F.col("total") / 10)
    high = F.ceil(F.col("decile") * F.col("total") / 10)
    share = F.least("until", high) - F.greatest(F.col("until") - F.col("n"), low)
    return cut.withColumn("share", share).where("share > 0").groupBy("decile").agg(F.sum("share").cast("long").alias("n_terms"), F.min("doc_freq").alias("lowest"), F.max("doc_freq").alias("highest"))


def by_term(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return index.by_term(rows, dictionary(spark, d).agg(F.sum("doc_freq")).first()[0] or 0)


def placed(spark: SparkSession, d: str) -> DataFrame:
    return index.numbered(by_term(spark, d, post(spark, d)))


@query("w2_gaps", POST + " SELECT term, row_id, row_id - lag(row_id, 1, 0) OVER (PARTITION BY term ORDER BY row_id) AS gap FROM post")
def _(spark, d):
    gap = F.col("row_id") - F.lag("row_id", 1, 0).over(W.partitionBy("term").orderBy("row_id"))
    return by_term(spark, d, post(spark, d).select("term", "row_id")).select("term", "row_id", gap.alias("gap"))


@query("w3_prefix", POST + " SELECT term, tf, sum(tf) OVER (PARTITION BY term ORDER BY row_id) AS tokens_until, row_id FROM post")
def _(spark, d):
    """Row ids from gaps that a table holds, by a running sum; and the term's occurrences so far."""
    order = W.partitionBy("term").orderBy("row_id")
    gaps = written(spark, placed(spark, d).select("term", "place", "tf", (F.col("row_id") - F.lag("row_id", 1, 0).over(order)).alias("gap")), "gaps")
    until = W.partitionBy("term").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return by_term(spark, d, gaps).select("term", "tf", F.sum("tf").over(until).alias("tokens_until"), F.sum("gap").over(until).alias("row_id"))


@query("w4_block_max", PLACED + " SELECT term, place // 256 AS block, max(row_id) AS block_max, count(*) AS n FROM placed GROUP BY term, place // 256")
def _(spark, d):
    return placed(spark, d).groupBy("term", "block").agg(F.max("row_id").alias("block_max"), F.count("*").alias("n"))


@query("w5_block_prefix", PLACED + ", b AS (SELECT term, place // 256 AS block, sum(tf) AS t FROM placed GROUP BY 1, 2) SELECT term, block, CAST(coalesce(sum(t) OVER (PARTITION BY term ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM b")
def _(spark, d):
    blocks = placed(spark, d).groupBy("term", "block").agg(F.sum("tf").alias("t"))
    before = F.sum("t").over(W.partitionBy("term").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return blocks.select("term", "block", F.coalesce(before, F.lit(0)).alias("before"))


@query("w6_pos_delta", f"WITH {TOK} SELECT row_id, term, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY row_id, term ORDER BY pos) AS delta FROM tok")
def _(spark, d):
    rows = tokens(spark, d).withColumn("pos", F.col("pos").cast("long"))
    return rows.withColumn("delta", F.col("pos") - F.lag("pos", 1, 0).over(W.partitionBy("row_id", "term").orderBy("pos"))).select("row_id", "term", "pos", "delta")


@query("f10_idf", POST + LENGTHS + f" SELECT term, round({IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st")
def _(spark, d):
    t = dictionary(spark, d).crossJoin(F.broadcast(stored(spark, d).stats("body")))
    return t.select("term", F.round(scoring.idf(F.col("doc_freq"), F.col("n_docs")), 6).alias("idf"))


@query("f13_idf_positive", POST + LENGTHS + " SELECT term, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st")
def _(spark, d):
    t = dictionary(spark, d).crossJoin(F.broadcast(stored(spark, d).stats("body")))
    return t.select("term", F.round(scoring.idf_positive(F.col("doc_freq"), F.col("n_docs")), 6).alias("idf"))


def _bm25_sql(where: str, idf: str = IDF, dl: str = "dl") -> str:
    sat = SAT.replace("* dl /", f"* {dl} /")
    return POST + LENGTHS + f""", hits AS (SELECT p.term, p.row_id, tf, dl FROM post p JOIN dls USING (row_id) WHERE {where}),
 dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
 scored AS (SELECT row_id, sum({idf} * ({sat})) AS score FROM hits JOIN dfs USING (term), st GROUP BY row_id)"""


BYTE4 = "(CASE WHEN dl < 24 THEN dl ELSE 24 + (((dl - 24) >> greatest(len(bin(dl - 24)) - 4, 0)) << greatest(len(bin(dl - 24)) - 4, 0)) END)"


@query("f11_bm25", _bm25_sql("p.term = 'the'") + " SELECT row_id, round(score, 6) AS score FROM scored")
def _(spark, d):
    return scored(spark, d, ["the"]).select("row_id", F.round("score", 6).alias("score"))


@query("o1_bm25_top10", _bm25_sql("p.term = 'the'") + " SELECT row_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, row_id LIMIT 10")
def bm25_top10(spark, d):
    return search.top(scored(spark, d, ["the"]), 10).select("row_id", F.round("score", 6).alias("score"))


@query("f12_bm25_multi", _bm25_sql(f"p.term IN ({', '.join(map(repr, TERMS))})") + " SELECT row_id, round(score, 6) AS score FROM scored")
def _(spark, d):
    return scored(spark, d, TERMS).select("row_id", F.round("score", 6).alias("score"))


@query("f14_quantized", _bm25_sql("p.term = 'the'", "ln(1 + (n_docs - df + 0.5) / (df + 0.5))", BYTE4) + " SELECT row_id, round(score, 6) AS score FROM scored")
def _(spark, d):
    return scored(spark, d, ["the"], "quantized").select("row_id", F.round("score", 6).alias("score"))


@query("f15_byte4", f"WITH dls AS (SELECT doc_id AS row_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS dl FROM documents) SELECT row_id, dl, {BYTE4} AS quantized FROM dls")
def _(spark, d):
    return lengths(spark, d).select("row_id", "dl", scoring.byte4(F.col("dl")).alias("quantized"))


@query("w7_bm25_segment", POST + LENGTHS + f""", h AS (SELECT row_id // 250 AS segment_id, p.row_id, tf, dl FROM post p JOIN dls USING (row_id) WHERE term = 'the'),
 dfs AS (SELECT segment_id, count(*) AS df FROM h GROUP BY 1), seg AS (SELECT row_id // 250 AS segment_id, count(*) AS n_docs, avg(dl) AS avdl FROM dls GROUP BY 1)
SELECT segment_id, row_id, round({IDF} * ({SAT}), 6) AS score FROM h JOIN dfs USING (segment_id) JOIN seg USING (segment_id)""")
def _(spark, d):
    found = search.bm25_by_segment(post(spark, d), lengths(spark, d), "the", lambda r: F.floor(r / 250))
    return found.select("segment_id", "row_id", F.round("score", 6).alias("score"))


def _phrase_sql(*terms: str) -> str:
    joins = " ".join(f"JOIN tok t{i} ON t{i}.row_id = t0.row_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"WITH {TOK} SELECT DISTINCT t0.row_id FROM tok t0 {joins} WHERE t0.term = '{terms[0]}'"


@query("j1_phrase2", _phrase_sql("of", "the"))
def _(spark, d):
    return search.phrase(post(spark, d, True), ["of", "the"])


@query("j1_phrase3", _phrase_sql("of", "the", "the"))
def _(spark, d):
    return search.phrase(post(spark, d, True), ["of", "the", "the"])


@query("j2_and", f"WITH {TOK} SELECT row_id FROM tok WHERE term IN ('the', 'of', 'is') GROUP BY row_id HAVING count(DISTINCT term) = 3")
def _(spark, d):
    return search.all_terms(post(spark, d), ["the", "of", "is"])


@query("h4_bm25_rowid", _bm25_sql("p.term = 'and'") + " SELECT row_id + 1000000 AS row_id, round(score, 6) AS score FROM scored")
def _(spark, d):
    found = scored(spark, d, ["and"])
    return found.select((F.col("row_id") + 1_000_000).alias("row_id"), F.round("score", 6).alias("score"))


@query("s5_open_field", """SELECT 'conversations' AS field, count(DISTINCT term) AS vocabulary FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations)
UNION ALL SELECT 'benchmark', count(DISTINCT term) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)""")
def _(spark, d):
    """Each field is opened by its name; its dictionary has a row a term."""
    parts = [stored(spark, d, n).terms(n).agg(F.lit(n).alias("field"), F.count("*").alias("vocabulary")) for n in ("conversations", "benchmark")]
    return parts[0].union(parts[1])


@query("x1_analyze", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INTEGER) AS ascii, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS INTEGER) AS unicode FROM documents")
def _(spark, d):
    """The chain as an SQL function, by a profile's name."""
    sql.register(spark)
    docs(spark, d).createOrReplaceTempView("qm_documents")
    return spark.sql("SELECT doc_id, size(analyze(text, 'ascii')) AS ascii, size(analyze(text, 'unicode')) AS unicode FROM qm_documents")


@query("f4_stem")
def _(spark, d):
    """Stems of all distinct words; each word is stemmed once and joined back by whoever needs it."""
    words = tokens(spark, d).select("term").distinct().withColumn("stem", F.col("term"))
    return text.stems(words, "stem")


@query("f5_english_chain")
def _(spark, d):
    return text.tokens(docs(spark, d), text.ENGLISH).groupBy("row_id").agg(F.count("*").alias("dl"))
