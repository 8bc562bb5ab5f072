"""The training-data queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitpack, flatgraph, katz, langid, minhash, packing, secrets, sentencepiece_fst, topk, vocab, warc

PIECES = vocab.path("piece_bpe_32k.model")
BYTES = vocab.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.normalise_pages(spark, _table(spark, sf_dir, "pages"))


def op2_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_documents(spark, _table(spark, sf_dir, "documents"), PIECES)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spark, _table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), BYTES)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.write_tokens(spark, _table(spark, sf_dir, "documents"), BYTES)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(spark, _table(spark, sf_dir, "documents"), BYTES, katz.Settings(order=3, min_count=1))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks all vectors."""
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(spark, rows, rows.where("vec_id % 50 = 0"))


OP10_SQL = """
SELECT query_id, rank, neighbor_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
      round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id))
WHERE rank <= 10
"""


#: By all pairs: a recall of 1 where there is a pair. The graph search is held to it, as it finds all pairs of these tables.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
 near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (a.norm * b.norm), 6) >= 0.95),
 led AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT led.vec_id, near.b FROM led JOIN near ON near.a = led.other),
 links AS (SELECT a AS vec_id, count(*) AS links FROM near GROUP BY a)
SELECT vec_id, min(other) AS class_id, coalesce(any_value(links), 0) AS links, CASE WHEN (SELECT count(*) FROM near) > 0 THEN 1.0::DOUBLE END AS recall
FROM led LEFT JOIN links USING (vec_id) GROUP BY vec_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_flat_graph, op3_sentencepiece, op4_secrets, op5_packing, op6_token_files, op7_minhash, op8_language_id, op9_katz, op10_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op2_flat_graph": OP2_SQL, "op10_topk": OP10_SQL}
