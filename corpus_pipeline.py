"""From raw documents to packed training windows.

Each stage takes the documents that its predecessor kept, whole, and is written as Parquet and read again before the
next. Filtering and rewriting run on the rows in place, without moving texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import langid, minhash, packing, secrets, vocab
from quillmere.llm._common import discard, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; those that are rejected go, null and empty texts and such without letters too."""
    return langid.keep_identified(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of least id; null ids come last. Texts without words stay."""
    return minhash.keep_one(spark, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by the name of its rule and ``n_chars`` counted anew where it was."""
    return secrets.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens; one row a piece of a document. Null and empty texts have no piece; null ids are packed like others."""
    return packing.pack_documents(spark, docs, vocab.path("byte_bpe_50k.tiktoken"))


STAGES = [("language ID", identify_language), ("near duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]

#: Trained models, sketches and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is removed once the next one's rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
