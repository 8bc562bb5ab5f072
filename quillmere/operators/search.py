"""Lookups, scoring and phrases over postings. Terms are taken as analyzed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .index import stats as stats_of


def lookup(post: DataFrame, term: str) -> DataFrame:
    """Postings of a term; none if it isn't there."""
    return post.where(F.col("term") == term)


def skip(post: DataFrame, term: str, target: int) -> DataFrame:
    """The first posting of ``term`` at or after ``target``; no row if there is none."""
    first = lookup(post, term).where(F.col("row_id") >= target).agg(F.min_by(F.struct("row_id", "tf"), "row_id").alias("p"))
    return first.where("p is not null").select("p.*")


def with_stats(post: DataFrame, lengths: DataFrame, terms: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Postings of the terms with ``dl``, ``df``, ``n_docs`` and ``avdl``.

    Document frequencies are one row a query term and the collection's statistics (``stats``, or made of ``lengths``) one
    row, so they are sent to every executor. Postings that don't have their document's length meet it on ``row_id``.
    """
    rows = post.where(F.col("term").isin(*terms))
    rows = rows.select("term", "row_id", "tf", "dl") if "dl" in post.columns else rows.select("term", "row_id", "tf").join(lengths, "row_id")
    dfs = post.where(F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("df"))
    return rows.join(F.broadcast(dfs), "term").crossJoin(F.broadcast(stats_of(lengths) if stats is None else stats))


def bm25(post: DataFrame, lengths: DataFrame, terms: list[str], profile: str = "plain", stats: DataFrame | None = None) -> DataFrame:
    """``row_id``, ``score``: the sum over the query's terms of plain or quantized BM25; all matches."""
    formula = {"plain": scoring.bm25, "quantized": scoring.bm25_quantized}[profile]
    rows = with_stats(post, lengths, terms, stats)
    score = formula(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avdl"))
    if len(set(terms)) == 1:  # a row has one posting of a term
        return rows.select("row_id", score.alias("score"))
    return rows.groupBy("row_id").agg(F.sum(score).alias("score"))


def bm25_by_segment(post: DataFrame, lengths: DataFrame, term: str, segment) -> DataFrame:
    """``segment_id``, ``row_id``, ``score`` with every segment's own statistics."""
    hits = lookup(post, term).select("row_id", "tf", segment(F.col("row_id")).alias("segment_id"))
    dfs = hits.groupBy("segment_id").agg(F.count("*").alias("df"))
    sizes = lengths.groupBy(segment(F.col("row_id")).alias("segment_id")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avdl"))
    rows = hits.join(lengths, "row_id").join(dfs, "segment_id").join(sizes, "segment_id")
    return rows.select("segment_id", "row_id", scoring.bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avdl")).alias("score"))


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best rows, equal scores by row id."""
    return df.orderBy(F.desc(score), "row_id").limit(k)


def all_terms(post: DataFrame, terms: list[str]) -> DataFrame:
    """``row_id`` of rows that have every term: one aggregation, however many terms."""
    wanted = list(dict.fromkeys(terms))
    rows = post.where(F.col("term").isin(*wanted)).groupBy("row_id").agg(F.count_distinct("term").alias("k"))
    return rows.where(F.col("k") == len(wanted)).select("row_id")


def phrase(post: DataFrame, terms: list[str]) -> DataFrame:
    """``row_id`` of rows where the terms follow each other. No term: no row; one term: its rows.

    The postings of the distinct terms meet by row, and a row's arrays of positions, each brought to the phrase's start, are
    intersected where they are: no position becomes a row of its own.
    """
    if not terms:
        return post.select("row_id").where("false")
    if len(terms) == 1:
        return lookup(post, terms[0]).select("row_id").distinct()
    wanted = list(dict.fromkeys(terms))
    rows = None
    for i, t in enumerate(wanted):
        part = lookup(post, t).select("row_id", F.col("positions").alias(f"p{i}"))
        rows = part if rows is None else rows.join(part, "row_id")
    starts = None
    for k, t in enumerate(terms):
        at = F.transform(f"p{wanted.index(t)}", (lambda k: lambda p: p - k)(k))
        starts = at if starts is None else F.array_intersect(starts, at)
    return rows.where(F.size(starts) > 0).select("row_id").distinct()
