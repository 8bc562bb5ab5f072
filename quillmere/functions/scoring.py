"""Ranking formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60


def _odds(df: Column, n: Column) -> Column:
    return (n - df + 0.5) / (df + 0.5)


def idf(df: Column, n: Column) -> Column:
    """The log odds of rows without the term, both counts raised by a half: negative for terms in more than half of the rows, and never clipped."""
    return F.log(_odds(df, n))


def idf_positive(df: Column, n: Column) -> Column:
    """The logarithm of one more than those odds."""
    return F.log(1 + _odds(df, n))


def saturation(tf: Column, dl: Column, avdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf / (tf + k1 * (1 + b * (dl / avdl - 1)))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avdl: Column, k1: float = K1, b: float = B) -> Column:
    """BM25 without the factor ``k1 + 1``."""
    return idf(df, n) * saturation(tf, dl, avdl, k1, b)


def byte4(dl: Column) -> Column:
    """The length after a round trip through one byte: exact below 24, then four leading bits of what exceeds 24."""
    over = dl.cast("long") - 24
    shift = F.greatest(F.length(F.bin(over)) - 4, F.lit(0))
    kept = F.call_function("shiftleft", F.call_function("shiftright", over, shift), shift)
    return F.when(dl < 24, dl.cast("long")).otherwise(24 + kept)


def bm25_quantized(tf: Column, dl: Column, df: Column, n: Column, avdl: Column, k1: float = K1, b: float = B) -> Column:
    """BM25 with the positive idf and one-byte lengths."""
    return idf_positive(df, n) * saturation(tf, byte4(dl), avdl, k1, b)


def rrf(rank: Column, k: Column | int = RRF_K) -> Column:
    """One ranking's share in Reciprocal Rank Fusion."""
    return 1.0 / (F.lit(k) + rank if isinstance(k, int) else k + rank)
