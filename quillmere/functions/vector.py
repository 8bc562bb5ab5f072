"""Distances as columns: squared L2 and negated inner product, smaller is nearer, summed in order in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def neg_ip(a: Column, b: Column) -> Column:
    return -dot(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """``a`` at length 1, as doubles; a zero vector stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def neg_cosine(a: Column, b: Column) -> Column:
    return neg_ip(normalized(a), normalized(b))


def cluster_count(n: Column) -> Column:
    """``round(4 * sqrt(n))``, 1 at least."""
    return F.greatest(F.lit(1), F.round(4 * F.sqrt(n))).cast("long")


def padded_dims(d: Column) -> Column:
    """The next multiple of 64."""
    return (F.ceil(d / 64) * 64).cast("long")
