"""Vectors as columns: array<float> in, doubles computed, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either side has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def pool(vectors: Column, weights: Column) -> Column:
    """Mean of an array of vectors by weight, scaled to length one."""
    total = F.aggregate(F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w)), F.transform(vectors[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    length = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: F.when(length > 0, x / length).otherwise(x))
