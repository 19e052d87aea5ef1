"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, empty vectors and zero norms."""
    bottom = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (bottom > 0), dot(a, b) / bottom).otherwise(0.0)


def unit(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(a.cast("array<double>"))


def usable(a: Column, dim: int = 64) -> Column:
    return a.isNotNull() & (F.size(a) == dim) & F.exists(a, lambda x: x != 0)
