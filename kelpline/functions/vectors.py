"""Vector scalars as higher-order expressions on array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column, dims: int) -> Column:
    return F.coalesce((F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """a with length 1, its length computed once; without any, nulls."""
    return F.zip_with(a, F.array_repeat(F.nullif(norm(a), F.lit(0.0)), F.size(a)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)
