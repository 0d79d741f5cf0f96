"""Vector expressions; products are summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def mean_pool(vectors: Column, i0: Column, i1: Column) -> Column:
    """The mean of the vectors i0 to i1, inclusive."""
    part = F.slice(vectors, i0 + 1, i1 - i0 + 1)
    width = F.size(F.try_element_at(part, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), width), lambda d: F.aggregate(part, F.lit(0.0), lambda s, v: s + F.try_element_at(v, d)) / F.size(part))
