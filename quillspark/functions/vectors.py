"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_issue(a: Column, dimension: int) -> Column:
    """The first thing wrong with a vector, or null: DIMENSION, NOT_FINITE, ZERO."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4028234663852886e38))
    return F.when(a.isNull() | (F.size(a) != dimension), "DIMENSION").when(bad, "NOT_FINITE").when(F.forall(a, lambda x: x == 0), "ZERO")
