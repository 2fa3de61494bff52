"""Vector Column builders (JVM-side higher-order functions).

These are the exact, per-row forms. The batch search in
``quarry.operators.vector_search`` scores whole Arrow batches against a
broadcast query block instead, which is far cheaper per pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """Cosine distance ``1 - cos(a, b)``; NULL when either side is NULL or a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity_from_distance(d: str | Column) -> Column:
    return F.lit(1.0) - _c(d)
