"""Array-of-number column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                           * (x.cast("double") - y.cast("double"))))


def row_mse(x: Column, rebuilt: Column) -> Column:
    """Mean squared difference of a vector and its reconstruction."""
    return squared_l2(x, rebuilt) / F.size(x)


def mean_vectors(vectors: list[Column]) -> Column:
    """Element-wise mean of equally long arrays (soft vote of class probabilities)."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    n = float(len(vectors))
    return F.transform(total, lambda x: x / n)


def argmax(v: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
