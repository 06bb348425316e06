"""Vector expressions on array and map columns; scores are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a null or zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def positive(weights: Column) -> Column:
    """Without weights that are zero or less."""
    return F.map_filter(weights, lambda _, v: v > 0)


def sparse_parts(weights: Column) -> tuple[Column, Column]:
    """Indices and values of a weight map."""
    kept = positive(weights)
    return F.map_keys(kept), F.map_values(kept)
