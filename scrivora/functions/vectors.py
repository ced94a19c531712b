"""Arithmetic on arrays of numbers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Cosine; 0 if one of the norms is at most ``least``."""
    size = norm(a) * norm(b)
    return F.when((norm(a) > least) & (norm(b) > least), dot(a, b) / size).otherwise(F.lit(0.0))


def truncated(a: Column, k: int) -> Column:
    """The first ``k`` numbers, or all if there are fewer."""
    return F.slice(a, 1, k)


def scaled(a: Column, factors: Column) -> Column:
    return F.zip_with(a, factors, lambda x, y: x * y)
