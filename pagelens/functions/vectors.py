"""Expressions on `array<double>` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """Vector over its length; null for the zero vector."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x / length))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    lengths = norm(left) * norm(right)
    return F.when(lengths > 0, dot(left, right) / lengths).otherwise(F.lit(0.0))


def distance(similarity: Column) -> Column:
    """1 - similarity. Below zero where the score can exceed 1 (the composite score)."""
    return F.lit(1.0) - similarity


def weighted_average(left: Column, right: Column, left_weight: float) -> Column:
    """Weighted mean of two vectors, the longer cut to the length of the shorter."""
    size = F.least(F.size(left), F.size(right))
    return F.zip_with(
        F.slice(left, F.lit(1), size),
        F.slice(right, F.lit(1), size),
        lambda x, y: x * left_weight + y * (1.0 - left_weight),
    )
