"""Scores as expressions: decay, sigmoid, cosine, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def recency_decay(age_days: Column, half_life: Column) -> Column:
    """Halves with each half-life. Ages below 0 and NaN count as 0; a half-life of 0 or less gives 0."""
    age = F.when(F.isnan(age_days) | (age_days < 0), 0.0).otherwise(age_days)
    return F.when(half_life <= 0, 0.0).otherwise(F.exp(-math.log(2) * age / half_life))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 for equal vectors, of zeros too; else 0 where either has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).when(a == b, 1.0).otherwise(0.0)


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: is_finite(x))


def checked_vector(v: Column, dim: int) -> Column:
    """v, or an error if it has another length or an element that isn't finite."""
    return F.when((F.size(v) == dim) & all_finite(v), v).otherwise(F.raise_error(F.concat(F.lit(f"not a finite vector of {dim}: size "), F.size(v).cast("string"))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)
