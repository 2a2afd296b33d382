"""Expressions over ``ARRAY<DOUBLE>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(a, lambda x: x * factor)


def interpolate(a: Column, b: Column, gap: Column) -> Column:
    """The point ``a + gap * (b - a)``."""
    return F.zip_with(a, b, lambda x, y: x + gap * (y - x))


def zeros(dims: int) -> Column:
    return F.array_repeat(F.lit(0.0), dims)


def rounded(a: Column, digits: int) -> Column:
    """Round every element, so a sum's order of addition cannot show."""
    return F.transform(a, lambda x: F.round(x, digits))
