"""Vectors as arrays: norms, distances, one more dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def append(v: Column, x: Column) -> Column:
    """One more dimension."""
    return F.array_append(v, x)
