"""Aggregates with stated rounding and empty-group rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile(x: Column, q: float) -> Column:
    """Linear between ranks."""
    return F.percentile(x, F.lit(q))


def nearest_rank(values: Column, p: float) -> Column:
    """Value at index round(p / 100 * (n - 1)), half to even, of an array."""
    return F.get(F.array_sort(values), F.bround(F.lit(p / 100) * (F.size(values) - 1), 0).cast("int"))


def circular_length(phase: Column) -> Column:
    return F.sqrt(F.pow(F.avg(F.cos(phase)), 2) + F.pow(F.avg(F.sin(phase)), 2))


def share(condition: Column, places: int = 2) -> Column:
    """Percent of rows that meet a condition."""
    return F.round(100 * F.avg(condition.cast("double")), places)
