"""Bias-adjusted sample skewness and excess kurtosis from Spark's population ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(g1: Column, n: Column) -> Column:
    """G1 = g1 * sqrt(n(n-1)) / (n-2); NULL for n < 3."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); NULL for n < 4."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
