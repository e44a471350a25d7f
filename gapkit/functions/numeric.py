"""Rounding, guarded division and moments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round2(value: Column, digits: int = 2) -> Column:
    """Round a double the way numpy does: scale, round half to even, scale back.

    ``bround`` works on the decimal text of the double and differs on values such as 1.015.
    """
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def gap_zscore(current: Column, mean: Column, std: Column) -> Column:
    """(current - mean) / std with signed infinity on zero spread and null for 0/0."""
    diff = current - mean
    return (
        F.when(std != 0, diff / std)
        .when(diff > 0, F.lit(float("inf")))
        .when(diff < 0, F.lit(float("-inf")))
    )


def sample_std(n: Column, total: Column, total_sq: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares; null below two values."""
    spread = F.greatest(total_sq - total * total / n, F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n - 1)))
