"""Intervals and null-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def f1(precision: Column, recall: Column) -> Column:
    """0 where either is null or 0."""
    ok = (precision > 0) & (recall > 0)
    return F.when(ok, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval; null where n is 0."""
    p = k / n
    down = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / down
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / down
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)
