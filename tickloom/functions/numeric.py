"""Rounding and comparison as double-precision half-up, unlike SQL's round()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 2) -> Column:
    """floor(x * 10^places + 0.5) / 10^places: ties go up, also below zero."""
    return F.floor(x * F.lit(float(10**places)) + F.lit(0.5)) / F.lit(float(10**places))


def cents(x: Column) -> Column:
    """Two-decimal amounts as whole numbers, so that sums do not depend on their order."""
    return F.floor(x * 100 + F.lit(0.5)).cast("long")


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent to two decimals; null where there is nothing before, or zero."""
    return F.when(before != 0, half_up((now - before) / before * 100))
