"""Scalar rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """Missing is NULL here: NaN and infinities become NULL, so aggregates skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either is missing."""
    return F.try_divide(a, b)


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def round6(x: Column) -> Column:
    """Half-up at six decimals by arithmetic that every engine shares."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def compact_date(x: Column) -> Column:
    """yyyyMMdd text as a date, NULL where it isn't one."""
    return F.try_to_date(x, "yyyyMMdd")


def inverse_positive(x: Column) -> Column:
    """1 / x for positive x, else NULL (earnings or book yield from a price ratio)."""
    return F.when(x > 0, 1 / x)
