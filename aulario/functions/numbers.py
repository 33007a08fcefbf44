"""Exact two-decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated; NULL when ``b`` is zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def _half_up(scaled: Column, whole: Column) -> Column:
    # round(scaled / whole) with ties away from zero, in integers only
    magnitude = int_div(2 * F.abs(scaled) + whole, 2 * whole)
    return F.when(scaled < 0, -magnitude).otherwise(magnitude)


def percent2(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` to two decimals, half up; NULL when ``whole`` is zero."""
    return _half_up(part.cast("long") * 10000, whole.cast("long")) / F.lit(100.0)


def mean2(total: Column, n: Column) -> Column:
    """``total / n`` to two decimals, half away from zero; NULL when ``n`` is zero."""
    return _half_up(total.cast("long") * 100, n.cast("long")) / F.lit(100.0)
