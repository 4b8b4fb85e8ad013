"""Rates, rounding and clamping.

Two roundings are in use.  Stored report views round half up
(`view_percent`); the overview figures round half to even (`api_percent`).
All work on doubles, and every division is guarded (ANSI mode raises on /0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def view_percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 2 decimals half up, 0 for an empty whole."""
    value = F.try_divide(part * F.lit(100.0), whole.cast("double"))
    return F.coalesce(F.round(value, 2), F.lit(0.0))


def api_percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 1 decimal half even, 0 for an empty whole."""
    value = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    return F.coalesce(F.bround(value, 1), F.lit(0.0))


def clamped(value: Column) -> Column:
    """value kept within [0, 1]; null stays null, NaN becomes null."""
    inside = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.when(value.isNotNull() & ~F.isnan(value), inside)


def percent_text(fraction: Column) -> Column:
    """0.127 -> '13%', ties to the even whole percent."""
    return F.concat(F.bround(fraction * F.lit(100.0), 0).cast("bigint").cast("string"), F.lit("%"))


def page_count(total: Column, limit: int) -> Column:
    """How many pages of `limit` rows; an empty listing still has one."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(total / F.lit(float(limit))).cast("bigint"))
