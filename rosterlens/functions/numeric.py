"""Rounding, ratios and conditional sums shared by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(value: Column | str, digits: int = 2) -> Column:
    """Half-away-from-zero rounding on the scaled double.

    F.round goes through the decimal text of the double, so it rounds 0.145 up although the
    stored number lies below; scaling first rounds the number itself, as other SQL engines do.
    """
    value, scale = col(value).cast("double"), F.lit(10.0**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + F.lit(0.5)) / scale


def safe_divide(num: Column, den: Column, default: float | None = None) -> Column:
    """Null (or the given default) when the denominator is zero or missing."""
    result = F.try_divide(num.cast("double"), den.cast("double"))
    return result if default is None else F.coalesce(result, F.lit(float(default)))


def pct(num: Column, den: Column, digits: int = 2, default: float | None = None) -> Column:
    """100 x num / den, rounded."""
    return round_half_up(safe_divide(F.lit(100.0) * num, den, default), digits)


def count_if(cond: Column) -> Column:
    """Rows satisfying the condition, 0 (not null) for none."""
    return F.count(F.when(cond, F.lit(1)))


def n_rows() -> Column:
    return F.count(F.lit(1))


def mean(value: Column | str, where: Column | None = None) -> Column:
    """Mean from the exact sum, so decimal inputs keep full precision."""
    value = col(value)
    value = value if where is None else F.when(where, value)
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def as_long(value: Column) -> Column:
    return value.cast("bigint")
