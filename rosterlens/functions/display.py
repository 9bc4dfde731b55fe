"""Text formats of the report cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.numeric import col, round_half_up


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_half_up(value, digits))


def money_k(value: Column | str, digits: int = 1) -> Column:
    """$12.3K"""
    return F.concat(F.lit("$"), F.format_number(round_half_up(col(value) / F.lit(1000.0), digits), digits), F.lit("K"))


def percent(rate: Column | str, digits: int = 1) -> Column:
    """23.8% from a 0..1 rate."""
    return F.concat(_fixed(col(rate) * F.lit(100.0), digits), F.lit("%"))


def integer(value: Column | str) -> Column:
    return F.format_number(col(value).cast("bigint"), 0)


def percent_with_count(rate: Column | str, count: Column | str, noun: str = "employees") -> Column:
    """23.8% (2,380 employees)"""
    return F.concat(percent(rate), F.lit(" ("), integer(count), F.lit(f" {noun})"))


def signed_points(value: Column | str, digits: int = 1) -> Column:
    """+5.8pp"""
    value = round_half_up(value, digits)
    sign = F.when(value < 0, F.lit("")).otherwise(F.lit("+"))
    return F.concat(sign, _fixed(value, digits), F.lit("pp"))


def display_format(value: Column | str, pattern: str) -> Column:
    """One of: money_k, percent, integer, points, score."""
    formats = {
        "money_k": money_k,
        "percent": percent,
        "integer": integer,
        "points": signed_points,
        "score": lambda v: F.concat(_fixed(col(v), 1), F.lit("/100")),
    }
    return formats[pattern](value)


def selected_value(values: Column | str, filtered: bool, several: str, unfiltered: str) -> Column:
    """Aggregate label of the current selection: the only value, 'several', or the unfiltered text."""
    if not filtered:
        return F.max(F.lit(unfiltered))
    values = col(values)
    only = F.min(values)
    return F.when(only == F.max(values), only).otherwise(F.lit(several))
