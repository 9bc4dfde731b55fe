"""Calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.numeric import col

FISCAL_START_MONTH = 4


def safe_date(raw: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Date from text, null when the text is not one."""
    return F.try_to_date(col(raw), fmt)


def date_diff_calendar(unit: str, start: Column | str, end: Column | str) -> Column:
    """Calendar boundaries crossed between two dates (year, quarter, month or day)."""
    start, end = col(start), col(end)
    if unit == "day":
        return F.datediff(end, start)
    years = F.year(end) - F.year(start)
    if unit == "year":
        return years
    if unit == "month":
        return years * 12 + F.month(end) - F.month(start)
    if unit == "quarter":
        return years * 4 + F.quarter(end) - F.quarter(start)
    raise ValueError(f"unknown unit {unit!r}")


def age_years(birth: Column | str, as_of: Column | str, exact: bool = False) -> Column:
    """Calendar-year difference, or completed years with exact=True."""
    birth, as_of = col(birth), col(as_of)
    if exact:
        return F.floor(F.months_between(as_of, birth) / 12).cast("int")
    return date_diff_calendar("year", birth, as_of)


def month_trunc(day: Column | str) -> Column:
    return F.trunc(col(day), "MM")


def date_key(day: Column | str) -> Column:
    """YYYYMMDD integer."""
    day = col(day)
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def fiscal_columns(day: Column | str, start_month: int = FISCAL_START_MONTH) -> dict[str, Column]:
    """Fiscal year (named by the calendar year it ends in), quarter and period with their labels."""
    day = col(day)
    shifted = F.add_months(day, 1 - start_month)
    year = F.year(shifted) + (1 if start_month > 1 else 0)
    quarter, period = F.quarter(shifted), F.month(shifted)
    label = F.concat(F.lit("FY"), F.lpad((year % 100).cast("string"), 2, "0"))
    return {
        "fiscal_year": year.cast("int"),
        "fiscal_quarter_num": quarter.cast("int"),
        "fiscal_quarter_label": F.concat(label, F.lit("-Q"), quarter.cast("string")),
        "fiscal_month_num": period.cast("int"),
        "fiscal_period_label": F.concat(label, F.lit("-P"), F.lpad(period.cast("string"), 2, "0")),
    }
