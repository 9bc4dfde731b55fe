"""Date dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.functions.dates import FISCAL_START_MONTH, date_key, fiscal_columns


def date_dimension(spark: SparkSession, start: str = "2018-01-01", end: str = "2030-12-31",
                   fiscal_start: int = FISCAL_START_MONTH, as_of: str | None = None,
                   company_holidays: list[str] | None = None) -> DataFrame:
    """One row per day with calendar, ISO week and fiscal attributes.

    Relative offsets count from `as_of` (today when None).
    """
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")
    )
    d = F.col("full_date")
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    dow = F.weekday(d) + 1
    month_end = d == F.last_day(d)
    # ISO year: the year of the Thursday of the same week.
    iso_year = F.year(F.date_add(d, 4 - dow))
    return days.select(
        date_key(d).alias("date_key"),
        d,
        dow.cast("int").alias("day_of_week_num"),
        F.date_format(d, "EEEE").alias("day_of_week_name"),
        F.date_format(d, "EEE").alias("day_of_week_short"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.concat(iso_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")).alias("iso_year_week"),
        F.month(d).alias("month_num"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short"),
        F.date_format(d, "MMM-yyyy").alias("month_year"),
        F.quarter(d).alias("quarter_num"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_label"),
        F.year(d).alias("year_num"),
        F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
        (dow <= 5).alias("is_weekday_flag"),
        (dow > 5).alias("is_weekend_flag"),
        F.date_format(d, "yyyy-MM-dd").isin(list(company_holidays or [])).alias("is_company_holiday_flag"),
        us_federal_holiday(d).alias("is_us_federal_holiday_flag"),
        month_end.alias("is_month_end_flag"),
        (month_end & (F.month(d) % 3 == 0)).alias("is_quarter_end_flag"),
        (month_end & (F.month(d) == 12)).alias("is_year_end_flag"),
        *[c.alias(name) for name, c in fiscal_columns(d, fiscal_start).items()],
        F.dayofmonth(F.last_day(d)).alias("days_in_month"),
        F.datediff(d, today).alias("relative_day_offset"),
        ((F.year(d) - F.year(today)) * 12 + F.month(d) - F.month(today)).alias("relative_month_offset"),
    )


def us_federal_holiday(day):
    """Federal holidays on their calendar day (not the observed weekday)."""
    month, dom, dow = F.month(day), F.dayofmonth(day), F.weekday(day) + 1
    nth = F.ceil(dom / F.lit(7.0))
    fixed = ((month == 1) & (dom == 1)) | ((month == 6) & (dom == 19)) | ((month == 7) & (dom == 4)) | (
        (month == 11) & (dom == 11)) | ((month == 12) & (dom == 25))
    monday = (dow == 1) & (
        ((month == 1) & (nth == 3)) | ((month == 2) & (nth == 3)) | ((month == 5) & (dom > 24))
        | ((month == 9) & (nth == 1)) | ((month == 10) & (nth == 2))
    )
    thanksgiving = (month == 11) & (dow == 4) & (nth == 4)
    return fixed | monday | thanksgiving


def month_ends(dates: DataFrame, after: str | None = None) -> DataFrame:
    """Month-end days, optionally only those after a high-water mark."""
    ends = dates.where("is_month_end_flag")
    return ends if after is None else ends.where(F.col("full_date") > F.lit(after).cast("date"))
