"""Row filters and scopes. Only predicates that are set reach the plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import scores
from rosterlens.functions.dates import month_trunc

SEARCH_COLUMNS = (
    "employee_id", "employee_name", "department", "job_level", "manager_id", "location", "salary",
    "engagement_score", "performance_rating", "attrition", "work_mode",
)


def where_all(df: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def active_only(df: DataFrame) -> DataFrame:
    return df.where(scores.is_active())


def attrited_only(df: DataFrame) -> DataFrame:
    return df.where(scores.is_attrited())


def optional_filters(df: DataFrame, department: str | None = None, min_tenure: float | None = None,
                     max_tenure: float | None = None, regrettable_only: bool = False) -> DataFrame:
    predicates = []
    if department is not None:
        predicates.append(F.col("department") == department)
    if min_tenure is not None:
        predicates.append(F.col("years_at_company") >= min_tenure)
    if max_tenure is not None:
        predicates.append(F.col("years_at_company") <= max_tenure)
    if regrettable_only:
        predicates.append(F.col("performance_rating") >= scores.HIGH_PERFORMER_RATING)
    return where_all(df, predicates)


def multi_select(df: DataFrame, **choices: Sequence) -> DataFrame:
    """Column in list for every non-empty list."""
    return where_all(df, [F.col(c).isin(list(values)) for c, values in choices.items() if values])


def range_filter(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range; an open end adds no predicate."""
    predicates = []
    if low is not None:
        predicates.append(F.col(column) >= low)
    if high is not None:
        predicates.append(F.col(column) <= high)
    return where_all(df, predicates)


def name_search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive literal substring; a missing name never matches."""
    return df.where(F.contains(F.lower(F.col(column)), F.lit(text.lower()))) if text else df


def attrition_view(df: DataFrame, view: str = "all") -> DataFrame:
    """Leavers: 'all', 'voluntary' or 'regrettable'."""
    views = {
        "all": scores.is_attrited(),
        "voluntary": scores.is_voluntary(),
        "regrettable": scores.is_regrettable() == 1,
    }
    return df.where(views[view])


def not_null_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def snapshot_eligibility(df: DataFrame, month_end: Column | str = "month_end", status: str = "employment_status_code",
                         terminated: str = "termination_date") -> DataFrame:
    """Keep rows not terminated, or terminated on or after the first day of the snapshot month."""
    month_end = F.col(month_end) if isinstance(month_end, str) else month_end
    return df.where((F.col(status) != "Terminated") | (F.col(terminated) >= month_trunc(month_end)))


def exact_lag_filter(df: DataFrame, day_col: str, as_of: str, lag_days: int = 7) -> DataFrame:
    """Rows dated exactly `lag_days` before the reference day."""
    return df.where(F.col(day_col) == F.date_sub(F.lit(as_of).cast("date"), lag_days))


def employee_search(df: DataFrame, name: str = "", choices: Mapping[str, Sequence] | None = None,
                    ranges: Mapping[str, tuple] | None = None, n: int = 200) -> DataFrame:
    """Name, list and range filters combined; the first n matches by employee id."""
    found = multi_select(name_search(df, "employee_name", name), **(choices or {}))
    for column, (low, high) in (ranges or {}).items():
        found = range_filter(found, column, low, high)
    return found.select(*[c for c in SEARCH_COLUMNS if c in df.columns]).orderBy("employee_id").limit(n)
