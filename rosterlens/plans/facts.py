"""Monthly snapshot fact, serving views and current-state views."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import bands, scores
from rosterlens.functions.dates import date_diff_calendar, date_key
from rosterlens.functions.numeric import round_half_up
from rosterlens.operators.filters import snapshot_eligibility
from rosterlens.operators.joins import gold_star_join, latest_then_left_join, left_using_joins, month_spine_rows, star_join
from rosterlens.operators.ranking import latest_per_key
from rosterlens.operators.sequence import carried_forward


def employee_snapshot_fact(employees: DataFrame, first: str, last: str, dims: Mapping[str, DataFrame] | None = None,
                           compensation: DataFrame | None = None, survey: DataFrame | None = None,
                           risk: DataFrame | None = None, since: str | None = None,
                           each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Employee x month end, from the hire month up to the termination month.

    employees: employee_id, hire_date, termination_date, employment_status_code, fte_value, dimension ids.
    compensation: employee_id, effective_date, compa_ratio, base_salary (open rows only are used when
    end_date is present). survey: employee_id, survey_date, score. risk: employee_id, risk_score.
    Histories are cut to their newest row per employee before the join, and employees get those
    attributes before they are repeated per month, so the joins run on one row per employee.
    since: only months after this day (incremental loads).
    each: a step that needs no month (joins and filters on attributes, sums of employees with the same months); it takes the employees
    before their months multiply and keeps hire_date, termination_date and employment_status_code.
    """
    rows = employees.withColumns({
        "fte_value": F.coalesce(F.col("fte_value"), F.lit(1.0)), "is_active_flag": F.col("employment_status_code") == "Active",
    })
    if compensation is not None:
        if "end_date" in compensation.columns:
            compensation = compensation.where(F.col("end_date").isNull()).drop("end_date")
        newest = latest_per_key(compensation, ["employee_id"], ["effective_date"]).drop("effective_date")
        rows = rows.join(newest, "employee_id", "left")
    if survey is not None:
        newest = latest_per_key(survey, ["employee_id"], ["survey_date"]).select(
            "employee_id", F.col("score").alias("engagement_score")
        )
        rows = rows.join(newest, "employee_id", "left")
    if risk is not None:
        rows = rows.join(risk.select("employee_id", F.col("risk_score").alias("flight_risk_score")), "employee_id", "left")
    for key, dim in (dims or {}).items():
        surrogate = next(c for c in dim.columns if c != key)
        rows = left_using_joins(rows, {key: dim}, {surrogate: -1})
    rows = rows if each is None else each(rows)
    start = F.col("hire_date")
    if since is not None:
        start = F.greatest(start, F.date_add(F.last_day(F.lit(since).cast("date")), 1))
    end = F.coalesce("termination_date", F.lit(last).cast("date"))
    monthly = snapshot_eligibility(month_spine_rows(rows, start, end, first, last))
    months = date_diff_calendar("month", "hire_date", "month_end")
    exits = F.col("termination_date").isNotNull() & (F.last_day("termination_date") == F.col("month_end"))
    return monthly.withColumns({
        "date_key": date_key("month_end"),
        "tenure_months": months,
        "tenure_band_code": bands.tenure_band_months(months),
        "is_exit": exits,
    })


def current_employees_view(fact: DataFrame, dims: Mapping[str, DataFrame], manager: DataFrame | None = None) -> DataFrame:
    """Active rows of the fact, or active employees before their months multiply, with full dimensional context."""
    return gold_star_join(fact.where("is_active_flag"), dims, manager)


def attrition_events_view(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Exit rows (a known voluntary or involuntary exit) with cohort context."""
    exits = fact.where(F.col("is_exit") & F.col("voluntary_exit_flag").isNotNull())
    return gold_star_join(exits, dims).withColumnRenamed("tenure_months", "tenure_at_exit")


def as_of_version_join(fact: DataFrame, versions: DataFrame, key: str, day: str, columns: Sequence[str],
                       bucket: Callable[[Column], Column] = lambda day: F.trunc(day, "MM")) -> DataFrame:
    """Attach the dimension version valid on the fact's day (open end = still valid);
    facts without one keep nulls. Versions are carried forward in time, so facts are joined with no version range.

    Where versions overlap, the one that starts last counts.
    """
    start, end = "effective_start_date", "effective_end_date"
    found = carried_forward(fact, versions, [key], day, start, [end, *columns], bucket, "__v")
    valid = F.col(f"__v.{end}").isNull() | (F.col(day) < F.col(f"__v.{end}"))
    return found.select(*fact.columns, *[F.when(valid, F.col(f"__v.{c}")).alias(c) for c in columns])


def latest_risk_view(employee: DataFrame, history: DataFrame, order: Sequence[str]) -> DataFrame:
    """Active employees with their newest score."""
    return latest_then_left_join(employee.where(scores.is_active()), history, "employee_id", order)


def master_view(employee: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Every label and derived column of the employee."""
    joined = star_join(employee, dims)
    return joined.withColumns({
        "age_band": bands.age_band("age"),
        "tenure_band": bands.tenure_band("years_at_company"),
        "salary_band": bands.salary_band("salary"),
        "engagement_tier": bands.engagement_tier("engagement_score"),
        "total_comp": scores.total_comp("salary", "bonus"),
        "band_midpoint": scores.band_midpoint("band_min", "band_max"),
        "compa_ratio": round_half_up(scores.compa_ratio_band_mid("salary", "band_min", "band_max"), 4),
        "expected_promotions": scores.expected_promotions("years_at_company"),
        "promotion_gap": scores.promotion_gap("years_at_company", "promotions"),
        "attrition_flag": scores.attrition_flag(),
        "is_regrettable_exit": scores.is_regrettable(),
    })

