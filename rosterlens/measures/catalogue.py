"""Named measures and their evaluation over any grouping.

A measure is an aggregate expression, an exact quantile of a column, or an expression over
other measures. `evaluate` issues one groupBy for all plain aggregates and one two-level
aggregate per quantile column, then combines them on the group keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions import bands, display, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, round_half_up, safe_divide
from rosterlens.operators.grouping import exact_quantiles


@dataclass(frozen=True)
class Measure:
    """agg: plain aggregate. quantile: (column, probability). derive: expression over `uses`."""

    name: str
    section: str
    agg: Callable[[], Column] | None = None
    quantile: tuple[str, float] | None = None
    derive: Callable[[], Column] | None = None
    uses: tuple[str, ...] = field(default=())
    digits: int | None = None


MEASURES: dict[str, Measure] = {}


def _add(section: str, name: str, agg=None, *, quantile=None, derive=None, uses=(), digits=None) -> None:
    MEASURES[name] = Measure(name, section, agg, quantile, derive, tuple(uses), digits)


def _c(name: str) -> Column:
    return F.col(name)


TRAINING_COST_PER_HOUR = 50


def _male() -> Column:
    return _c("gender") == "Male"


def _female() -> Column:
    return _c("gender") == "Female"


def _new_hire() -> Column:
    return _c("years_at_company") < 1


def _referred() -> Column:
    return _c("recruitment_source") == "Employee Referral"


def share(cond: Column, among: Column | None = None) -> Column:
    """Fraction of rows (or of the rows in `among`); 0 when there are none."""
    if among is None:
        return safe_divide(count_if(cond), n_rows(), 0.0)
    return safe_divide(count_if(cond & among), count_if(among), 0.0)


# Headcount
_add("headcount", "total_employees", n_rows)
_add("headcount", "active_employees", lambda: count_if(scores.is_active()))
_add("headcount", "attrited_employees", lambda: count_if(scores.is_attrited()))
_add("headcount", "total_fte", lambda: F.sum(F.coalesce(_c("fte_value"), F.lit(1.0)).cast("decimal(14,4)")).cast("double"), digits=1)
_add("headcount", "headcount_male", lambda: count_if(_male()))
_add("headcount", "headcount_female", lambda: count_if(_female()))
_add("headcount", "headcount_pct_female", lambda: share(_female()), digits=6)

# Attrition
_add("attrition", "attrition_rate", lambda: share(scores.is_attrited()), digits=6)
_add("attrition", "attrition_rate_text", derive=lambda: display.percent("attrition_rate"), uses=["attrition_rate"])
_add("attrition", "voluntary_attrition", lambda: count_if(scores.is_voluntary()))
_add("attrition", "voluntary_attrition_rate", lambda: share(scores.is_voluntary()), digits=6)
_add("attrition", "regrettable_attrition", lambda: count_if(scores.is_attrited() & scores.is_high_performer()))
_add("attrition", "regrettable_attrition_rate", lambda: share(scores.is_attrited() & scores.is_high_performer()), digits=6)
_add("attrition", "new_hire_attrition", lambda: count_if(scores.is_attrited() & _new_hire()))
_add("attrition", "new_hire_attrition_rate", lambda: share(scores.is_attrited(), _new_hire()), digits=6)
_add("attrition", "attrition_rag", derive=lambda: bands.rag("attrition_rate", 0.18, 0.25), uses=["attrition_rate"])

# Compensation
_add("compensation", "avg_salary", lambda: mean("salary"), digits=2)
_add("compensation", "median_salary", quantile=("salary", 0.5), digits=2)
_add("compensation", "total_salary_cost", lambda: F.sum("salary"))
_add("compensation", "total_bonus_cost", lambda: F.sum("bonus"))
_add("compensation", "total_compensation_cost", lambda: F.sum(_c("salary") + _c("bonus")))
_add("compensation", "avg_total_compensation", lambda: safe_divide(F.sum(_c("salary") + _c("bonus")), n_rows(), 0.0), digits=2)
_add("compensation", "avg_compa_ratio", lambda: F.avg("compa_ratio_raw"), digits=4)
_add("compensation", "pct_below_market", lambda: share(_c("salary") < _c("level_median_salary") * 0.80), digits=6)
_add("compensation", "gender_pay_gap_pct",
     lambda: safe_divide(mean("salary", _male()) - mean("salary", _female()), mean("salary", _male()), 0.0), digits=6)
_add("compensation", "gender_pay_gap_amt", lambda: mean("salary", _male()) - mean("salary", _female()), digits=2)
_add("compensation", "salary_percentile_25", quantile=("salary", 0.25), digits=2)
_add("compensation", "salary_percentile_75", quantile=("salary", 0.75), digits=2)
_add("compensation", "salary_percentile_90", quantile=("salary", 0.90), digits=2)
_add("compensation", "compensation_iqr", derive=lambda: _c("salary_percentile_75") - _c("salary_percentile_25"),
     uses=["salary_percentile_75", "salary_percentile_25"], digits=2)

# Engagement
_add("engagement", "avg_engagement_score", lambda: mean("engagement_score"), digits=4)
_add("engagement", "median_engagement_score", quantile=("engagement_score", 0.5), digits=4)
_add("engagement", "avg_satisfaction_score", lambda: mean("satisfaction_score"), digits=4)
_add("engagement", "engagement_index", lambda: mean("engagement_score") / 10, digits=1)
_add("engagement", "high_flight_risk_employees", lambda: count_if(scores.is_disengaged()))
_add("engagement", "medium_flight_risk_employees",
     lambda: count_if((_c("engagement_score") >= 40) & (_c("engagement_score") < 60)))
_add("engagement", "low_flight_risk_employees",
     lambda: count_if((_c("engagement_score") >= 60) & (_c("engagement_score") < 75)))
_add("engagement", "engaged_employees", lambda: count_if(_c("engagement_score") >= 75))
_add("engagement", "pct_high_flight_risk", lambda: share(scores.is_disengaged()), digits=6)
_add("engagement", "enps_score",
     lambda: safe_divide(
         F.lit(100.0) * (count_if(_c("satisfaction_score") >= 80) - count_if(_c("satisfaction_score") < 40)), n_rows(), 0.0),
     digits=0)
_add("engagement", "engagement_rag", derive=lambda: bands.engagement_rag("avg_engagement_score"), uses=["avg_engagement_score"])

# Performance
_add("performance", "avg_performance_rating", lambda: mean("performance_rating"), digits=4)
for _rating, _label in ((5, "distinguished"), (4, "exceeds_expectations"), (3, "meets_expectations"),
                        (2, "below_expectations"), (1, "unacceptable")):
    _add("performance", f"pct_{_label}", lambda r=_rating: share(_c("performance_rating") == r), digits=6)
_add("performance", "high_performers", lambda: count_if(scores.is_high_performer()))
_add("performance", "pct_high_performers", lambda: share(scores.is_high_performer()), digits=6)
_add("performance", "perf_rating_attrited", lambda: mean("performance_rating", scores.is_attrited()), digits=4)
_add("performance", "perf_rating_active", lambda: mean("performance_rating", scores.is_active()), digits=4)

# Attendance
_add("attendance", "avg_attendance_pct", lambda: mean("attendance_pct"), digits=4)
_add("attendance", "total_leave_days", lambda: F.sum("leave_count"))
_add("attendance", "avg_leave_days", lambda: mean("leave_count"), digits=4)
_add("attendance", "chronic_absenteeism_count", lambda: count_if(_c("attendance_pct") < 85))
_add("attendance", "chronic_absenteeism_rate", lambda: share(_c("attendance_pct") < 85), digits=6)
_add("attendance", "attendance_rag", derive=lambda: bands.attendance_rag("avg_attendance_pct"), uses=["avg_attendance_pct"])
_add("attendance", "attendance_high_risk", lambda: mean("attendance_pct", scores.is_disengaged()), digits=4)

# Training
_add("training", "total_training_hours", lambda: F.sum("training_hours").cast("double"), digits=1)
_add("training", "avg_training_hours", lambda: mean("training_hours"), digits=4)
_add("training", "avg_training_hours_active", lambda: mean("training_hours", scores.is_active()), digits=4)
_add("training", "avg_training_hours_attrited", lambda: mean("training_hours", scores.is_attrited()), digits=4)
_add("training", "training_hours_delta",
     lambda: mean("training_hours", scores.is_active()) - mean("training_hours", scores.is_attrited()), digits=4)
_add("training", "training_cost_estimate",
     lambda: F.sum("training_hours").cast("double") * TRAINING_COST_PER_HOUR, digits=0)
_add("training", "training_hours_percentile_90", quantile=("training_hours", 0.90), digits=2)

# Tenure and career
_add("career", "avg_years_at_company", lambda: mean("years_at_company"), digits=4)
_add("career", "median_years_at_company", quantile=("years_at_company", 0.5), digits=4)
_add("career", "avg_promotions", lambda: mean("promotions"), digits=4)
_add("career", "promoted_employees", lambda: count_if(_c("promotions") >= 1))
_add("career", "promotion_rate", lambda: share(_c("promotions") >= 1), digits=6)
_add("career", "promotion_rate_active", lambda: share(_c("promotions") >= 1, scores.is_active()), digits=6)
_add("career", "promotion_rate_attrited", lambda: share(_c("promotions") >= 1, scores.is_attrited()), digits=6)
_add("career", "avg_promotion_gap",
     lambda: F.try_divide(
         F.sum("years_at_company").cast("double") / scores.PROMOTION_PACE_YEARS - F.sum("promotions"), n_rows()), digits=4)
_add("career", "employees_with_promotion_gap",
     lambda: count_if(scores.promotion_gap_raw("years_at_company", "promotions") > 2))

# Talent acquisition
_add("talent", "source_attrition_rate", lambda: share(scores.is_attrited()), digits=6)
_add("talent", "internal_hire_rate", lambda: share(_c("recruitment_source") == "Internal Transfer"), digits=6)
_add("talent", "referral_hire_rate", lambda: share(_referred()), digits=6)
_add("talent", "referral_attrition_rate", lambda: share(scores.is_attrited(), _referred()), digits=6)

# Manager
_add("manager", "team_size", n_rows)
_add("manager", "manager_effectiveness_score",
     lambda: mean("engagement_score") / 100 * 40 + (F.lit(1.0) - share(scores.is_attrited())) * 40 + share(_c("promotions") >= 1) * 20,
     digits=1)
_add("manager", "team_attrition_rate", lambda: share(scores.is_attrited()), digits=6)
_add("manager", "avg_team_engagement", lambda: mean("engagement_score"), digits=4)

# Insight
_add("insight", "flight_risk_score", lambda: F.avg(round_half_up(scores.flight_risk_composite(), 6)), digits=4)
_add("insight", "attrition_revenue_impact",
     lambda: F.coalesce(F.sum(F.when(scores.is_attrited(), _c("salary"))), F.lit(0)).cast("double") * scores.REPLACEMENT_FACTOR, digits=1)
_add("insight", "attrition_cost_per_employee",
     lambda: safe_divide(F.coalesce(F.sum(F.when(scores.is_attrited(), _c("salary"))), F.lit(0)).cast("double")
                         * F.lit(scores.REPLACEMENT_FACTOR), count_if(scores.is_attrited()), 0.0), digits=2)
_add("insight", "gender_diversity_index",
     lambda: F.lit(1.0) - sum(
         (safe_divide(count_if(_c("gender") == g), n_rows()) * safe_divide(count_if(_c("gender") == g), n_rows())
          for g in ("Female", "Non-binary")),
         start=safe_divide(count_if(_male()), n_rows()) * safe_divide(count_if(_male()), n_rows())), digits=4)
_add("insight", "attrition_vs_benchmark", lambda: share(scores.is_attrited()) - scores.ATTRITION_BENCHMARK, digits=6)
_add("insight", "engagement_vs_benchmark", lambda: mean("engagement_score") - scores.ENGAGEMENT_BENCHMARK, digits=4)
_add("insight", "retention_score", lambda: F.avg(round_half_up(scores.retention_score(), 6)), digits=4)

# Display
_add("display", "attrition_rate_formatted",
     derive=lambda: display.percent_with_count("attrition_rate", "attrited_employees"),
     uses=["attrition_rate", "attrited_employees"])
_add("display", "avg_salary_formatted",
     derive=lambda: F.concat(display.money_k("avg_salary"), F.lit(" avg | "), display.money_k("median_salary"), F.lit(" median")),
     uses=["avg_salary", "median_salary"])
_add("display", "engagement_formatted",
     derive=lambda: F.concat(
         display.display_format("avg_engagement_score", "score"), F.lit(" — "),
         F.when(_c("engagement_rag") == "Green", "Healthy").when(_c("engagement_rag") == "Amber", "Monitor")
         .otherwise("Action Required")),
     uses=["avg_engagement_score", "engagement_rag"])


def section(name: str) -> list[str]:
    return [m.name for m in MEASURES.values() if m.section == name]


def _with_dependencies(names: Sequence[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for used in MEASURES[name].uses:
            visit(used)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _rounded(measure: Measure, expr: Column) -> Column:
    return expr if measure.digits is None else round_half_up(expr, measure.digits)


def evaluate(df: DataFrame, measures: Sequence[str], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """One row per group with the requested measures as columns."""
    if where is not None:
        df = df.where(where)
    keys = list(by)
    needed = [MEASURES[n] for n in _with_dependencies(measures)]

    plain = [m for m in needed if m.agg is not None]
    result = df.groupBy(*keys).agg(n_rows().alias("__rows"), *[_rounded(m, m.agg()).alias(m.name) for m in plain])

    by_column: dict[str, dict[str, float]] = {}
    for m in needed:
        if m.quantile is not None:
            by_column.setdefault(m.quantile[0], {})[m.name] = m.quantile[1]
    for column, probs in by_column.items():
        quantiles = exact_quantiles(df, keys, column, probs)
        if keys:
            result = result.join(quantiles, keys, "left")
            values = {name: F.col(name) for name in probs}
        else:
            values = {name: quantiles.select(name).scalar() for name in probs}
        result = result.withColumns({name: _rounded(MEASURES[name], value) for name, value in values.items()})

    for m in needed:
        if m.derive is not None:
            result = result.withColumn(m.name, _rounded(m, m.derive()))
    return result.select(*by, *measures)


def versus_company(df: DataFrame, by: Sequence[str], measure: str = "avg_engagement_score", name: str = "vs_company") -> DataFrame:
    """Measure per group minus the same measure over all rows (a one-row subquery)."""
    company = evaluate(df, [measure]).scalar()
    return evaluate(df, [measure], by).withColumn(name, round_half_up(F.col(measure) - company, 4))


def managers_over_threshold(df: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Managers whose share of ratings 1-2 exceeds the threshold (no team size floor)."""
    teams = df.groupBy("manager_id").agg(share(_c("performance_rating") <= 2).alias("low"))
    return teams.agg(count_if(_c("low") > threshold).alias("managers_exceeding_threshold"))


def span_of_control(df: DataFrame) -> DataFrame:
    """Reports over distinct managers, and over managers in each group's own rows."""
    teams = df.where(_c("manager_id").isNotNull()).groupBy("manager_id").agg(n_rows().alias("n"))
    return teams.agg(round_half_up(safe_divide(F.sum("n"), n_rows()), 4).alias("span_of_control"))


def subtitle(df: DataFrame, filtered: bool) -> DataFrame:
    """Selected department, selected location and the dashboard subtitle."""
    g = df.agg(
        display.selected_value("department", filtered, "Multiple Departments", "All Departments").alias("selected_department"),
        display.selected_value("location", filtered, "Multiple Locations", "All Locations").alias("selected_location"),
        n_rows().alias("n"),
    )
    return g.select(
        "selected_department", "selected_location",
        F.concat(F.lit("Showing: "), "selected_department", F.lit(" | "), "selected_location", F.lit(" | n = "),
                 display.integer("n"), F.lit(" employees")).alias("dashboard_subtitle"),
    )


def monthly_trend(fact: DataFrame, month: str = "month_end", headcount: str = "headcount", exits: str = "exits",
                  pay: str = "pay") -> DataFrame:
    """Monthly attrition rate with year-to-date, same month last year, change, arrow and pay change.

    The fact (rows or cohorts carrying head count, exits and total pay) is reduced to one row
    per month before any ordering; last year's row is found by its date, so a missing month
    yields no comparison instead of a shifted one.
    """
    months = fact.groupBy(month).agg(
        F.sum(headcount).alias("headcount"), F.sum(exits).alias("exits"),
        safe_divide(F.sum(pay), F.sum(headcount)).alias("avg_salary"),
    )
    year = Window.partitionBy(F.year(month)).orderBy(month).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rated = months.withColumn("rate", safe_divide(F.col("exits"), F.col("headcount"), 0.0)).withColumn(
        "ytd", safe_divide(F.sum("exits").over(year), F.sum("headcount").over(year), 0.0)
    )
    last_year = rated.select(
        F.last_day(F.add_months(month, 12)).alias(month), F.col("rate").alias("py"), F.col("avg_salary").alias("pay_py")
    )
    joined = rated.join(last_year, month, "left")
    arrow = F.when(F.col("py").isNull(), "—").when(F.col("rate") > F.col("py"), "▲").otherwise("▼")
    return joined.select(
        month, "headcount", "exits",
        round_half_up("rate", 6).alias("attrition_rate"),
        round_half_up("ytd", 6).alias("attrition_rate_ytd"),
        round_half_up("py", 6).alias("attrition_rate_py"),
        round_half_up(F.col("rate") - F.col("py"), 6).alias("attrition_rate_change_vs_py"),
        arrow.alias("attrition_trend"),
        round_half_up(F.col("avg_salary") - F.col("pay_py")).alias("avg_salary_change_vs_py"),
    )
