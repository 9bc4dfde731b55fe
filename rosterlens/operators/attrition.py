"""Leaver analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct, round_half_up, safe_divide
from rosterlens.operators.filters import attrited_only, optional_filters
from rosterlens.operators.grouping import share_of_total
from rosterlens.operators.joins import left_self_join_manager
from rosterlens.operators.ranking import cumulative_by_band
from rosterlens.operators.reshape import stack_rows

UP, DOWN = "↑ Higher in Attrited", "↓ Lower in Attrited"

# Driver metrics (label, column, divisor, decimals).
DRIVER_METRICS = (
    ("Avg Engagement Score", "engagement_score", 1, 2),
    ("Avg Satisfaction Score", "satisfaction_score", 1, 2),
    ("Avg Attendance Pct", "attendance_pct", 1, 2),
    ("Avg Performance Rating", "performance_rating", 1, 3),
    ("Avg Promotions", "promotions", 1, 3),
    ("Avg Training Hours", "training_hours", 1, 2),
    ("Avg Leave Count", "leave_count", 1, 2),
    ("Avg Salary ($K)", "salary", 1000, 1),
)


def attrition_report(employee: DataFrame, **filters) -> DataFrame:
    """Leaver detail with regret flag and replacement cost, best rated and best paid first."""
    return optional_filters(attrited_only(employee), **filters).select(
        "employee_id", "employee_name", "department", "job_level", "gender",
        F.col("years_at_company").cast("double").alias("years_at_company"), "salary", "performance_rating",
        F.col("engagement_score").cast("double").alias("engagement_score"), "promotions", "exit_reason",
        F.when(scores.is_high_performer(), "Yes").otherwise("No").alias("is_regrettable"),
        scores.replacement_cost("salary").alias("estimated_replacement_cost"),
    ).orderBy(F.desc("performance_rating"), F.desc("salary"), "employee_id")


def attrition_drivers(employee: DataFrame, metrics: Sequence[tuple[str, str, int, int]] = DRIVER_METRICS) -> DataFrame:
    """Leavers versus stayers per metric: one aggregate of sixteen means, unfolded into rows."""
    aggregates, rows = [], []
    for i, (label, column, divisor, digits) in enumerate(metrics):
        for tag, cond in (("y", scores.is_attrited()), ("n", scores.is_active())):
            value = mean(column, cond) / F.lit(float(divisor))
            aggregates.append(round_half_up(value, digits).alias(f"{tag}{i}"))
        rows.append({"metric": F.lit(label), "attrition_yes": F.col(f"y{i}"), "attrition_no": F.col(f"n{i}")})
    unfolded = stack_rows(employee.agg(*aggregates), rows)
    return unfolded.select(
        "*",
        round_half_up(F.col("attrition_yes") - F.col("attrition_no"), 3).alias("delta"),
        F.when(F.col("attrition_yes") > F.col("attrition_no"), UP).otherwise(DOWN).alias("direction"),
    )


def regrettable_split(employee: DataFrame) -> DataFrame:
    """Leavers per department by rating group, with the cost of regrettable exits."""
    low, core = F.col("performance_rating") <= 2, F.col("performance_rating") == 3
    return attrited_only(employee).groupBy("department").agg(
        n_rows().alias("total_attrited"),
        count_if(scores.is_high_performer()).alias("regrettable_count"),
        count_if(low).alias("managed_exit_count"),
        count_if(core).alias("neutral_exit_count"),
        pct(count_if(scores.is_high_performer()), n_rows()).alias("regrettable_pct"),
        F.floor(F.coalesce(F.sum(F.when(scores.is_high_performer(), F.col("salary"))), F.lit(0)) * F.lit(scores.REPLACEMENT_FACTOR))
        .cast("bigint").alias("regrettable_cost"),
        round_half_up(mean("salary", scores.is_high_performer())).alias("avg_salary_regrettable"),
    )


def exit_reasons(employee: DataFrame, include_missing: bool = False) -> DataFrame:
    """Exit reasons with counts, share and averages at exit."""
    leavers = attrited_only(employee)
    stated = F.col("exit_reason").isNotNull() & ~F.col("exit_reason").isin("N/A", "")
    if include_missing:
        leavers = leavers.withColumn("exit_reason", F.when(stated, F.col("exit_reason")).otherwise("Not Stated"))
    else:
        leavers = leavers.where(stated)
    g = leavers.groupBy("exit_reason").agg(
        n_rows().alias("exit_count"),
        round_half_up(mean("engagement_score")).alias("avg_engagement_at_exit"),
        round_half_up(mean("satisfaction_score")).alias("avg_satisfaction_at_exit"),
        round_half_up(mean("salary")).alias("avg_salary_at_exit"),
        round_half_up(mean("years_at_company")).alias("avg_tenure_at_exit"),
        round_half_up(mean("performance_rating")).alias("avg_perf_rating_at_exit"),
        pct(count_if(scores.is_high_performer()), n_rows()).alias("pct_high_performers"),
    )
    return share_of_total(g, "exit_count", name="pct_of_all_exits")


def nine_box(employee: DataFrame) -> DataFrame:
    """Engagement x performance cells with count, share, attrition, pay and strategic label."""
    g = employee.groupBy(
        bands.engagement_segment("engagement_score").alias("engagement_segment"),
        bands.performance_segment("performance_rating").alias("performance_segment"),
    ).agg(
        n_rows().alias("headcount"),
        pct(count_if(scores.is_attrited()), n_rows()).alias("attrition_rate_pct"),
        round_half_up(mean("salary")).alias("avg_salary"),
    )
    return share_of_total(g, "headcount").withColumn(
        "quadrant_label", bands.quadrant_label("engagement_segment", "performance_segment")
    )


def tenure_attrition_curve(employee: DataFrame, closed: str = "left") -> DataFrame:
    """Attrition per tenure band in band order."""
    return employee.groupBy(
        bands.tenure_band("years_at_company", closed).alias("tenure_band"),
        bands.tenure_band_index("years_at_company", closed).alias("band_index"),
    ).agg(
        n_rows().alias("headcount"), pct(count_if(scores.is_attrited()), n_rows()).alias("attrition_rate_pct")
    )


def cumulative_attrition(employee: DataFrame) -> DataFrame:
    """Running leavers and headcount over the seven tenure bands."""
    g = employee.groupBy(bands.tenure_band_sortable("years_at_company").alias("tenure_band")).agg(
        n_rows().alias("total_in_band"),
        count_if(scores.is_attrited()).alias("attrition_count"),
        pct(count_if(scores.is_attrited()), n_rows()).alias("attrition_rate_pct"),
    )
    return cumulative_by_band(
        g, "tenure_band", {"cumulative_attrition": "attrition_count", "cumulative_headcount": "total_in_band"}
    )


def decompose(employee: DataFrame, dim1: str, dim2: str | None = None) -> DataFrame:
    """Leaver counts by one or two dimensions."""
    dims = [dim1] if dim2 is None else [dim1, dim2]
    return attrited_only(employee).groupBy(*dims).agg(n_rows().alias("attrition_count"))


def promotion_overdue(employee: DataFrame, min_gap: float = 1) -> DataFrame:
    """Active employees behind the promotion pace, with status and manager name."""
    active = employee.where(scores.is_active()).select(
        "employee_id", "employee_name", "department", "job_level", "manager_id", "performance_rating", "salary",
        F.col("promotions").alias("actual_promotions"),
        round_half_up("years_at_company", 1).alias("tenure_years"),
        scores.expected_promotions("years_at_company", digits=1).alias("expected_promotions"),
        scores.promotion_gap("years_at_company", "promotions", digits=1).alias("promotion_gap"),
        round_half_up("engagement_score", 1).alias("engagement_score"),
    ).where(F.col("promotion_gap") >= min_gap)
    named = left_self_join_manager(active, employee)
    return named.withColumn("promotion_status", bands.promotion_status("promotion_gap", "performance_rating")).orderBy(
        F.desc("promotion_gap"), F.desc("performance_rating"), "employee_id"
    )


def correlations(df: DataFrame, columns: Sequence[str], outcome: Column) -> DataFrame:
    """Pearson correlation of every column with the outcome, all in one aggregate."""
    y = outcome.cast("double")
    wide = df.agg(*[F.corr(F.col(name).cast("double"), y).alias(name) for name in columns])
    return stack_rows(
        wide, [{"metric": F.lit(name), "correlation": round_half_up(F.col(name), 6)} for name in columns]
    ).orderBy("correlation", "metric")


def strongest_influencers(corr: DataFrame) -> DataFrame:
    """Names and values of the highest and lowest correlation (a handful of rows)."""
    return corr.agg(
        F.max_by("metric", F.struct("correlation", "metric")).alias("top_positive"),
        F.max("correlation").alias("top_positive_r"),
        F.min_by("metric", F.struct("correlation", "metric")).alias("top_negative"),
        F.min("correlation").alias("top_negative_r"),
    )


def insight_facts(employee: DataFrame, benchmark: float = 18.0, compa: str = "compa_ratio") -> DataFrame:
    """Figures behind the narrative: overall rates and the department with the most attrition.

    Per-department sums are taken once; the company figures are sums of those.
    """
    g = employee.groupBy("department").agg(
        n_rows().alias("n"), count_if(scores.is_attrited()).alias("left"),
        F.sum(compa).alias("compa"), F.sum("engagement_score").cast("double").alias("eng"),
        count_if(F.col("engagement_score") < 40).alias("risk"),
        F.sum(F.when(F.col("gender") == "Male", F.col("salary"))).alias("male_pay"),
        count_if(F.col("gender") == "Male").alias("male_n"),
        F.sum(F.when(F.col("gender") == "Female", F.col("salary"))).alias("female_pay"),
        count_if(F.col("gender") == "Female").alias("female_n"),
    ).withColumn("rate", F.lit(100.0) * F.col("left") / F.col("n"))
    worst = F.max_by(F.struct("department", "rate", "compa", "eng", "n"), F.struct("rate", "department"))
    total = g.agg(
        worst.alias("w"), F.sum("n").alias("n"), F.sum("left").alias("left"), F.sum("eng").alias("eng"),
        F.sum("risk").alias("risk"),
        safe_divide(F.sum("male_pay"), F.sum("male_n")).alias("male"),
        safe_divide(F.sum("female_pay"), F.sum("female_n")).alias("female"),
    )
    gap = F.abs(F.lit(100.0) * safe_divide(F.col("male") - F.col("female"), F.col("male")))
    worst_compa = F.col("w.compa") / F.col("w.n")
    return total.select(
        pct(F.col("left"), F.col("n"), 1).alias("attrition_pct"),
        round_half_up(F.lit(100.0) * F.col("left") / F.col("n") - F.lit(benchmark), 1).alias("vs_benchmark_pp"),
        F.col("w.department").alias("worst_department"),
        round_half_up(F.col("w.rate"), 1).alias("worst_department_pct"),
        round_half_up(worst_compa, 3).alias("worst_department_compa"),
        F.when(worst_compa < 0.95, "below market").otherwise("near market").alias("compa_status"),
        round_half_up(F.col("w.eng") / F.col("w.n") - F.col("eng") / F.col("n"), 1).alias("engagement_vs_company"),
        round_half_up(gap).alias("gender_pay_gap_pct"),
        F.when(gap < 2, "noise").when(gap < 5, "monitor").otherwise("material").alias("gap_class"),
        pct(F.col("risk"), F.col("n"), 1).alias("high_flight_risk_pct"),
    )


def canned_answers(name: str, employee: DataFrame) -> DataFrame:
    """The fixed questions of the insight page as named aggregates."""
    n = n_rows()
    answers: Mapping[str, tuple[str, Sequence[Column]]] = {
        "attrition_by_department": ("department", [pct(count_if(scores.is_attrited()), n, 1).alias("attrition_rate_pct")]),
        "salary_by_gender": ("gender", [round_half_up(mean("salary"), 0).alias("avg_salary")]),
        "engagement_by_level": ("job_level", [round_half_up(mean("engagement_score"), 1).alias("avg_engagement")]),
        "source_quality": ("recruitment_source", [
            round_half_up(mean("performance_rating")).alias("avg_performance"),
            pct(count_if(scores.is_active()), n).alias("retention_rate_pct"),
        ]),
        "promotion_by_department": ("department", [pct(count_if(F.col("promotions") >= 1), n, 1).alias("promotion_rate_pct")]),
    }
    by, aggregates = answers[name]
    return employee.groupBy(by).agg(*aggregates)


def department_engagement_by_level(employee: DataFrame, department: str) -> DataFrame:
    """Engagement per level of one department."""
    return employee.where(F.col("department") == department).groupBy("job_level").agg(
        n_rows().alias("headcount"), round_half_up(mean("engagement_score"), 1).alias("avg_engagement")
    )
