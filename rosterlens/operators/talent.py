"""Recruitment, performance, diversity and search reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct, round_half_up, safe_divide
from rosterlens.operators.grouping import share_of_total, value_counts
from rosterlens.operators.ranking import percent_rank, rank_desc, same_keys, stacked_positions, view_lookup
from rosterlens.operators.reshape import domain_index, stack_rows, top_k

INTERNAL = "Internal Transfer"
GENDERS = ("Male", "Female", "Non-binary")
HRBP_FLAG = "Bottom 10% — Flag for HRBP"


# --- recruitment -----------------------------------------------------------------------


def source_quality(employee: DataFrame, weights: Sequence[float] = (35, 35, 30)) -> DataFrame:
    """Per hiring source: volume, retention, averages and a 0-100 quality composite."""
    perf_w, keep_w, eng_w = weights
    g = employee.groupBy("recruitment_source", "source_type").agg(
        n_rows().alias("total_hires"),
        count_if(scores.is_active()).alias("active_count"),
        pct(count_if(scores.is_active()), n_rows()).alias("retention_rate_pct"),
        pct(count_if(scores.is_attrited()), n_rows()).alias("attrition_rate_pct"),
        round_half_up(mean("performance_rating"), 3).alias("avg_perf_rating"),
        round_half_up(mean("engagement_score")).alias("avg_engagement"),
        round_half_up(mean("years_at_company")).alias("avg_tenure_years"),
        round_half_up(mean("salary")).alias("avg_salary"),
        round_half_up(
            mean("performance_rating") / 5 * perf_w
            + safe_divide(count_if(scores.is_active()), n_rows()) * keep_w
            + mean("engagement_score") / 100 * eng_w
        ).alias("quality_of_hire_score"),
    )
    return share_of_total(g, "total_hires", name="hire_share_pct")


def source_rank(employee: DataFrame) -> DataFrame:
    """Sources ranked by volume within department x level; the window runs over the small aggregate."""
    g = employee.groupBy("department", "job_level", "recruitment_source").agg(
        n_rows().alias("hire_count"),
        round_half_up(mean("performance_rating")).alias("avg_performance"),
        pct(count_if(scores.is_attrited()), n_rows()).alias("attrition_pct"),
    )
    window = Window.partitionBy("department", "job_level").orderBy(F.desc("hire_count"))
    return g.withColumn("source_rank_in_dept_level", F.rank().over(window).cast("bigint"))


def internal_mobility(employee: DataFrame, internal: str = INTERNAL) -> DataFrame:
    """Internal hires per department against external ones."""
    inside = F.col("recruitment_source") == internal
    outside = F.col("recruitment_source") != internal
    return employee.groupBy("department").agg(
        n_rows().alias("total_employees"),
        count_if(inside).alias("internal_hires"),
        pct(count_if(inside), n_rows()).alias("internal_hire_rate_pct"),
        round_half_up(mean("performance_rating", inside), 3).alias("internal_avg_perf"),
        round_half_up(mean("performance_rating", outside), 3).alias("external_avg_perf"),
        pct(count_if(inside & scores.is_active()), count_if(inside)).alias("internal_retention_pct"),
        pct(count_if(outside & scores.is_active()), count_if(outside)).alias("external_retention_pct"),
    )


def source_by_department(employee: DataFrame, k: int = 5) -> DataFrame:
    """Source counts within the k largest departments (by size, then name)."""
    counts = employee.groupBy("department", "recruitment_source").agg(n_rows().alias("n"))
    sizes = counts.groupBy("department").agg(F.sum("n").alias("size"))
    largest = top_k(sizes, [F.desc("size"), F.col("department")], k)
    return counts.join(F.broadcast(largest.select("department")), "department", "left_semi")


def source_ranking_top1(df: DataFrame, by: str, measure: Column, name: str = "measure") -> DataFrame:
    """Category with the largest measure."""
    g = df.groupBy(by).agg(measure.alias(name))
    return g.agg(F.max_by(by, F.struct(name, by)).alias(by), F.max(name).alias(name))


def source_gender_mix(df: DataFrame, by: str = "recruitment_source", of: str = "gender") -> DataFrame:
    counts = df.groupBy(by, of).agg(n_rows().alias("n"))
    return share_of_total(counts, "n", [by], "pct")


# --- performance -----------------------------------------------------------------------


def rating_distribution_vs_target(employee: DataFrame, ratings: DataFrame) -> DataFrame:
    """Actual share per rating against the target curve, zero-filled."""
    categories = [1, 2, 3, 4, 5]
    counts = share_of_total(value_counts(employee, "performance_rating", categories), "n", name="actual_pct")
    named = counts.join(F.broadcast(ratings), "performance_rating")
    return named.select(
        "performance_rating", "performance_label", "n", "actual_pct",
        F.col("target_pct").cast("double").alias("target_pct"),
        round_half_up(F.col("actual_pct") - F.col("target_pct")).alias("difference_pp"),
    )


def calibration_outliers(employee: DataFrame, min_team: int = 3, threshold_pct: float = 15) -> DataFrame:
    """Managers whose share of ratings 1-2 exceeds the threshold."""
    low = F.col("performance_rating") <= 2
    g = employee.where(F.col("manager_id").isNotNull()).groupBy("manager_id").agg(
        n_rows().alias("team_size"), count_if(low).alias("__low"),
        round_half_up(mean("performance_rating")).alias("avg_rating"),
    )
    share = F.lit(100.0) * F.col("__low") / F.col("team_size")
    return g.where((F.col("team_size") >= min_team) & (share > threshold_pct)).select(
        "manager_id", "team_size", round_half_up(share).alias("pct_below_expectations"), "avg_rating"
    )


def training_by_rating(employee: DataFrame) -> DataFrame:
    return employee.groupBy("performance_rating").agg(round_half_up(mean("training_hours")).alias("avg_training_hours"))


def retention_gap(employee: DataFrame, tolerance: float = 2) -> DataFrame:
    """Overall against high-performer retention; inverted when the latter is lower beyond the tolerance."""
    g = employee.agg(
        (F.lit(100.0) * safe_divide(count_if(scores.is_active()), n_rows())).alias("a"),
        (F.lit(100.0) * safe_divide(count_if(scores.is_active() & scores.is_high_performer()), count_if(scores.is_high_performer()))).alias("h"),
    )
    gap = F.col("h") - F.col("a")
    return g.select(
        round_half_up("a").alias("overall_retention_pct"), round_half_up("h").alias("high_performer_retention_pct"),
        round_half_up(gap).alias("gap_pp"), F.when(gap < -tolerance, "inverted").otherwise("healthy").alias("pattern"),
    )


def enps(employee: DataFrame, promoter_from: float = 80, detractor_below: float = 40) -> DataFrame:
    """Promoters minus detractors of the satisfaction score, in whole points."""
    promoters = count_if(F.col("satisfaction_score") >= promoter_from)
    detractors = count_if(F.col("satisfaction_score") < detractor_below)
    return employee.agg(
        promoters.alias("promoters"), detractors.alias("detractors"),
        pct(promoters - detractors, n_rows(), 0, 0.0).alias("enps"),
    )


# --- diversity -------------------------------------------------------------------------


def diversity_index(df: DataFrame, column: str = "gender") -> DataFrame:
    """Simpson index 1 - sum of squared shares."""
    counts = df.groupBy(column).agg(n_rows().alias("n"))
    n = F.sum("n").cast("double")
    return counts.agg(
        round_half_up(F.lit(1.0) - F.sum(F.col("n").cast("double") * F.col("n")) / (n * n), 4).alias("diversity_index")
    )


def representation_by_level(employee: DataFrame) -> DataFrame:
    """Gender share per level in long form, every level x gender present."""
    wide = employee.groupBy("job_level").agg(
        n_rows().alias("n"), *[count_if(F.col("gender") == g).alias(f"g{i}") for i, g in enumerate(GENDERS)]
    )
    return stack_rows(
        wide,
        [{"gender": F.lit(g), "pct": pct(F.col(f"g{i}"), F.col("n"))} for i, g in enumerate(GENDERS)],
        ids=["job_level"],
    )


def new_vs_existing_mix(employee: DataFrame) -> DataFrame:
    """Gender mix of first-year staff and of everyone else, in long form."""
    new = F.col("years_at_company") < 1
    groups = {"New Hires": new, "Existing Workforce": F.col("years_at_company") >= 1}
    aggregates, rows = [], []
    for p, (label, cond) in enumerate(groups.items()):
        aggregates.append(count_if(cond).alias(f"n{p}"))
        for i, g in enumerate(GENDERS):
            aggregates.append(count_if(cond & (F.col("gender") == g)).alias(f"c{p}_{i}"))
            rows.append({
                "gender": F.lit(g), "population": F.lit(label), "pct": pct(F.col(f"c{p}_{i}"), F.col(f"n{p}"), 2, 0.0),
            })
    return stack_rows(employee.agg(*aggregates), rows)


# --- engagement and search -------------------------------------------------------------


def engagement_position(employee: DataFrame) -> DataFrame:
    """Active employees: deviation from the department mean, ranks in the department, company percent rank."""
    # Rating first, engagement second: one number in the same order (engagement is at most 100).
    order = (F.col("performance_rating") * 1000 + F.col("engagement_score")).cast("decimal(10,2)")
    active = employee.where(scores.is_active()).select(
        "employee_id", "employee_name", "department", "job_level", "engagement_score", "performance_rating", "salary", order.alias("__order"),
    )
    views = {
        "engagement": (["department"], "engagement_score"), "company": ([], "engagement_score"),
        "pay": (["department"], "salary"), "perf": (["department"], "__order"),
    }
    outputs = {
        "engagement": {"engagement_rank_in_dept": rank_desc(), "hrbp_flag": F.when(percent_rank() <= 0.10, HRBP_FLAG)},
        "company": {"engagement_pct_rank_company": round_half_up(F.lit(100.0) * percent_rank(), 1)},
        "pay": {"salary_rank_in_dept": rank_desc()}, "perf": {"perf_rank_in_dept": rank_desc()},
    }
    # Four views, one range pass.
    positions = stacked_positions(active.select("department", "engagement_score", "salary", "__order"), views)
    means = active.groupBy("department").agg(mean("engagement_score").alias("__mean"))
    rows = active
    for name, (keys, value) in views.items():
        rows = view_lookup(rows, positions, name, keys, value, outputs[name])
    rows = same_keys(rows, means, ["department"])
    return rows.select(
        "employee_id", "employee_name", "department", "job_level",
        F.col("engagement_score").cast("double").alias("engagement_score"), "performance_rating",
        round_half_up(F.col("engagement_score").cast("double") - F.col("__mean")).alias("eng_vs_dept_avg"),
        "engagement_rank_in_dept", "engagement_pct_rank_company", "salary_rank_in_dept", "perf_rank_in_dept", "hrbp_flag",
    )


# Profile metrics (label, column).
PROFILE_METRICS = (
    ("Engagement Score", "engagement_score"),
    ("Satisfaction Score", "satisfaction_score"),
    ("Attendance %", "attendance_pct"),
    ("Performance Rating", "performance_rating"),
    ("Training Hours", "training_hours"),
    ("Compa-Ratio", "compa_ratio"),
)


def profile_vs_peers(employee: DataFrame, metrics: Sequence[tuple[str, str]] = PROFILE_METRICS) -> DataFrame:
    """Every employee's metrics against the department mean, one row per employee and metric."""
    means = employee.groupBy("department").agg(
        *[F.try_divide(F.sum(col).cast("double"), F.count(col)).alias(f"__{col}") for _, col in metrics]
    )
    joined = same_keys(employee, means, ["department"])
    return stack_rows(
        joined,
        [
            {
                "metric": F.lit(label),
                "value": round_half_up(F.col(col), 4),
                "department_avg": round_half_up(F.col(f"__{col}"), 4),
                "delta": round_half_up(F.col(col).cast("double") - F.col(f"__{col}"), 4),
            }
            for label, col in metrics
        ],
        ids=["employee_id", "department"],
    )


# --- risk ------------------------------------------------------------------------------


def tier_validation(scores_df: DataFrame, employee: DataFrame) -> DataFrame:
    """Actual outcome rate and mean probability per risk tier, in tier order."""
    joined = scores_df.join(employee.select("employee_id", "attrition"), "employee_id")
    return joined.groupBy("risk_tier").agg(
        n_rows().alias("employee_count"),
        round_half_up(F.lit(100.0) * F.avg("model_probability"), 1).alias("avg_predicted_prob_pct"),
        pct(count_if(scores.is_attrited()), n_rows(), 1).alias("actual_attrition_rate_pct"),
    ).withColumn("tier_order", domain_index("risk_tier", bands.RISK_TIERS))


def risk_tiers_by_department(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("department", "risk_tier").agg(n_rows().alias("n"))
    return share_of_total(counts, "n", ["department"], "pct")


def top_risk_list(scored: DataFrame, tiers: Sequence[str] = ("Critical", "High"), k: int = 50) -> DataFrame:
    """Highest scores among the given tiers."""
    return top_k(scored.where(F.col("risk_tier").isin(list(tiers))), [F.desc("risk_score"), F.col("employee_id")], k)
