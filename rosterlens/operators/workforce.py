"""Headcount, structure and scorecard reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct, round_half_up, safe_divide
from rosterlens.operators.grouping import (
    crosstab_count, exact_quantiles, grouped_sums, one, share_of_total, when_value,
)
from rosterlens.operators.joins import self_join_manager
from rosterlens.session import cut_lineage



def c(name: str) -> Column:
    return F.col(name)


def avg_of(sum_col: str, n_col: str = "n", digits: int = 2) -> Column:
    return round_half_up(safe_divide(c(sum_col), c(n_col)), digits)


def department_kpis(employee: DataFrame) -> DataFrame:
    """One row per department: head counts, attrition, pay with exact median, five averages."""
    sums = {
        "n": F.lit(1), "active": one(scores.is_active()), "left": one(scores.is_attrited()), "pay": c("salary"), "eng": c("engagement_score"),
        "sat": c("satisfaction_score"), "perf": c("performance_rating"), "att": c("attendance_pct"),
        "train": c("training_hours"), "tenure": c("years_at_company"), "high": one(scores.is_high_performer()),
        "risk": one(scores.is_disengaged()), "regret": one(scores.is_attrited() & scores.is_high_performer()),
    }
    g = grouped_sums(employee, ["department"], sums, "salary", {"median_salary": 0.5})
    return g.select(
        "department",
        c("n").alias("total_headcount"),
        c("active").alias("active_headcount"),
        c("left").alias("attrition_count"),
        pct(c("left"), c("n")).alias("attrition_rate_pct"),
        avg_of("pay").alias("avg_salary"),
        c("median_salary"),
        avg_of("eng").alias("avg_engagement_score"),
        avg_of("sat").alias("avg_satisfaction_score"),
        avg_of("perf", digits=3).alias("avg_performance_rating"),
        avg_of("att").alias("avg_attendance_pct"),
        avg_of("train").alias("avg_training_hours"),
        avg_of("tenure").alias("avg_tenure_years"),
        c("high").alias("high_performer_count"),
        pct(c("high"), c("n")).alias("high_performer_pct"),
        c("risk").alias("high_flight_risk_count"),
        pct(c("regret"), c("n")).alias("regrettable_attrition_pct"),
    )


def executive_scorecard(employee: DataFrame) -> DataFrame:
    """Twenty company KPIs from one aggregate."""
    new_hire = c("years_at_company") < 1
    n = n_rows()
    return employee.agg(
        n.alias("total_employees"),
        count_if(scores.is_active()).alias("active_employees"),
        count_if(scores.is_attrited()).alias("total_attrited"),
        pct(count_if(scores.is_attrited()), n).alias("attrition_rate_pct"),
        pct(count_if(scores.is_attrited() & scores.is_high_performer()), n).alias("regrettable_attrition_pct"),
        pct(count_if(scores.is_attrited() & new_hire), count_if(new_hire)).alias("new_hire_attrition_pct"),
        round_half_up(mean("engagement_score")).alias("avg_engagement_score"),
        round_half_up(mean("satisfaction_score")).alias("avg_satisfaction_score"),
        count_if(scores.is_disengaged()).alias("high_flight_risk_count"),
        pct(count_if(scores.is_disengaged()), n).alias("high_flight_risk_pct"),
        pct(count_if(scores.is_high_performer()), n).alias("high_performer_pct"),
        round_half_up(mean("performance_rating"), 3).alias("avg_performance_rating"),
        round_half_up(mean("salary")).alias("avg_salary"),
        round_half_up(mean(scores.total_comp("salary", "bonus"))).alias("avg_total_comp"),
        round_half_up(mean("attendance_pct")).alias("avg_attendance_pct"),
        round_half_up(mean("training_hours")).alias("avg_training_hours"),
        round_half_up(mean("years_at_company")).alias("avg_tenure_years"),
        round_half_up(mean("promotions"), 3).alias("avg_promotions"),
        pct(count_if(c("gender") == "Female"), n).alias("female_representation_pct"),
        F.floor(F.coalesce(F.sum(F.when(scores.is_attrited(), c("salary"))), F.lit(0)) * F.lit(scores.REPLACEMENT_FACTOR))
        .cast("bigint").alias("total_attrition_cost"),
    )


def pay_gap_pct(digits: int | None = 2) -> Column:
    """Aggregate: (mean male pay - mean female pay) / mean male pay x 100."""
    male = mean("salary", c("gender") == "Male")
    female = mean("salary", c("gender") == "Female")
    gap = F.lit(100.0) * safe_divide(male - female, male)
    return gap if digits is None else round_half_up(gap, digits)


def department_heatmap(employee: DataFrame, attrition=(18, 25), engagement=(60, 75), pay_gap=(2, 5),
                       attendance=(88, 95)) -> DataFrame:
    """Four KPIs with their traffic lights per department."""
    lights = ("🔴", "🟡", "🟢")
    g = employee.groupBy("department").agg(
        n_rows().alias("headcount"),
        pct(count_if(scores.is_attrited()), n_rows(), 10).alias("__attrition"),
        mean("engagement_score").alias("__engagement"),
        pay_gap_pct(10).alias("__gap"),
        mean("attendance_pct").alias("__attendance"),
        round_half_up(mean("salary")).alias("avg_salary"),
        round_half_up(mean("performance_rating")).alias("avg_perf_rating"),
    )
    return g.select(
        "department", "headcount",
        round_half_up("__attrition").alias("attrition_pct"),
        bands.attrition_rag("__attrition", *attrition, labels=lights).alias("attrition_rag"),
        round_half_up("__engagement", 1).alias("avg_engagement"),
        bands.engagement_rag("__engagement", *engagement, labels=lights).alias("engagement_rag"),
        round_half_up("__gap").alias("gender_pay_gap_pct"),
        bands.rag(F.abs("__gap"), *pay_gap, labels=lights, strict=True).alias("pay_equity_rag"),
        round_half_up("__attendance", 1).alias("avg_attendance"),
        bands.attendance_rag("__attendance", *attendance, labels=lights).alias("attendance_rag"),
        "avg_salary", "avg_perf_rating",
    )


def headcount_pyramid(employee: DataFrame, levels: DataFrame) -> DataFrame:
    """Active headcount per level with its share of the total."""
    g = employee.where(scores.is_active()).groupBy("job_level").agg(
        n_rows().alias("headcount"),
        round_half_up(mean("salary")).alias("avg_salary"),
        round_half_up(mean("engagement_score")).alias("avg_engagement"),
    )
    named = g.join(F.broadcast(levels.select("job_level", "level_name", "career_track", "sort_order")), "job_level")
    return share_of_total(named, "headcount")


def gender_by_level(employee: DataFrame, levels: DataFrame) -> DataFrame:
    """Gender counts per level, female share, pay gap amount and percent."""
    male = mean("salary", c("gender") == "Male")
    female = mean("salary", c("gender") == "Female")
    g = employee.groupBy("job_level").agg(
        n_rows().alias("total_headcount"),
        count_if(c("gender") == "Male").alias("male_count"),
        count_if(c("gender") == "Female").alias("female_count"),
        count_if(c("gender") == "Non-binary").alias("non_binary_count"),
        pct(count_if(c("gender") == "Female"), n_rows(), 1).alias("female_representation_pct"),
        round_half_up(male - female).alias("salary_gap_amt"),
        pay_gap_pct().alias("pay_gap_pct"),
    )
    return g.join(F.broadcast(levels.select("job_level", "level_name", "sort_order")), "job_level")


def work_mode_by_department(employee: DataFrame) -> DataFrame:
    """Work-mode counts, remote share, and attrition of remote and on-site staff; null without such staff."""
    remote, onsite = c("work_mode") == "Remote", c("work_mode") == "On-site"
    return employee.groupBy("department").agg(
        n_rows().alias("total_employees"),
        count_if(onsite).alias("onsite_count"),
        count_if(c("work_mode") == "Hybrid").alias("hybrid_count"),
        count_if(remote).alias("remote_count"),
        pct(count_if(remote), n_rows(), 1).alias("remote_pct"),
        pct(count_if(remote & scores.is_attrited()), count_if(remote)).alias("remote_attrition_pct"),
        pct(count_if(onsite & scores.is_attrited()), count_if(onsite)).alias("onsite_attrition_pct"),
    )


def _teams(employee: DataFrame) -> DataFrame:
    """Sums per manager: reduced before any manager attribute is attached."""
    sums = {
        "n": F.lit(1), "eng": c("engagement_score"), "sat": c("satisfaction_score"), "active": one(scores.is_active()),
        "left": one(scores.is_attrited()), "high": one(scores.is_high_performer()), "perf": c("performance_rating"), "low": one(c("performance_rating") <= 2),
        "promoted": one(c("promotions") >= 1),
    }
    return grouped_sums(employee.where(c("manager_id").isNotNull()), ["manager_id"], sums)


def manager_effectiveness(employee: DataFrame, min_team: int = 3, variant: str = "performance") -> DataFrame:
    """Team metrics per manager and a 40/40/20 composite with its traffic light.

    The 20% term is the high-performer share, or the promotion share with variant='promotion'.
    """
    teams = _teams(employee).where(c("n") >= min_team)
    teams = self_join_manager(teams, employee, {"employee_name": "manager_name", "department": "manager_department"})
    third = pct(c("high"), c("n")) if variant == "performance" else pct(c("promoted"), c("n"))
    metrics = teams.select(
        "manager_id", "manager_name", "manager_department",
        c("n").alias("team_size"),
        avg_of("eng").alias("avg_team_engagement"),
        avg_of("sat").alias("avg_team_satisfaction"),
        pct(c("active"), c("n")).alias("retention_rate_pct"),
        pct(c("high"), c("n")).alias("high_performer_pct"),
        avg_of("perf", digits=3).alias("avg_team_performance"),
        pct(c("left"), c("n")).alias("team_attrition_rate_pct"),
        third.alias("__third"),
    )
    score = c("avg_team_engagement") * 0.40 + c("retention_rate_pct") * 0.40 + c("__third") * 0.20
    return metrics.withColumn("__score", score).select(
        *[m for m in metrics.columns if m != "__third"],
        round_half_up("__score").alias("effectiveness_score"),
        bands.rag("__score", 55, 75, high_is_bad=False).alias("rag_status"),
    )


def span_of_control(employee: DataFrame, low: int = 4, high: int = 12) -> DataFrame:
    """Direct reports per manager and whether the span is healthy."""
    teams = self_join_manager(
        _teams(employee), employee,
        {"employee_name": "manager_name", "department": "department", "job_level": "manager_level"},
    )
    return teams.select(
        "manager_id", "manager_name", "department", "manager_level",
        c("n").alias("direct_report_count"),
        F.when(c("n") > high, f"Overloaded (>{high})").when(c("n") < low, f"Under-span (<{low})")
        .otherwise(f"Optimal ({low}-{high})").alias("span_status"),
        avg_of("eng").alias("team_avg_engagement"),
        pct(c("left"), c("n")).alias("team_attrition_pct"),
    )


def average_span(employee: DataFrame) -> DataFrame:
    """Rows with a manager over distinct managers, from the per-manager sums."""
    return _teams(employee).agg(
        n_rows().alias("managers"),
        F.sum("n").alias("reports"),
        round_half_up(safe_divide(F.sum("n"), n_rows())).alias("avg_span"),
    )


def level_mix(employee: DataFrame) -> DataFrame:
    """Shares of individual contributors (L1-L4), managers (L5-L6) and executives."""
    level = F.substring("job_level", 2, 1).cast("int")
    n = n_rows()
    return employee.agg(
        count_if(level <= 4).alias("ic_count"),
        count_if(level.between(5, 6)).alias("manager_count"),
        count_if(level >= 7).alias("executive_count"),
        pct(count_if(level <= 4), n).alias("ic_pct"),
        pct(count_if(level.between(5, 6)), n).alias("manager_pct"),
        pct(count_if(level >= 7), n).alias("executive_pct"),
    )


def department_detail(employee: DataFrame) -> DataFrame:
    return employee.groupBy("department").agg(
        n_rows().alias("headcount"),
        round_half_up(mean("years_at_company"), 1).alias("avg_tenure"),
        round_half_up(mean("salary"), 1).alias("avg_salary"),
        pct(count_if(c("work_mode") == "Remote"), n_rows(), 1).alias("remote_pct"),
        pct(count_if(scores.is_attrited()), n_rows(), 1).alias("attrition_pct"),
    )


def age_by_level(employee: DataFrame, closed: str = "right") -> DataFrame:
    """Age band x level counts in long form; ages outside the bands are dropped."""
    banded = employee.withColumn("age_band", bands.age_band("age", closed)).where(c("age_band").isNotNull())
    return crosstab_count(banded, "age_band", "job_level")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the observed minimum and maximum, with the overall median."""
    value = c(column).cast("double")
    low, high = df.select(F.min(value)).scalar(), df.select(F.max(value)).scalar()
    median = exact_quantiles(df, [], column, {"m": 0.5}).scalar()
    width = (high - low) / F.lit(float(bins))
    # The top edge belongs to the last bin.
    bin_no = F.least(F.floor(safe_divide(value - low, width, 0.0)) + 1, F.lit(bins)).cast("int")
    counts = df.where(c(column).isNotNull()).groupBy(bin_no.alias("bin")).agg(n_rows().alias("n"))
    return counts.select(
        "bin", round_half_up(low + (c("bin") - 1) * width, 4).alias("bin_start"), "n", median.alias("median")
    )


def span_histogram(employee: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(cut_lineage(_teams(employee).select("n").withColumnRenamed("n", "reports")), "reports", bins)


def headline_kpis(employee: DataFrame, strip: str) -> DataFrame:
    """KPI strip of one dashboard page."""
    n = n_rows()
    new_hire = c("years_at_company") < 1
    cost = F.sum(F.when(scores.is_attrited(), c("salary"))) * F.lit(scores.REPLACEMENT_FACTOR)
    senior = c("job_level").isin("L6", "L7", "L8")

    def rate(cond: Column, among: Column | None = None) -> Column:
        if among is None:
            return pct(count_if(cond), n, 1)
        return pct(count_if(cond & among), count_if(among), 1)

    strips: Mapping[str, Sequence[Column]] = {
        "overview": [
            n.alias("total_headcount"), rate(scores.is_attrited()).alias("attrition_rate"),
            round_half_up(mean("engagement_score"), 1).alias("avg_engagement"),
            round_half_up(mean("salary"), 0).alias("avg_salary"),
            count_if(scores.is_disengaged()).alias("high_flight_risk"), rate(scores.is_attrited() & scores.is_high_performer()).alias("regrettable_pct"),
        ],
        "workforce": [
            n.alias("total_headcount"), rate(c("work_mode") == "Remote").alias("remote_pct"),
            round_half_up(mean("years_at_company"), 1).alias("avg_tenure"),
            F.countDistinct("department").alias("departments"),
        ],
        "attrition": [
            rate(scores.is_attrited()).alias("overall_rate"), rate(scores.is_voluntary()).alias("voluntary_rate"),
            rate(scores.is_attrited() & scores.is_high_performer()).alias("regrettable_rate"), rate(scores.is_attrited(), new_hire).alias("new_hire_rate"),
            round_half_up(cost / F.lit(1e6), 1).alias("attrition_cost_m"),
        ],
        "performance": [
            round_half_up(mean("performance_rating")).alias("avg_rating"), rate(scores.is_high_performer()).alias("high_performer_pct"),
            rate(scores.is_active()).alias("overall_retention"), rate(scores.is_active(), scores.is_high_performer()).alias("high_performer_retention"),
            count_if(c("performance_rating") == 1).alias("improvement_plan_count"),
        ],
        "compensation": [
            pay_gap_pct().alias("pay_gap_pct"),
            round_half_up(F.sum(c("salary") + c("bonus")) / F.lit(1e6), 1).alias("total_comp_cost_m"),
            round_half_up(F.lit(100.0) * F.avg(c("bonus") / c("salary")), 1).alias("avg_bonus_ratio_pct"),
        ],
        "recruitment": [
            rate(c("recruitment_source") == "Internal Transfer").alias("internal_hire_rate"),
            round_half_up(mean("performance_rating")).alias("avg_performance"),
            F.countDistinct("recruitment_source").alias("channels"),
        ],
        "diversity": [
            rate(c("gender") == "Female").alias("female_pct"),
            rate(c("gender") == "Female", senior).alias("female_senior_pct"),
            F.abs(pay_gap_pct()).alias("pay_gap_pct"),
            round_half_up(
                F.lit(100.0) * (safe_divide(count_if(scores.is_attrited() & (c("gender") == "Female")), count_if(c("gender") == "Female"))
                                - safe_divide(count_if(scores.is_attrited() & (c("gender") == "Male")), count_if(c("gender") == "Male"))), 1
            ).alias("attrition_differential_pp"),
        ],
    }
    return employee.agg(*strips[strip])


def org_health_index(employee: DataFrame) -> DataFrame:
    """0-100 blend: attrition 30, engagement 30, performance 20, pay equity 20."""
    n = n_rows()
    parts = employee.agg(
        safe_divide(count_if(scores.is_attrited()), n).alias("attrition"),
        mean("engagement_score").alias("engagement"),
        safe_divide(count_if(scores.is_high_performer()), n).alias("high"),
        F.coalesce(F.abs(pay_gap_pct(None)) / F.lit(100.0), F.lit(0.0)).alias("gap"),
    ).select(
        ((F.lit(1.0) - F.least(c("attrition"), F.lit(0.5)) / F.lit(0.5)) * 30).alias("a"),
        (c("engagement") / F.lit(100.0) * 30).alias("e"),
        (c("high") * 20).alias("p"),
        ((F.lit(1.0) - F.least(c("gap"), F.lit(0.10)) / F.lit(0.10)) * 20).alias("q"),
    )
    return parts.select(
        round_half_up("a", 1).alias("attrition_score"), round_half_up("e", 1).alias("engagement_points"),
        round_half_up("p", 1).alias("performance_points"), round_half_up("q", 1).alias("equity_points"),
        round_half_up(c("a") + c("e") + c("p") + c("q"), 1).alias("health_score"),
    )


def scope_summary(employee: DataFrame, by: Sequence[str]) -> DataFrame:
    """Head count and attrition for any grouping."""
    return employee.groupBy(*by).agg(
        n_rows().alias("headcount"), pct(count_if(scores.is_attrited()), n_rows()).alias("attrition_pct")
    )
