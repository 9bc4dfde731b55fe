"""Pay distribution, equity and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct, round_half_up, safe_divide
from rosterlens.operators.grouping import quantiles_of_positions, share_of_total, view_quantiles
from rosterlens.operators.ranking import percent_rank, rank_desc, same_keys, stacked_positions, value_positions, view_lookup
from rosterlens.operators.workforce import pay_gap_pct


def pay_equity_by_level_gender(employee: DataFrame) -> DataFrame:
    """Level x gender: count, mean, median against the level median.

    Counts, means and both medians come from the value positions of two views of the rows.
    """
    paid = employee.where(F.col("salary").isNotNull()).select("job_level", "gender", "salary")
    positions = stacked_positions(paid, {"level": (["job_level"], "salary"), "cell": (["job_level", "gender"], "salary")})
    n = F.col("ties")
    level = view_quantiles(positions, "level", ["job_level"], {"level_median": 0.5})
    cell = view_quantiles(positions, "cell", ["job_level", "gender"], {"gender_median": 0.5}, {
        "employee_count": F.sum(n), "avg_salary": round_half_up(safe_divide(F.sum(F.col("value") * n), F.sum(n))),
    }).select("job_level", "gender", "employee_count", "avg_salary", "gender_median")
    gap = F.col("gender_median") - F.col("level_median")
    return cell.join(level, "job_level").select(
        "*",
        round_half_up(F.lit(100.0) * safe_divide(gap, F.col("level_median"))).alias("pay_gap_vs_median_pct"),
        round_half_up(gap).alias("pay_gap_vs_median_amt"),
    )


def box_plot(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """Count, min, quantiles, mean and max per group from value positions."""
    n = F.col("ties")
    names = [f"p{round(p * 100)}" for p in probs]
    g = quantiles_of_positions(value_positions(df.where(F.col(value).isNotNull()), by, value), by, value, dict(zip(names, probs)), {
        "n": F.sum(n), "min": F.min(value).cast("double"), "mean": safe_divide(F.sum(F.col(value) * n), F.sum(n)), "max": F.max(value).cast("double"),
    })
    return g.select(*by, "n", "min", *[round_half_up(c).alias(c) for c in names], round_half_up("mean").alias("mean"), "max")


def salary_box_plot(employee: DataFrame, levels: DataFrame) -> DataFrame:
    boxes = box_plot(employee, ["job_level"], "salary")
    return boxes.join(F.broadcast(levels.select("job_level", "level_name", "band_min", "band_max")), "job_level")


def gender_pay_gap(df: DataFrame, by: Sequence[str], monitor: float = 2, act: float = 5) -> DataFrame:
    """Pay by gender per group with gap and status."""
    male, female = F.col("gender") == "Male", F.col("gender") == "Female"
    g = df.groupBy(*by).agg(
        n_rows().alias("total_employees"),
        count_if(male).alias("male_count"),
        count_if(female).alias("female_count"),
        mean("salary", male).alias("__m"),
        mean("salary", female).alias("__f"),
    )
    gap = F.lit(100.0) * safe_divide(F.col("__m") - F.col("__f"), F.col("__m"))
    labels = ("🔴 Action Required", "🟡 Monitor", "🟢 Within Range")
    return g.select(
        *by, "total_employees", "male_count", "female_count",
        round_half_up("__m").alias("male_avg_salary"),
        round_half_up("__f").alias("female_avg_salary"),
        round_half_up(F.col("__m") - F.col("__f")).alias("raw_pay_gap_amt"),
        round_half_up(gap).alias("pay_gap_pct"),
        bands.rag(F.abs(gap), monitor, act, labels=labels, strict=True).alias("equity_status"),
    )


def with_band_compa(employee: DataFrame, levels: DataFrame, name: str = "compa_ratio") -> DataFrame:
    """Salary over the midpoint of the level's band (seven fixed rows, broadcast)."""
    banded = employee.join(F.broadcast(levels.select("job_level", "level_name", "band_min", "band_max")), "job_level")
    return banded.withColumn(name, scores.compa_ratio_band_mid("salary", "band_min", "band_max"))


def compa_ratio_distribution(employee: DataFrame, levels: DataFrame) -> DataFrame:
    """Compa-ratio bands with count, share and attrition, lowest first."""
    g = with_band_compa(employee, levels).groupBy(
        bands.compa_band("compa_ratio").alias("compa_ratio_band"),
        bands.compa_band_index("compa_ratio").alias("band_index"),
    ).agg(
        n_rows().alias("employee_count"), pct(count_if(scores.is_attrited()), n_rows()).alias("attrition_rate_pct")
    )
    return share_of_total(g, "employee_count")


def bonus_ratio_by_rating(employee: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("bonus").cast("double"), F.col("salary").cast("double"))
    return employee.groupBy("performance_rating").agg(
        n_rows().alias("headcount"), round_half_up(F.lit(100.0) * F.avg(ratio), 4).alias("bonus_pct")
    )


def comp_cost_by_department(employee: DataFrame) -> DataFrame:
    return employee.groupBy("department").agg(F.sum(scores.total_comp("salary", "bonus")).alias("total_cost"))


def comp_detail(employee: DataFrame, compa: str = "compa_ratio") -> DataFrame:
    """Department x level pay table; the input carries a compa-ratio column."""
    return employee.groupBy("department", "job_level").agg(
        n_rows().alias("headcount"),
        round_half_up(mean("salary")).alias("avg_salary"),
        round_half_up(F.avg(compa), 3).alias("avg_compa_ratio"),
        round_half_up(mean("bonus")).alias("avg_bonus"),
    )


def below_market(employee: DataFrame, threshold: float = 0.80, compa: str = "compa_ratio") -> DataFrame:
    """Share of employees whose compa-ratio is under a threshold."""
    return employee.agg(
        n_rows().alias("n"), count_if(F.col(compa) < threshold).alias("below"),
        pct(count_if(F.col(compa) < threshold), n_rows()).alias("below_market_pct"),
    )


def pay_equity_index(employee: DataFrame) -> DataFrame:
    """100 minus ten points per percent of absolute pay gap, floored at 0, with its reading."""
    gap = F.abs(F.col("__gap"))
    index = F.lit(100.0) - F.least(gap, F.lit(10.0)) / F.lit(10.0) * 100
    reading = (
        F.when(index >= 97, "within noise").when(index >= 95, "acceptable")
        .when(index >= 90, "remediation warranted").otherwise("material exposure")
    )
    return employee.agg(pay_gap_pct(None).alias("__gap")).select(
        round_half_up(gap).alias("pay_gap_pct"), round_half_up(index).alias("pay_equity_index"), reading.alias("reading")
    )


def correlation_and_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and least-squares line over all rows."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(
        round_half_up(F.corr(a, b), 6).alias("r"),
        round_half_up(F.regr_slope(b, a), 6).alias("slope"),
        round_half_up(F.regr_intercept(b, a), 6).alias("intercept"),
    )


def salary_position(employee: DataFrame, levels: DataFrame) -> DataFrame:
    """Percent rank and median distance in the level, rank in department x level, band compa-ratio."""
    rows = with_band_compa(employee, levels, "__compa").select(
        "employee_id", "employee_name", "department", "job_level", "level_name", "gender", "salary", "band_min", "band_max", "__compa",
    )
    # Both views and the median are read off one range pass; the rows themselves are not moved or written.
    positions = stacked_positions(rows.select("department", "job_level", "salary"), {
        "level": (["job_level"], "salary"), "team": (["department", "job_level"], "salary"),
    })
    medians = view_quantiles(positions.where("value IS NOT NULL"), "level", ["job_level"], {"level_median": 0.5})
    placed = view_lookup(rows, positions, "level", ["job_level"], "salary", {"__pr": percent_rank()})
    placed = view_lookup(placed, positions, "team", ["department", "job_level"], "salary", {"salary_rank_in_dept_level": rank_desc()})
    return same_keys(placed, medians, ["job_level"], "left").select(
        "employee_id", "employee_name", "department", "job_level", "level_name", "gender", "salary", "band_min", "band_max",
        round_half_up(F.lit(100.0) * F.col("__pr"), 1).alias("salary_percentile_in_level"),
        round_half_up("__compa", 4).alias("compa_ratio"),
        "salary_rank_in_dept_level",
        (F.col("salary") - F.col("level_median")).alias("distance_from_level_median"),
    )
