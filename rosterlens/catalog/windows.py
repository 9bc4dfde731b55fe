"""Rank, n-tile, running and deviation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import EMPLOYEE_SOURCE, LEFT, LEVELS, SOURCES, STAYED, avg, case_bands, cnt, emp, pct
from rosterlens.functions import bands
from rosterlens.functions.numeric import round_half_up
from rosterlens.operators import attrition, compensation, ranking, talent
from rosterlens.operators.grouping import share_of_total
from rosterlens.session import written_table

SORTABLE = [f"{i:02d}. {label}" for i, label in enumerate(bands.TENURE_LABELS_SHORT, 1)]


@query("w01_cumulative_by_band", emp(f"""
SELECT *, CAST(sum(attrition_count) OVER (ORDER BY tenure_band) AS BIGINT) AS cumulative_attrition,
 CAST(sum(total_in_band) OVER (ORDER BY tenure_band) AS BIGINT) AS cumulative_headcount FROM (
 SELECT {case_bands('years_at_company', bands.TENURE_EDGES, SORTABLE)} AS tenure_band, count(*) AS total_in_band,
 {cnt(LEFT)} AS attrition_count, {pct(cnt(LEFT))} AS attrition_rate_pct FROM employee GROUP BY 1)"""))
def cumulative_by_band(t):
    return attrition.cumulative_attrition(t.employee)


@query("w02_salary_position", emp("""
SELECT employee_id, employee_name, department, job_level, level_name, gender, salary, band_min, band_max,
 round(100e0 * percent_rank() OVER (PARTITION BY job_level ORDER BY salary), 1) AS salary_percentile_in_level,
 round(CAST(salary AS DOUBLE) / (band_min + floor((band_max - band_min) / 2)), 4) AS compa_ratio,
 rank() OVER (PARTITION BY department, job_level ORDER BY salary DESC) AS salary_rank_in_dept_level,
 salary - quantile_cont(salary, 0.5) OVER (PARTITION BY job_level) AS distance_from_level_median
FROM employee JOIN levels USING (job_level)""", LEVELS))
def salary_position(t):
    return compensation.salary_position(t.employee, t.job_levels)


@query("w03_engagement_position", emp(f"""
SELECT employee_id, employee_name, department, job_level, CAST(engagement_score AS DOUBLE) AS engagement_score, performance_rating,
 round(CAST(engagement_score AS DOUBLE) - CAST(sum(engagement_score) OVER d AS DOUBLE) / count(*) OVER d, 2) AS eng_vs_dept_avg,
 rank() OVER (PARTITION BY department ORDER BY engagement_score DESC) AS engagement_rank_in_dept,
 round(100e0 * percent_rank() OVER (ORDER BY engagement_score), 1) AS engagement_pct_rank_company,
 rank() OVER (PARTITION BY department ORDER BY salary DESC) AS salary_rank_in_dept,
 rank() OVER (PARTITION BY department ORDER BY performance_rating DESC, engagement_score DESC) AS perf_rank_in_dept,
 CASE WHEN percent_rank() OVER (PARTITION BY department ORDER BY engagement_score) <= 0.10 THEN '{talent.HRBP_FLAG}' END AS hrbp_flag
FROM employee WHERE {STAYED} WINDOW d AS (PARTITION BY department)"""))
def engagement_position(t):
    return talent.engagement_position(t.employee)


NTILE_COLUMNS = ("employee_id", "department", "job_level", "gender", "salary", "attrition")


@query("w04_ntile_buckets", emp(f"""
SELECT {', '.join(NTILE_COLUMNS)}, ntile(4) OVER (ORDER BY engagement_score, employee_id) AS engagement_quartile,
 ntile(4) OVER (ORDER BY salary, employee_id) AS salary_quartile,
 ntile(10) OVER (ORDER BY engagement_score, employee_id) AS engagement_decile FROM employee"""))
def ntile_buckets(t):
    tiles = {"engagement_quartile": ("engagement_score", 4), "engagement_decile": ("engagement_score", 10), "salary_quartile": ("salary", 4)}
    return ranking.ordered_tiles(t.employee.select(*NTILE_COLUMNS, "engagement_score"), tiles, "employee_id").drop("engagement_score")


@query("w05_source_rank", emp(f"""
SELECT department, job_level, recruitment_source, count(*) AS hire_count, {avg('performance_rating')} AS avg_performance,
 {pct(cnt(LEFT))} AS attrition_pct, rank() OVER (PARTITION BY department, job_level ORDER BY count(*) DESC) AS source_rank_in_dept_level
FROM es GROUP BY 1, 2, 3""", SOURCES, EMPLOYEE_SOURCE))
def source_rank(t):
    return talent.source_rank(t.employee_with_source)


@query("w06_share_of_total", emp("""
SELECT location, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_total FROM employee GROUP BY 1"""))
def share(t):
    return share_of_total(t.employee.groupBy("location").agg(F.count(F.lit(1)).alias("n")), "n")


@query("w07_global_percent_rank", emp("""
SELECT employee_id, round(percent_rank() OVER (ORDER BY satisfaction_score), 6) AS pct_rank FROM employee"""))
def global_percent_rank(t):
    ranked = ranking.global_percent_rank(t.employee.select("employee_id", "satisfaction_score"), "satisfaction_score")
    return ranked.select("employee_id", round_half_up("pct_rank", 6).alias("pct_rank"))


@query("w08_global_ntile", emp("""
SELECT employee_id, ntile(7) OVER (ORDER BY performance_rating, employee_id) AS rating_septile FROM employee"""))
def global_ntile(t):
    df = written_table(t.employee.select("employee_id", "performance_rating"), "ntile-rows")
    return ranking.global_ntile(df, "performance_rating", {"rating_septile": 7}, "employee_id").drop("performance_rating")


@query("w09_row_number_latest", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def row_number_latest(t):
    newest = ranking.row_number_latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


@query("w10_median_over_partition", emp("""
SELECT employee_id, quantile_cont(salary, 0.5) OVER (PARTITION BY department) AS department_median FROM employee"""))
def median_over_partition(t):
    df = t.employee.select("employee_id", "department", "salary")
    return ranking.median_over_partition(df, ["department"], "salary", "department_median").select("employee_id", "department_median")


@query("w11_deviation_from_mean", emp("""
SELECT employee_id, round(CAST(engagement_score AS DOUBLE) - CAST(sum(engagement_score) OVER d AS DOUBLE) / count(*) OVER d, 4) AS vs_department
FROM employee WINDOW d AS (PARTITION BY department)"""))
def deviation_from_mean(t):
    df = t.employee.select("employee_id", "department", "engagement_score")
    out = ranking.deviation_from_mean(df, ["department"], "engagement_score", "dev")
    return out.select("employee_id", round_half_up("dev", 4).alias("vs_department"))
