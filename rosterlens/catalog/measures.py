"""Measure catalogue by department, by manager and by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.columns import COMPOSITE, RETENTION
from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import (
    COMPA, FEMALE, HIGH, LEFT, MALE, MEAN_F, MEAN_M, SOURCES, STAYED, avg, case_bands, cnt, emp, q, ratio,
)
from rosterlens.functions import bands
from rosterlens.measures import catalogue
from rosterlens.measures.columns import calculated_columns
from rosterlens.operators.joins import month_spine_rows
from rosterlens.operators.ranking import compa_ratio_level_median, median_over_partition

BASE = "ms AS (SELECT * FROM compa JOIN sources USING (recruitment_source_id))"
CTES = (SOURCES, COMPA, BASE)


def measured(t):
    """Employees with source name, share of full time, level median and the unrounded compa-ratio."""
    return compa_ratio_level_median(staffed(t), name="compa_ratio_raw", digits=None)


def staffed(t):
    """Employees with source name and share of full time (null: full time)."""
    fte = F.when(F.col("employee_id") % 4 == 0, F.lit(0.5)).when(F.col("employee_id") % 4 == 1, F.lit(1.0))
    return t.employee_with_source.withColumn("fte_value", fte)


def r6(cond: str, among: str | None = None) -> str:
    return f"round({ratio(cnt(cond)) if among is None else ratio(cnt(f'{cond} AND {among}'), cnt(among))}, 6)"


def rag_sql(x: str, top: float, mid: float, names=("Red", "Amber", "Green")) -> str:
    return f"CASE WHEN {x} >= {top} THEN '{names[0]}' WHEN {x} >= {mid} THEN '{names[1]}' ELSE '{names[2]}' END"


GOOD = ("Green", "Amber", "Red")
NEW = "years_at_company < 1"
VOLUNTARY = f"{LEFT} AND exit_reason IS NOT NULL AND exit_reason NOT IN ('N/A', '')"
REFERRAL = "recruitment_source = 'Employee Referral'"
PROMOTED = "promotions >= 1"
ATTRITION_RATE = r6(LEFT)
COST = f"coalesce(CAST(sum(salary) FILTER (WHERE {LEFT}) AS DOUBLE), 0) * 1.5::DOUBLE"
ENG_AVG, ATT_AVG = avg("engagement_score", digits=4), avg("attendance_pct", digits=4)
P25, P75 = q("salary", 0.25), q("salary", 0.75)
DIVERSITY = " + ".join(
    f"(CAST({cnt(g)} AS DOUBLE) / count(*)) * (CAST({cnt(g)} AS DOUBLE) / count(*))" for g in (MALE, FEMALE, "gender = 'Non-binary'")
)

# SQL of every measure, by section.
SQL: dict[str, dict[str, str]] = {
    "headcount": {
        "total_employees": "count(*)", "active_employees": cnt(STAYED), "attrited_employees": cnt(LEFT),
        "total_fte": "round(sum(CASE WHEN employee_id % 4 = 0 THEN 0.5::DOUBLE ELSE 1e0 END), 1)",
        "headcount_male": cnt(MALE), "headcount_female": cnt(FEMALE), "headcount_pct_female": r6(FEMALE),
    },
    "attrition": {
        "attrition_rate": ATTRITION_RATE,
        "attrition_rate_text": f"printf('%.1f', round({ATTRITION_RATE} * 100e0, 1)) || '%'",
        "voluntary_attrition": cnt(VOLUNTARY), "voluntary_attrition_rate": r6(VOLUNTARY),
        "regrettable_attrition": cnt(f"{LEFT} AND {HIGH}"), "regrettable_attrition_rate": r6(f"{LEFT} AND {HIGH}"),
        "new_hire_attrition": cnt(f"{LEFT} AND {NEW}"), "new_hire_attrition_rate": r6(LEFT, NEW),
        "attrition_rag": rag_sql(ATTRITION_RATE, 0.25, 0.18),
    },
    "compensation": {
        "avg_salary": avg("salary"), "median_salary": q("salary", 0.5),
        "total_salary_cost": "CAST(sum(salary) AS BIGINT)", "total_bonus_cost": "CAST(sum(bonus) AS BIGINT)",
        "total_compensation_cost": "CAST(sum(salary + bonus) AS BIGINT)", "avg_total_compensation": avg("salary + bonus"),
        "avg_compa_ratio": "round(avg(compa_ratio_raw), 4)", "pct_below_market": r6("salary < level_median_salary * 0.80::DOUBLE"),
        "gender_pay_gap_pct": f"round(({MEAN_M} - {MEAN_F}) / {MEAN_M}, 6)", "gender_pay_gap_amt": f"round({MEAN_M} - {MEAN_F}, 2)",
        "salary_percentile_25": P25, "salary_percentile_75": P75, "salary_percentile_90": q("salary", 0.90),
        "compensation_iqr": f"round({P75} - {P25}, 2)",
    },
    "engagement": {
        "avg_engagement_score": ENG_AVG, "median_engagement_score": q("engagement_score", 0.5, 4),
        "avg_satisfaction_score": avg("satisfaction_score", digits=4),
        "engagement_index": f"round({avg('engagement_score', digits=None)} / 10, 1)",
        "high_flight_risk_employees": cnt("engagement_score < 40"),
        "medium_flight_risk_employees": cnt("engagement_score >= 40 AND engagement_score < 60"),
        "low_flight_risk_employees": cnt("engagement_score >= 60 AND engagement_score < 75"),
        "engaged_employees": cnt("engagement_score >= 75"), "pct_high_flight_risk": r6("engagement_score < 40"),
        "enps_score": f"round(100e0 * ({cnt('satisfaction_score >= 80')} - {cnt('satisfaction_score < 40')}) / count(*), 0)",
        "engagement_rag": rag_sql(ENG_AVG, 75, 60, GOOD),
    },
    "performance": {
        "avg_performance_rating": avg("performance_rating", digits=4),
        "pct_distinguished": r6("performance_rating = 5"), "pct_exceeds_expectations": r6("performance_rating = 4"),
        "pct_meets_expectations": r6("performance_rating = 3"), "pct_below_expectations": r6("performance_rating = 2"),
        "pct_unacceptable": r6("performance_rating = 1"), "high_performers": cnt(HIGH), "pct_high_performers": r6(HIGH),
        "perf_rating_attrited": avg("performance_rating", LEFT, 4), "perf_rating_active": avg("performance_rating", STAYED, 4),
    },
    "attendance": {
        "avg_attendance_pct": ATT_AVG, "total_leave_days": "CAST(sum(leave_count) AS BIGINT)",
        "avg_leave_days": avg("leave_count", digits=4), "chronic_absenteeism_count": cnt("attendance_pct < 85"),
        "chronic_absenteeism_rate": r6("attendance_pct < 85"), "attendance_rag": rag_sql(ATT_AVG, 95, 88, GOOD),
        "attendance_high_risk": avg("attendance_pct", "engagement_score < 40", 4),
    },
    "training": {
        "total_training_hours": "round(CAST(sum(training_hours) AS DOUBLE), 1)", "avg_training_hours": avg("training_hours", digits=4),
        "avg_training_hours_active": avg("training_hours", STAYED, 4), "avg_training_hours_attrited": avg("training_hours", LEFT, 4),
        "training_hours_delta": f"round({avg('training_hours', STAYED, None)} - {avg('training_hours', LEFT, None)}, 4)",
        "training_cost_estimate": "round(CAST(sum(training_hours) AS DOUBLE) * 50, 0)",
        "training_hours_percentile_90": q("training_hours", 0.90),
    },
    "career": {
        "avg_years_at_company": avg("years_at_company", digits=4), "median_years_at_company": q("years_at_company", 0.5, 4),
        "avg_promotions": avg("promotions", digits=4), "promoted_employees": cnt(PROMOTED), "promotion_rate": r6(PROMOTED),
        "promotion_rate_active": r6(PROMOTED, STAYED), "promotion_rate_attrited": r6(PROMOTED, LEFT),
        "avg_promotion_gap": "round((CAST(sum(years_at_company) AS DOUBLE) / 2.8::DOUBLE - CAST(sum(promotions) AS DOUBLE)) / count(*), 4)",
        "employees_with_promotion_gap": cnt("CAST(years_at_company AS DOUBLE) / 2.8::DOUBLE - promotions > 2"),
    },
    "talent": {
        "source_attrition_rate": r6(LEFT), "internal_hire_rate": r6("recruitment_source = 'Internal Transfer'"),
        "referral_hire_rate": r6(REFERRAL), "referral_attrition_rate": r6(LEFT, REFERRAL),
    },
    "manager": {
        "team_size": "count(*)",
        "manager_effectiveness_score": f"""round({avg('engagement_score', digits=None)} / 100 * 40 + (1e0 - {ratio(cnt(LEFT))}) * 40
 + {ratio(cnt(PROMOTED))} * 20, 1)""",
        "team_attrition_rate": r6(LEFT), "avg_team_engagement": ENG_AVG,
    },
    "insight": {
        "flight_risk_score": f"round(avg(round({COMPOSITE}, 6)), 4)", "attrition_revenue_impact": f"round({COST}, 1)",
        "attrition_cost_per_employee": f"coalesce(round({COST} / nullif({cnt(LEFT)}, 0), 2), 0)",
        "gender_diversity_index": f"round(1e0 - ({DIVERSITY}), 4)",
        "attrition_vs_benchmark": f"round({ratio(cnt(LEFT))} - 0.18::DOUBLE, 6)",
        "engagement_vs_benchmark": f"round({avg('engagement_score', digits=None)} - 65, 4)",
        "retention_score": f"round(avg(round({RETENTION}, 6)), 4)",
    },
    "display": {
        "attrition_rate_formatted": f"printf('%.1f', round({ATTRITION_RATE} * 100e0, 1)) || '% (' || format('{{:,}}', {cnt(LEFT)}) || ' employees)'",
        "avg_salary_formatted": f"""'$' || printf('%.1f', round({avg('salary')} / 1000e0, 1)) || 'K avg | $'
 || printf('%.1f', round({q('salary', 0.5)} / 1000e0, 1)) || 'K median'""",
        "engagement_formatted": f"""printf('%.1f', round({ENG_AVG}, 1)) || '/100 — ' || CASE WHEN {ENG_AVG} >= 75 THEN 'Healthy'
 WHEN {ENG_AVG} >= 60 THEN 'Monitor' ELSE 'Action Required' END""",
    },
}
KEYS = {
    "headcount": "x01", "attrition": "x02", "compensation": "x03", "engagement": "x04", "performance": "x05", "attendance": "x06",
    "training": "x07", "career": "x08", "talent": "x09", "manager": "x10", "insight": "x11", "display": "x12",
}
for _section, _measures in SQL.items():
    _by = "manager_id" if _section == "manager" else "department"
    _where = "WHERE manager_id IS NOT NULL" if _section == "manager" else ""
    _columns = ", ".join(f"{sql} AS {name}" for name, sql in _measures.items())

    def _build(t, section=_section, by=_by):
        where = F.col("manager_id").isNotNull() if by == "manager_id" else None
        source = measured(t) if section == "compensation" else staffed(t)
        return catalogue.evaluate(source, catalogue.section(section), [by], where)

    query(f"{KEYS[_section]}_{_section}_by_{_by.split('_')[0]}", emp(f"SELECT {_by}, {_columns} FROM ms {_where} GROUP BY {_by}", *CTES))(_build)

_ALL = {name: sql for section, measures in SQL.items() if section not in ("manager", "display") for name, sql in measures.items()}


@query("x00_all_measures_company", emp("SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _ALL.items()) + " FROM ms", *CTES))
def all_measures(t):
    return catalogue.evaluate(measured(t), list(_ALL))


SOURCE_RATES = ("total_employees", "source_attrition_rate")


@query("x09_source_attrition_by_source", emp(f"""
SELECT recruitment_source, count(*) AS total_employees, {r6(LEFT)} AS source_attrition_rate FROM ms GROUP BY 1""", *CTES))
def source_attrition(t):
    return catalogue.evaluate(t.employee_with_source, SOURCE_RATES, ["recruitment_source"])


@query("x04_engagement_vs_company", emp(f"""
SELECT department, {ENG_AVG} AS avg_engagement_score, round({ENG_AVG} - (SELECT {ENG_AVG} FROM employee), 4) AS vs_company FROM employee GROUP BY 1"""))
def engagement_vs_company(t):
    return catalogue.versus_company(t.employee, ["department"])


@query("x05_managers_exceeding_threshold", emp(f"""
SELECT count(*) AS managers_exceeding_threshold FROM (SELECT manager_id FROM employee GROUP BY 1
 HAVING CAST({cnt('performance_rating <= 2')} AS DOUBLE) / count(*) > 0.15)"""))
def managers_exceeding(t):
    return catalogue.managers_over_threshold(t.employee)


@query("x10_span_of_control", emp("""
SELECT round(CAST(count(manager_id) AS DOUBLE) / count(DISTINCT manager_id), 4) AS span_of_control FROM employee"""))
def span_of_control(t):
    return catalogue.span_of_control(t.employee)


def _subtitle_sql(department: str, location: str, where: str = "true") -> str:
    return emp(f"""SELECT d AS selected_department, l AS selected_location,
 'Showing: ' || d || ' | ' || l || ' | n = ' || format('{{:,}}', n) || ' employees' AS dashboard_subtitle
 FROM (SELECT {department} AS d, {location} AS l, count(*) AS n FROM employee WHERE {where})""")


def _selected(column: str, several: str) -> str:
    return f"CASE WHEN count(DISTINCT {column}) = 1 THEN min({column}) ELSE '{several}' END"


@query("x12_subtitle_unfiltered", _subtitle_sql("'All Departments'", "'All Locations'"))
def subtitle_unfiltered(t):
    return catalogue.subtitle(t.employee, False)


@query("x12_subtitle_filtered", _subtitle_sql(
    _selected("department", "Multiple Departments"), _selected("location", "Multiple Locations"), "department = 'BUILDING'"))
def subtitle_filtered(t):
    return catalogue.subtitle(t.employee.where("department = 'BUILDING'"), True)


SALES = "CAST(salary AS DOUBLE) / level_median_salary"


@query("x13_calculated_columns", emp(f"""
SELECT employee_id, {case_bands('years_at_company', bands.TENURE_EDGES, bands.TENURE_LABELS)} AS tenure_band,
 {case_bands('age', bands.AGE_EDGES, bands.AGE_LABELS)} AS age_band, {case_bands('salary', bands.SALARY_EDGES, bands.SALARY_LABELS)} AS salary_band,
 {case_bands('engagement_score', bands.ENGAGEMENT_EDGES, bands.ENGAGEMENT_TIERS)} AS engagement_tier,
 CASE WHEN {LEFT} THEN 1 ELSE 0 END AS attrition_binary, round({SALES}, 8) AS compa_ratio,
 round(CAST(years_at_company AS DOUBLE) / 2.8::DOUBLE - promotions, 1) AS promotion_gap,
 {case_bands('engagement_score', bands.ENGAGEMENT_EDGES, bands.FLIGHT_RISK_BADGES)} AS flight_risk_category,
 CASE WHEN {LEFT} AND {HIGH} THEN 'Yes' ELSE 'No' END AS is_regrettable_exit,
 CASE WHEN {HIGH} THEN 'High Performer' WHEN performance_rating = 3 THEN 'Core Performer' ELSE 'Low Performer' END AS performance_group FROM ms""", *CTES))
def calculated(t):
    from rosterlens.functions.numeric import round_half_up

    columns = calculated_columns()
    columns["compa_ratio"] = round_half_up(columns["compa_ratio"], 8)
    base = median_over_partition(t.employee, ["job_level"], "salary", "level_median_salary")
    return base.select("employee_id", *[c.alias(name) for name, c in columns.items()])


MONTHLY = """fact AS (SELECT e.*, month_end, CASE WHEN attrition = 'Yes' AND month_end = last_day(hire_date + 400) THEN 1 ELSE 0 END AS is_exit
 FROM employee e JOIN (SELECT last_day(CAST(m AS DATE)) AS month_end FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH) r(m)) s
 ON month_end >= last_day(hire_date) AND (attrition = 'No' OR month_end <= last_day(hire_date + 400))),
months AS (SELECT month_end, count(*) AS headcount, CAST(sum(is_exit) AS BIGINT) AS exits, CAST(sum(salary) AS DOUBLE) / count(*) AS avg_salary FROM fact GROUP BY 1),
rated AS (SELECT *, CAST(exits AS DOUBLE) / headcount AS rate, CAST(sum(exits) OVER y AS DOUBLE) / sum(headcount) OVER y AS ytd FROM months
 WINDOW y AS (PARTITION BY year(month_end) ORDER BY month_end))"""


def monthly_cohorts(t):
    """Employees summed by hire month and end month, then repeated per month between the two.

    Cohorts number at most months x months, so the rows are reduced before they multiply.
    """
    left = F.col("attrition") == "Yes"
    end = F.when(left, F.date_add("hire_date", 400)).otherwise(F.lit("2001-12-31").cast("date"))
    cohorts = t.employee.groupBy(
        F.trunc("hire_date", "MM").alias("from_month"), F.trunc(end, "MM").alias("to_month"), left.alias("leaves")
    ).agg(F.count(F.lit(1)).alias("headcount"), F.sum("salary").alias("pay"))
    rows = month_spine_rows(cohorts, F.col("from_month"), F.col("to_month"), "1995-01-01", "2001-12-31")
    exits = F.when(F.col("leaves") & (F.trunc("month_end", "MM") == F.col("to_month")), F.col("headcount")).otherwise(F.lit(0))
    return rows.withColumn("exits", exits)


@query("x02_monthly_attrition_trend", emp("""
SELECT strftime(r.month_end, '%Y-%m-%d') AS month_end, r.headcount, r.exits, round(r.rate, 6) AS attrition_rate, round(r.ytd, 6) AS attrition_rate_ytd,
 round(p.rate, 6) AS attrition_rate_py, round(r.rate - p.rate, 6) AS attrition_rate_change_vs_py,
 CASE WHEN p.rate IS NULL THEN '—' WHEN r.rate > p.rate THEN '▲' ELSE '▼' END AS attrition_trend,
 round(r.avg_salary - p.avg_salary, 2) AS avg_salary_change_vs_py
FROM rated r LEFT JOIN rated p ON r.month_end = last_day(p.month_end + INTERVAL 12 MONTH)""", MONTHLY))
def monthly_trend(t):
    trend = catalogue.monthly_trend(monthly_cohorts(t))
    return trend.withColumn("month_end", F.date_format("month_end", "yyyy-MM-dd"))
