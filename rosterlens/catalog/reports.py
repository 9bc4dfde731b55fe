"""Grouped reports (A01-A20 and the workforce ones)."""

from __future__ import annotations

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import (
    COMPA, EMPLOYEE_SOURCE, FEMALE, GAP, HIGH, LEFT, LEVELS, MALE, MEAN_F, MEAN_M, RATINGS, SOURCES, STAYED, avg, big,
    case_bands, cnt, emp, pct, q,
)
from rosterlens.functions import bands
from rosterlens.operators import attrition, compensation, talent, workforce
from rosterlens.operators.ranking import compa_ratio_level_median, latest_per_key

KPI_SQL = f"""SELECT department, count(*) AS total_headcount, {cnt(STAYED)} AS active_headcount, {cnt(LEFT)} AS attrition_count,
 {pct(cnt(LEFT))} AS attrition_rate_pct, {avg('salary')} AS avg_salary, quantile_cont(salary, 0.5) AS median_salary,
 {avg('engagement_score')} AS avg_engagement_score, {avg('satisfaction_score')} AS avg_satisfaction_score,
 {avg('performance_rating', digits=3)} AS avg_performance_rating, {avg('attendance_pct')} AS avg_attendance_pct,
 {avg('training_hours')} AS avg_training_hours, {avg('years_at_company')} AS avg_tenure_years,
 {cnt(HIGH)} AS high_performer_count, {pct(cnt(HIGH))} AS high_performer_pct,
 {cnt('engagement_score < 40')} AS high_flight_risk_count, {pct(cnt(f'{LEFT} AND {HIGH}'))} AS regrettable_attrition_pct
FROM employee GROUP BY department"""


@query("a01_department_kpis", emp(KPI_SQL))
def department_kpis(t):
    return workforce.department_kpis(t.employee)


@query("a02_pay_equity_by_level_gender", emp(f"""
SELECT g.job_level, g.gender, employee_count, avg_salary, level_median, gender_median,
 round(100e0 * (gender_median - level_median) / level_median, 2) AS pay_gap_vs_median_pct,
 round(gender_median - level_median, 2) AS pay_gap_vs_median_amt
FROM (SELECT job_level, gender, count(*) AS employee_count, {avg('salary')} AS avg_salary,
 quantile_cont(salary, 0.5) AS gender_median FROM employee GROUP BY ALL) g
JOIN (SELECT job_level, quantile_cont(salary, 0.5) AS level_median FROM employee GROUP BY ALL) l USING (job_level)"""))
def pay_equity(t):
    return compensation.pay_equity_by_level_gender(t.employee)


REPORT_COLUMNS = f"""employee_id, employee_name, department, job_level, gender, CAST(years_at_company AS DOUBLE) AS years_at_company,
 salary, performance_rating, CAST(engagement_score AS DOUBLE) AS engagement_score, promotions, exit_reason,
 CASE WHEN {HIGH} THEN 'Yes' ELSE 'No' END AS is_regrettable, {big('floor(salary * 1.5)')} AS estimated_replacement_cost"""


@query("a03_attrition_report", emp(f"SELECT {REPORT_COLUMNS} FROM employee WHERE {LEFT}"))
def attrition_report(t):
    return attrition.attrition_report(t.employee)


@query("a03_attrition_report_filtered", emp(f"""SELECT {REPORT_COLUMNS} FROM employee
WHERE {LEFT} AND department = 'MACHINERY' AND years_at_company >= 1 AND years_at_company <= 4 AND {HIGH}"""))
def attrition_report_filtered(t):
    return attrition.attrition_report(t.employee, department="MACHINERY", min_tenure=1, max_tenure=4, regrettable_only=True)


def _manager_sql(third: str) -> str:
    return emp(f"""SELECT manager_id, manager_name, manager_department, team_size, avg_team_engagement, avg_team_satisfaction,
 retention_rate_pct, high_performer_pct, avg_team_performance, team_attrition_rate_pct,
 round(s, 2) AS effectiveness_score, CASE WHEN s >= 75 THEN 'Green' WHEN s >= 55 THEN 'Amber' ELSE 'Red' END AS rag_status
FROM (SELECT *, avg_team_engagement * 0.40::DOUBLE + retention_rate_pct * 0.40::DOUBLE + third * 0.20::DOUBLE AS s FROM (
 SELECT e.manager_id, m.employee_name AS manager_name, m.department AS manager_department, count(*) AS team_size,
 {avg('e.engagement_score')} AS avg_team_engagement, {avg('e.satisfaction_score')} AS avg_team_satisfaction,
 {pct(cnt("e.attrition = 'No'"))} AS retention_rate_pct, {pct(cnt('e.performance_rating >= 4'))} AS high_performer_pct,
 {avg('e.performance_rating', digits=3)} AS avg_team_performance, {pct(cnt("e.attrition = 'Yes'"))} AS team_attrition_rate_pct,
 {third} AS third
 FROM employee e JOIN employee m ON e.manager_id = m.employee_id GROUP BY ALL HAVING count(*) >= 3))""")


@query("a04_manager_effectiveness", _manager_sql(pct(cnt("e.performance_rating >= 4"))))
def manager_effectiveness(t):
    return workforce.manager_effectiveness(t.employee)


@query("a04_manager_effectiveness_promotions", _manager_sql(pct(cnt("e.promotions >= 1"))))
def manager_effectiveness_promotions(t):
    return workforce.manager_effectiveness(t.employee, variant="promotion")


@query("a05_headcount_pyramid", emp(f"""
SELECT job_level, level_name, career_track, sort_order, count(*) AS headcount, {avg('salary')} AS avg_salary,
 {avg('engagement_score')} AS avg_engagement, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_total
FROM employee JOIN levels USING (job_level) WHERE {STAYED} GROUP BY ALL""", LEVELS))
def headcount_pyramid(t):
    return workforce.headcount_pyramid(t.employee, t.job_levels)


@query("a06_gender_by_level", emp(f"""
SELECT job_level, level_name, sort_order, count(*) AS total_headcount, {cnt(MALE)} AS male_count, {cnt(FEMALE)} AS female_count,
 {cnt("gender = 'Non-binary'")} AS non_binary_count, {pct(cnt(FEMALE), digits=1)} AS female_representation_pct,
 round({MEAN_M} - {MEAN_F}, 2) AS salary_gap_amt, round({GAP}, 2) AS pay_gap_pct
FROM employee JOIN levels USING (job_level) GROUP BY ALL""", LEVELS))
def gender_by_level(t):
    return workforce.gender_by_level(t.employee, t.job_levels)


@query("a07_work_mode_by_department", emp(f"""
SELECT department, count(*) AS total_employees, {cnt("work_mode = 'On-site'")} AS onsite_count,
 {cnt("work_mode = 'Hybrid'")} AS hybrid_count, {cnt("work_mode = 'Remote'")} AS remote_count,
 {pct(cnt("work_mode = 'Remote'"), digits=1)} AS remote_pct,
 {pct(cnt(f"work_mode = 'Remote' AND {LEFT}"), cnt("work_mode = 'Remote'"))} AS remote_attrition_pct,
 {pct(cnt(f"work_mode = 'On-site' AND {LEFT}"), cnt("work_mode = 'On-site'"))} AS onsite_attrition_pct
FROM employee GROUP BY ALL"""))
def work_mode_by_department(t):
    return workforce.work_mode_by_department(t.employee)


@query("a08_span_of_control", emp(f"""
SELECT m.employee_id AS manager_id, m.employee_name AS manager_name, m.department, m.job_level AS manager_level,
 count(*) AS direct_report_count,
 CASE WHEN count(*) > 12 THEN 'Overloaded (>12)' WHEN count(*) < 4 THEN 'Under-span (<4)' ELSE 'Optimal (4-12)' END AS span_status,
 {avg('e.engagement_score')} AS team_avg_engagement, {pct(cnt("e.attrition = 'Yes'"))} AS team_attrition_pct
FROM employee e JOIN employee m ON e.manager_id = m.employee_id GROUP BY ALL"""))
def span_of_control(t):
    return workforce.span_of_control(t.employee)


@query("a08_average_span", emp("""
SELECT count(DISTINCT manager_id) AS managers, count(manager_id) AS reports,
 round(CAST(count(manager_id) AS DOUBLE) / count(DISTINCT manager_id), 2) AS avg_span FROM employee"""))
def average_span(t):
    return workforce.average_span(t.employee)


@query("a09_executive_scorecard", emp(f"""
SELECT count(*) AS total_employees, {cnt(STAYED)} AS active_employees, {cnt(LEFT)} AS total_attrited,
 {pct(cnt(LEFT))} AS attrition_rate_pct, {pct(cnt(f'{LEFT} AND {HIGH}'))} AS regrettable_attrition_pct,
 {pct(cnt(f'{LEFT} AND years_at_company < 1'), cnt('years_at_company < 1'))} AS new_hire_attrition_pct,
 {avg('engagement_score')} AS avg_engagement_score, {avg('satisfaction_score')} AS avg_satisfaction_score,
 {cnt('engagement_score < 40')} AS high_flight_risk_count, {pct(cnt('engagement_score < 40'))} AS high_flight_risk_pct,
 {pct(cnt(HIGH))} AS high_performer_pct, {avg('performance_rating', digits=3)} AS avg_performance_rating,
 {avg('salary')} AS avg_salary, {avg('salary + bonus')} AS avg_total_comp, {avg('attendance_pct')} AS avg_attendance_pct,
 {avg('training_hours')} AS avg_training_hours, {avg('years_at_company')} AS avg_tenure_years,
 {avg('promotions', digits=3)} AS avg_promotions, {pct(cnt(FEMALE))} AS female_representation_pct,
 {big(f"floor(coalesce(sum(salary) FILTER (WHERE {LEFT}), 0) * 1.5)")} AS total_attrition_cost FROM employee"""))
def executive_scorecard(t):
    return workforce.executive_scorecard(t.employee)


def _light(x, top, mid, names, op=">="):
    return f"CASE WHEN {x} {op} {top} THEN '{names[0]}' WHEN {x} {op} {mid} THEN '{names[1]}' ELSE '{names[2]}' END"


@query("a10_department_heatmap", emp(f"""
SELECT department, headcount, round(a, 2) AS attrition_pct, {_light('a', 25, 18, '🔴🟡🟢')} AS attrition_rag,
 round(e, 1) AS avg_engagement, {_light('e', 75, 60, '🟢🟡🔴')} AS engagement_rag,
 round(g, 2) AS gender_pay_gap_pct, {_light('abs(g)', 5, 2, '🔴🟡🟢', '>')} AS pay_equity_rag,
 round(t, 1) AS avg_attendance, {_light('t', 95, 88, '🟢🟡🔴')} AS attendance_rag, avg_salary, avg_perf_rating
FROM (SELECT department, count(*) AS headcount, {pct(cnt(LEFT), digits=None)} AS a, {avg('engagement_score', digits=None)} AS e,
 {GAP} AS g, {avg('attendance_pct', digits=None)} AS t, {avg('salary')} AS avg_salary, {avg('performance_rating')} AS avg_perf_rating
 FROM employee GROUP BY department)"""))
def department_heatmap(t):
    return workforce.department_heatmap(t.employee)


ENG_SEG = case_bands("engagement_score", (50, 75), bands.ENGAGEMENT_SEGMENTS)
PERF_SEG = case_bands("performance_rating", (3, 4), ("Low Performance", "Core Performance", "High Performance"))
QUADRANT = "CASE " + " ".join(
    f"WHEN engagement_segment = '{e}' AND performance_segment = '{p}' THEN '{label}'"
    for (e, p), label in bands.QUADRANT_LABELS.items()
) + f" ELSE '{bands.QUADRANT_DEFAULT}' END"


@query("a11_nine_box", emp(f"""
SELECT *, {QUADRANT} AS quadrant_label FROM (
 SELECT {ENG_SEG} AS engagement_segment, {PERF_SEG} AS performance_segment, count(*) AS headcount,
 {pct(cnt(LEFT))} AS attrition_rate_pct, {avg('salary')} AS avg_salary,
 round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_total FROM employee GROUP BY 1, 2)"""))
def nine_box(t):
    return attrition.nine_box(t.employee)


def _drivers_sql() -> str:
    parts = []
    for label, column, divisor, digits in attrition.DRIVER_METRICS:
        y, n = avg(column, LEFT, None), avg(column, STAYED, None)
        parts.append(f"SELECT '{label}' AS metric, round({y} / {divisor}e0, {digits}) AS attrition_yes, "
                     f"round({n} / {divisor}e0, {digits}) AS attrition_no FROM employee")
    return emp(f"""SELECT *, round(attrition_yes - attrition_no, 3) AS delta,
 CASE WHEN attrition_yes > attrition_no THEN '{attrition.UP}' ELSE '{attrition.DOWN}' END AS direction
 FROM ({' UNION ALL '.join(parts)})""")


@query("a12_attrition_drivers", _drivers_sql())
def attrition_drivers(t):
    return attrition.attrition_drivers(t.employee)


@query("a13_regrettable_split", emp(f"""
SELECT department, count(*) AS total_attrited, {cnt(HIGH)} AS regrettable_count, {cnt('performance_rating <= 2')} AS managed_exit_count,
 {cnt('performance_rating = 3')} AS neutral_exit_count, {pct(cnt(HIGH))} AS regrettable_pct,
 {big(f"floor(coalesce(sum(salary) FILTER (WHERE {HIGH}), 0) * 1.5)")} AS regrettable_cost,
 {avg('salary', HIGH)} AS avg_salary_regrettable FROM employee WHERE {LEFT} GROUP BY department"""))
def regrettable_split(t):
    return attrition.regrettable_split(t.employee)


def _exit_sql(reason: str, where: str) -> str:
    return emp(f"""SELECT {reason} AS exit_reason, count(*) AS exit_count,
 {avg('engagement_score')} AS avg_engagement_at_exit, {avg('satisfaction_score')} AS avg_satisfaction_at_exit,
 {avg('salary')} AS avg_salary_at_exit, {avg('years_at_company')} AS avg_tenure_at_exit,
 {avg('performance_rating')} AS avg_perf_rating_at_exit, {pct(cnt(HIGH))} AS pct_high_performers,
 round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_all_exits
 FROM employee WHERE {LEFT} AND {where} GROUP BY 1""")


@query("a14_exit_reasons", _exit_sql("exit_reason", "exit_reason IS NOT NULL"))
def exit_reasons(t):
    return attrition.exit_reasons(t.employee)


@query("a14_exit_reasons_with_missing", _exit_sql("coalesce(exit_reason, 'Not Stated')", "true"))
def exit_reasons_with_missing(t):
    return attrition.exit_reasons(t.employee, include_missing=True)


BOX = ", ".join(f"{q('salary', p)} AS p{round(p * 100)}" for p in (0.10, 0.25, 0.50, 0.75, 0.90))


@query("a15_salary_box_plot", emp(f"""
SELECT job_level, level_name, band_min, band_max, count(*) AS n, CAST(min(salary) AS DOUBLE) AS min, {BOX},
 {avg('salary')} AS mean, CAST(max(salary) AS DOUBLE) AS max FROM employee JOIN levels USING (job_level) GROUP BY ALL""", LEVELS))
def salary_box_plot(t):
    return compensation.salary_box_plot(t.employee, t.job_levels)


BOX_ENG = ", ".join(f"{q('engagement_score', p)} AS p{round(p * 100)}" for p in (0.25, 0.50, 0.75))


@query("a15_engagement_box_by_outcome", emp(f"""
SELECT attrition, count(*) AS n, CAST(min(engagement_score) AS DOUBLE) AS min, {BOX_ENG}, {avg('engagement_score')} AS mean,
 CAST(max(engagement_score) AS DOUBLE) AS max FROM employee GROUP BY attrition"""))
def engagement_box(t):
    return compensation.box_plot(t.employee, ["attrition"], "engagement_score", (0.25, 0.50, 0.75))


STATUS = f"CASE WHEN abs({GAP}) > 5 THEN '🔴 Action Required' WHEN abs({GAP}) > 2 THEN '🟡 Monitor' ELSE '🟢 Within Range' END"


@query("a16_gender_pay_gap_by_level", emp(f"""
SELECT job_level, count(*) AS total_employees, {cnt(MALE)} AS male_count, {cnt(FEMALE)} AS female_count,
 {avg('salary', MALE)} AS male_avg_salary, {avg('salary', FEMALE)} AS female_avg_salary,
 round({MEAN_M} - {MEAN_F}, 2) AS raw_pay_gap_amt, round({GAP}, 2) AS pay_gap_pct, {STATUS} AS equity_status
FROM employee GROUP BY job_level"""))
def gender_pay_gap_by_level(t):
    return compensation.gender_pay_gap(t.employee, ["job_level"])


BAND_COMPA = "(CAST(salary AS DOUBLE) / (band_min + floor((band_max - band_min) / 2)))"


@query("a17_compa_ratio_distribution", emp(f"""
SELECT compa_ratio_band, band_index, count(*) AS employee_count, {pct(cnt(LEFT))} AS attrition_rate_pct,
 round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_total
FROM (SELECT *, {case_bands(BAND_COMPA, bands.COMPA_EDGES, bands.COMPA_LABELS)} AS compa_ratio_band,
 {case_bands(BAND_COMPA, bands.COMPA_EDGES, range(1, 7))} AS band_index FROM employee JOIN levels USING (job_level)) GROUP BY 1, 2""", LEVELS))
def compa_ratio_distribution(t):
    return compensation.compa_ratio_distribution(t.employee, t.job_levels)


@query("a18_source_quality", emp(f"""
SELECT recruitment_source, source_type, count(*) AS total_hires, {cnt(STAYED)} AS active_count,
 {pct(cnt(STAYED))} AS retention_rate_pct, {pct(cnt(LEFT))} AS attrition_rate_pct,
 {avg('performance_rating', digits=3)} AS avg_perf_rating, {avg('engagement_score')} AS avg_engagement,
 {avg('years_at_company')} AS avg_tenure_years, {avg('salary')} AS avg_salary,
 round({avg('performance_rating', digits=None)} / 5 * 35 + CAST({cnt(STAYED)} AS DOUBLE) / count(*) * 35
  + {avg('engagement_score', digits=None)} / 100 * 30, 2) AS quality_of_hire_score,
 round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS hire_share_pct FROM es GROUP BY 1, 2""", SOURCES, EMPLOYEE_SOURCE))
def source_quality(t):
    return talent.source_quality(t.employee_with_source)


INSIDE = "recruitment_source = 'Internal Transfer'"


@query("a19_internal_mobility", emp(f"""
SELECT department, count(*) AS total_employees, {cnt(INSIDE)} AS internal_hires, {pct(cnt(INSIDE))} AS internal_hire_rate_pct,
 {avg('performance_rating', INSIDE, 3)} AS internal_avg_perf, {avg('performance_rating', f'NOT {INSIDE}', 3)} AS external_avg_perf,
 {pct(cnt(f'{INSIDE} AND {STAYED}'), cnt(INSIDE))} AS internal_retention_pct,
 {pct(cnt(f'NOT {INSIDE} AND {STAYED}'), cnt(f'NOT {INSIDE}'))} AS external_retention_pct FROM es GROUP BY 1""", SOURCES, EMPLOYEE_SOURCE))
def internal_mobility(t):
    return talent.internal_mobility(t.employee_with_source)


@query("a20_latest_per_key", """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event(t):
    from pyspark.sql import functions as F

    latest = latest_per_key(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])
    return latest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("a54_promotion_overdue", emp(f"""
SELECT o.*, m.employee_name AS manager_name,
 CASE WHEN promotion_gap >= 3 AND o.performance_rating >= 4 THEN '{bands.PROMOTION_STATUSES[0]}'
  WHEN promotion_gap >= 2 AND o.performance_rating >= 3 THEN '{bands.PROMOTION_STATUSES[1]}'
  WHEN promotion_gap >= 1 THEN '{bands.PROMOTION_STATUSES[2]}' ELSE '{bands.PROMOTION_STATUSES[3]}' END AS promotion_status
FROM (SELECT employee_id, employee_name, department, job_level, manager_id, performance_rating, salary,
 promotions AS actual_promotions, round(CAST(years_at_company AS DOUBLE), 1) AS tenure_years,
 round(CAST(years_at_company AS DOUBLE) / 2.8::DOUBLE, 1) AS expected_promotions,
 round(CAST(years_at_company AS DOUBLE) / 2.8::DOUBLE - promotions, 1) AS promotion_gap,
 round(CAST(engagement_score AS DOUBLE), 1) AS engagement_score FROM employee WHERE {STAYED}) o
LEFT JOIN employee m ON o.manager_id = m.employee_id WHERE promotion_gap >= 1"""))
def promotion_overdue(t):
    return attrition.promotion_overdue(t.employee)


RATIO_COLUMNS = "employee_id, job_level, salary, level_median_salary, compa_ratio"


@query("p07_compa_ratio_level_median", emp(f"SELECT {RATIO_COLUMNS} FROM compa", COMPA))
def compa_by_level(t):
    return compa_ratio_level_median(t.employee).select(*RATIO_COLUMNS.split(", "))
