"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import (
    COMPA, EMPLOYEE_SOURCE, FEMALE, GAP, HIGH, LEFT, MALE, RATINGS, SOURCES, STAYED, avg, case_bands, cnt, emp,
    pct,
)
from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, round_half_up
from rosterlens.operators import attrition, compensation, grouping, talent, workforce
from rosterlens.operators.ranking import compa_ratio_level_median
from rosterlens.operators.reshape import kpi_pairs

ATT_SHARE = f"(CAST({cnt(LEFT)} AS DOUBLE) / count(*))"
HEALTH = f"""SELECT round(a, 1) AS attrition_score, round(e, 1) AS engagement_points, round(p, 1) AS performance_points,
 round(q, 1) AS equity_points, round(a + e + p + q, 1) AS health_score FROM (
 SELECT (1e0 - least({ATT_SHARE}, 0.5::DOUBLE) / 0.5::DOUBLE) * 30 AS a, {avg('engagement_score', digits=None)} / 100e0 * 30 AS e,
 CAST({cnt(HIGH)} AS DOUBLE) / count(*) * 20 AS p,
 (1e0 - least(abs({GAP}) / 100e0, 0.10::DOUBLE) / 0.10::DOUBLE) * 20 AS q FROM employee)"""


@query("a21_org_health_index", emp(HEALTH))
def org_health_index(t):
    return workforce.org_health_index(t.employee)


@query("a22_pay_equity_index", emp(f"""
SELECT round(g, 2) AS pay_gap_pct, round(i, 2) AS pay_equity_index, CASE WHEN i >= 97 THEN 'within noise' WHEN i >= 95 THEN 'acceptable'
 WHEN i >= 90 THEN 'remediation warranted' ELSE 'material exposure' END AS reading
FROM (SELECT g, 100e0 - least(g, 10e0) / 10e0 * 100 AS i FROM (SELECT abs({GAP}) AS g FROM employee))"""))
def pay_equity_index(t):
    return compensation.pay_equity_index(t.employee)


GENDERS = "genders(gender) AS (VALUES ('Male'), ('Female'), ('Non-binary'))"


@query("a23_representation_by_level", emp("""
SELECT job_level, g.gender, round(100e0 * count(*) FILTER (WHERE e.gender = g.gender) / count(*), 2) AS pct
FROM employee e, genders g GROUP BY 1, 2""", GENDERS))
def representation_by_level(t):
    return talent.representation_by_level(t.employee)


@query("a24_new_vs_existing_mix", emp("""
SELECT g.gender, p.population, coalesce(round(100e0 * count(*) FILTER (WHERE e.gender = g.gender AND e.pop = p.population)
 / nullif(count(*) FILTER (WHERE e.pop = p.population), 0), 2), 0) AS pct
FROM (SELECT *, CASE WHEN years_at_company < 1 THEN 'New Hires' ELSE 'Existing Workforce' END AS pop FROM employee) e,
 genders g, (VALUES ('New Hires'), ('Existing Workforce')) p(population) GROUP BY 1, 2""", GENDERS))
def new_vs_existing_mix(t):
    return talent.new_vs_existing_mix(t.employee)


def _cell(g: str) -> str:
    return f"{pct(cnt(f'gender = {chr(39)}{g}{chr(39)} AND {LEFT}'), cnt(f'gender = {chr(39)}{g}{chr(39)}'))} AS {grouping.slug(g)}"


@query("a25_attrition_matrix", emp(f"""
SELECT department, {_cell('Male')}, {_cell('Female')}, {_cell('Non-binary')} FROM employee GROUP BY 1"""))
def attrition_matrix(t):
    return grouping.rate_matrix(t.employee, "department", "gender", scores.is_attrited(), ("Male", "Female", "Non-binary"))


def _share_sql(row: str, column: str, source: str = "employee") -> str:
    return (f"SELECT {row}, {column}, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY {row}), 2) AS pct "
            f"FROM {source} GROUP BY 1, 2")


@query("a26_crosstab_pct_rating", emp(_share_sql("department", "performance_rating")))
def crosstab_rating(t):
    return grouping.crosstab_pct(t.employee, "department", "performance_rating")


@query("a26_crosstab_pct_work_mode", emp(_share_sql("department", "work_mode")))
def crosstab_mode(t):
    return grouping.crosstab_pct(t.employee, "department", "work_mode")


AGE_RIGHT = case_bands("age", bands.AGE_EDGES, bands.AGE_LABELS_SHORT, "<=")


@query("a27_crosstab_count_age_level", emp(f"SELECT {AGE_RIGHT} AS age_band, job_level, count(*) AS n FROM employee GROUP BY 1, 2"))
def crosstab_age(t):
    return workforce.age_by_level(t.employee)


@query("a28_rating_distribution_vs_target", emp("""
SELECT performance_rating, performance_label, n, actual_pct, CAST(target_pct AS DOUBLE) AS target_pct,
 round(actual_pct - target_pct, 2) AS difference_pp FROM ratings JOIN (
 SELECT performance_rating, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS actual_pct FROM employee GROUP BY 1)
 USING (performance_rating)""", RATINGS))
def rating_distribution(t):
    return talent.rating_distribution_vs_target(t.employee, t.ratings)


@query("a29_calibration_outliers", emp(f"""
SELECT manager_id, count(*) AS team_size, {pct(cnt('performance_rating <= 2'))} AS pct_below_expectations,
 {avg('performance_rating')} AS avg_rating FROM employee WHERE manager_id IS NOT NULL GROUP BY 1
HAVING count(*) >= 3 AND 100e0 * {cnt('performance_rating <= 2')} / count(*) > 15"""))
def calibration_outliers(t):
    return talent.calibration_outliers(t.employee)


@query("a30_bonus_ratio_by_rating", emp("""
SELECT performance_rating, count(*) AS headcount, round(100e0 * avg(CAST(bonus AS DOUBLE) / salary), 4) AS bonus_pct FROM employee GROUP BY 1"""))
def bonus_ratio(t):
    return compensation.bonus_ratio_by_rating(t.employee)


@query("a31_comp_cost_by_department", emp("SELECT department, CAST(sum(salary + bonus) AS BIGINT) AS total_cost FROM employee GROUP BY 1"))
def comp_cost(t):
    return compensation.comp_cost_by_department(t.employee)


def with_compa(t):
    return compa_ratio_level_median(t.employee)


@query("a32_comp_detail", emp(f"""
SELECT department, job_level, count(*) AS headcount, {avg('salary')} AS avg_salary, round(avg(compa_ratio), 3) AS avg_compa_ratio,
 {avg('bonus')} AS avg_bonus FROM compa GROUP BY 1, 2""", COMPA))
def comp_detail(t):
    return compensation.comp_detail(with_compa(t))


@query("a33_department_detail", emp(f"""
SELECT department, count(*) AS headcount, {avg('years_at_company', digits=1)} AS avg_tenure, {avg('salary', digits=1)} AS avg_salary,
 {pct(cnt("work_mode = 'Remote'"), digits=1)} AS remote_pct, {pct(cnt(LEFT), digits=1)} AS attrition_pct FROM employee GROUP BY 1"""))
def department_detail(t):
    return workforce.department_detail(t.employee)


def _curve_sql(labels, op: str, where: str = "") -> str:
    y = "years_at_company"
    return emp(f"""SELECT {case_bands(y, bands.TENURE_EDGES, labels, op)} AS tenure_band,
 {case_bands(y, bands.TENURE_EDGES, range(1, 8), op)} AS band_index, count(*) AS headcount, {pct(cnt(LEFT))} AS attrition_rate_pct
 FROM employee {where} GROUP BY 1, 2""")


@query("a34_tenure_attrition_curve", _curve_sql(bands.TENURE_LABELS, "<"))
def tenure_curve(t):
    return attrition.tenure_attrition_curve(t.employee)


@query("a34_tenure_attrition_curve_right", _curve_sql(bands.TENURE_LABELS_SHORT, "<=", "WHERE years_at_company > 0"))
def tenure_curve_right(t):
    curve = attrition.tenure_attrition_curve(t.employee, "right")
    return curve.where(F.col("tenure_band").isNotNull())


def _histogram_sql(source: str, x: str, bins: int) -> str:
    return f"""SELECT bin, round(lo + (bin - 1) * w, 4) AS bin_start, count(*) AS n, any_value(med) AS median FROM (
 SELECT CAST(least(floor(coalesce((v - lo) / nullif(w, 0), 0)) + 1, {bins}) AS INT) AS bin, lo, w, med FROM (
 SELECT CAST({x} AS DOUBLE) AS v, min(CAST({x} AS DOUBLE)) OVER () AS lo,
  (max(CAST({x} AS DOUBLE)) OVER () - min(CAST({x} AS DOUBLE)) OVER ()) / {bins}e0 AS w,
  (SELECT quantile_cont(CAST({x} AS DOUBLE), 0.5) FROM {source}) AS med FROM {source})) GROUP BY bin, lo, w"""


@query("a35_histogram_tenure", emp(_histogram_sql("employee", "years_at_company", 40)))
def histogram_tenure(t):
    return workforce.histogram(t.employee, "years_at_company", 40)


@query("a35_histogram_span", emp(
    _histogram_sql("teams", "reports", 20),
    "teams AS (SELECT manager_id, count(*) AS reports FROM employee WHERE manager_id IS NOT NULL GROUP BY 1)",
))
def histogram_span(t):
    return workforce.span_histogram(t.employee)


TIER_LIST = "tiers(engagement_tier, sort_index) AS (VALUES ('High Risk', 1), ('Medium Risk', 2), ('Low Risk', 3), ('Engaged', 4))"


@query("a36_value_counts_tier", emp(f"""
SELECT engagement_tier, sort_index, coalesce(n, 0) AS n FROM tiers LEFT JOIN (
 SELECT {case_bands('engagement_score', bands.ENGAGEMENT_EDGES, bands.ENGAGEMENT_TIERS)} AS engagement_tier, count(*) AS n
 FROM employee GROUP BY 1) USING (engagement_tier)""", TIER_LIST))
def value_counts_tier(t):
    tiered = t.employee.select(bands.engagement_tier("engagement_score").alias("engagement_tier"))
    return grouping.value_counts(tiered, "engagement_tier", bands.ENGAGEMENT_TIERS)


@query("a36_value_counts_level", emp("""
SELECT job_level, sort_index, coalesce(n, 0) AS n FROM (VALUES ('L8', 1), ('L7', 2), ('L6', 3), ('L5', 4), ('L4', 5), ('L3', 6), ('L2', 7)) o(job_level, sort_index)
LEFT JOIN (SELECT job_level, count(*) AS n FROM employee GROUP BY 1) USING (job_level)"""))
def value_counts_level(t):
    return grouping.value_counts(t.employee, "job_level", ("L8", "L7", "L6", "L5", "L4", "L3", "L2"))


@query("a36_value_counts_location", emp("SELECT location, count(*) AS n FROM employee GROUP BY 1"))
def value_counts_location(t):
    return grouping.value_counts(t.employee, "location")


@query("a37_source_by_department", emp("""
SELECT department, recruitment_source, count(*) AS n FROM es WHERE department IN (
 SELECT department FROM employee GROUP BY 1 ORDER BY count(*) DESC, department LIMIT 3) GROUP BY 1, 2""", SOURCES, EMPLOYEE_SOURCE))
def source_by_department(t):
    return talent.source_by_department(t.employee_with_source, 3)


@query("a38_source_gender_mix", emp(_share_sql("recruitment_source", "gender", "es"), SOURCES, EMPLOYEE_SOURCE))
def source_gender_mix(t):
    return talent.source_gender_mix(t.employee_with_source)


NUMERIC = ["engagement_score", "satisfaction_score", "attendance_pct", "performance_rating", "years_at_company", "promotions",
           "leave_count", "salary", "training_hours", "compa_ratio"]
CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS metric, round(corr(CAST({c} AS DOUBLE), CASE WHEN {LEFT} THEN 1e0 ELSE 0e0 END), 6) AS correlation FROM compa"
    for c in NUMERIC
)


@query("a40_correlations", emp(CORR, COMPA))
def correlations(t):
    return attrition.correlations(with_compa(t), NUMERIC, scores.attrition_flag())


@query("a40_strongest_influencers", emp(f"""
SELECT arg_max(metric, correlation) AS top_positive, max(correlation) AS top_positive_r, arg_min(metric, correlation) AS top_negative,
 min(correlation) AS top_negative_r FROM ({CORR})""", COMPA))
def influencers(t):
    return attrition.strongest_influencers(attrition.correlations(with_compa(t), NUMERIC, scores.attrition_flag()))


@query("a41_correlation_and_trend", emp("""
SELECT round(corr(x, y), 6) AS r, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept
FROM (SELECT CAST(performance_rating AS DOUBLE) AS x, compa_ratio AS y FROM compa)""", COMPA))
def correlation_and_trend(t):
    return compensation.correlation_and_trend(with_compa(t), "performance_rating", "compa_ratio")


@query("a42_decompose_one", emp(f"SELECT gender, count(*) AS attrition_count FROM employee WHERE {LEFT} GROUP BY 1"))
def decompose_one(t):
    return attrition.decompose(t.employee, "gender")


@query("a42_decompose_two", emp(f"SELECT department, work_mode, count(*) AS attrition_count FROM employee WHERE {LEFT} GROUP BY 1, 2"))
def decompose_two(t):
    return attrition.decompose(t.employee, "department", "work_mode")


@query("a43_enps", emp(f"""
SELECT {cnt('satisfaction_score >= 80')} AS promoters, {cnt('satisfaction_score < 40')} AS detractors,
 round(100e0 * ({cnt('satisfaction_score >= 80')} - {cnt('satisfaction_score < 40')}) / count(*), 0) AS enps FROM employee"""))
def enps(t):
    return talent.enps(t.employee)


@query("a44_diversity_index", emp("""
SELECT round(1e0 - sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 4) AS diversity_index
FROM (SELECT gender, count(*) AS n FROM employee GROUP BY 1)"""))
def diversity_index(t):
    return talent.diversity_index(t.employee)


ANSWERS = {
    "attrition_by_department": f"SELECT department, {pct(cnt(LEFT), digits=1)} AS attrition_rate_pct FROM es GROUP BY 1",
    "salary_by_gender": f"SELECT gender, {avg('salary', digits=0)} AS avg_salary FROM es GROUP BY 1",
    "engagement_by_level": f"SELECT job_level, {avg('engagement_score', digits=1)} AS avg_engagement FROM es GROUP BY 1",
    "source_quality": f"""SELECT recruitment_source, {avg('performance_rating')} AS avg_performance, {pct(cnt(STAYED))} AS retention_rate_pct
 FROM es GROUP BY 1""",
    "promotion_by_department": f"SELECT department, {pct(cnt('promotions >= 1'), digits=1)} AS promotion_rate_pct FROM es GROUP BY 1",
}
for _name, _sql in ANSWERS.items():
    query(f"a45_answer_{_name}", emp(_sql, SOURCES, EMPLOYEE_SOURCE))(
        lambda t, name=_name: attrition.canned_answers(name, t.employee_with_source)
    )


@query("a45_answer_engagement_of_department", emp(f"""
SELECT job_level, count(*) AS headcount, {avg('engagement_score', digits=1)} AS avg_engagement FROM employee
WHERE department = 'FURNITURE' GROUP BY 1"""))
def engagement_of_department(t):
    return attrition.department_engagement_by_level(t.employee, "FURNITURE")


@query("a46_insight_facts", emp(f"""
SELECT round(a, 1) AS attrition_pct, round(a - 18, 1) AS vs_benchmark_pp, w.department AS worst_department, round(w.rate, 1) AS worst_department_pct,
 round(w.compa, 3) AS worst_department_compa, CASE WHEN w.compa < 0.95 THEN 'below market' ELSE 'near market' END AS compa_status,
 round(w.eng - e, 1) AS engagement_vs_company, round(g, 2) AS gender_pay_gap_pct,
 CASE WHEN g < 2 THEN 'noise' WHEN g < 5 THEN 'monitor' ELSE 'material' END AS gap_class, h AS high_flight_risk_pct
FROM (SELECT {pct(cnt(LEFT), digits=None)} AS a, {avg('engagement_score', digits=None)} AS e, abs({GAP}) AS g,
  {pct(cnt('engagement_score < 40'), digits=1)} AS h FROM compa),
 (SELECT department, {pct(cnt(LEFT), digits=None)} AS rate, avg(compa_ratio) AS compa, {avg('engagement_score', digits=None)} AS eng
  FROM compa GROUP BY 1 ORDER BY rate DESC, department DESC LIMIT 1) w""", COMPA))
def insight_facts(t):
    return attrition.insight_facts(with_compa(t))


PROFILE = " UNION ALL ".join(
    f"""SELECT e.employee_id, e.department, '{label}' AS metric, round(CAST(e.{c} AS DOUBLE), 4) AS value, round(m.{c}, 4) AS department_avg,
 round(CAST(e.{c} AS DOUBLE) - m.{c}, 4) AS delta FROM compa e JOIN means m USING (department)"""
    for label, c in talent.PROFILE_METRICS
)
MEANS = "means AS (SELECT department, " + ", ".join(
    f"{avg(c, digits=None)} AS {c}" for _, c in talent.PROFILE_METRICS
) + " FROM compa GROUP BY 1)"


@query("a47_profile_vs_peers", emp(PROFILE, COMPA, MEANS))
def profile_vs_peers(t):
    return talent.profile_vs_peers(with_compa(t))


LVL = "CAST(substr(job_level, 2, 1) AS INT)"


@query("a49_ic_mgr_exec_mix", emp(f"""
SELECT {cnt(f'{LVL} <= 4')} AS ic_count, {cnt(f'{LVL} BETWEEN 5 AND 6')} AS manager_count, {cnt(f'{LVL} >= 7')} AS executive_count,
 {pct(cnt(f'{LVL} <= 4'))} AS ic_pct, {pct(cnt(f'{LVL} BETWEEN 5 AND 6'))} AS manager_pct, {pct(cnt(f'{LVL} >= 7'))} AS executive_pct FROM employee"""))
def level_mix(t):
    return workforce.level_mix(t.employee)


@query("a50_training_by_rating", emp(f"SELECT performance_rating, {avg('training_hours')} AS avg_training_hours FROM employee GROUP BY 1"))
def training_by_rating(t):
    return talent.training_by_rating(t.employee)


@query("a51_retention_gap", emp(f"""
SELECT round(a, 2) AS overall_retention_pct, round(h, 2) AS high_performer_retention_pct, round(h - a, 2) AS gap_pp,
 CASE WHEN h - a < -2 THEN 'inverted' ELSE 'healthy' END AS pattern
FROM (SELECT {pct(cnt(STAYED), digits=None)} AS a, {pct(cnt(f'{STAYED} AND {HIGH}'), cnt(HIGH), None)} AS h FROM employee)"""))
def retention_gap(t):
    return talent.retention_gap(t.employee)


def _r1(cond: str, among: str | None = None) -> str:
    return pct(cnt(cond), digits=1) if among is None else pct(cnt(f"{cond} AND {among}"), cnt(among), 1)


VOLUNTARY = f"{LEFT} AND exit_reason IS NOT NULL AND exit_reason NOT IN ('N/A', '')"
SENIOR = "job_level IN ('L6', 'L7', 'L8')"
STRIPS = {
    "overview": f"""count(*) AS total_headcount, {_r1(LEFT)} AS attrition_rate, {avg('engagement_score', digits=1)} AS avg_engagement,
 {avg('salary', digits=0)} AS avg_salary, {cnt('engagement_score < 40')} AS high_flight_risk, {_r1(f'{LEFT} AND {HIGH}')} AS regrettable_pct""",
    "workforce": f"""count(*) AS total_headcount, {_r1("work_mode = 'Remote'")} AS remote_pct, {avg('years_at_company', digits=1)} AS avg_tenure,
 count(DISTINCT department) AS departments""",
    "attrition": f"""{_r1(LEFT)} AS overall_rate, {_r1(VOLUNTARY)} AS voluntary_rate, {_r1(f'{LEFT} AND {HIGH}')} AS regrettable_rate,
 {_r1(LEFT, 'years_at_company < 1')} AS new_hire_rate, round(CAST(sum(salary) FILTER (WHERE {LEFT}) AS DOUBLE) * 1.5::DOUBLE / 1e6, 1) AS attrition_cost_m""",
    "performance": f"""{avg('performance_rating')} AS avg_rating, {_r1(HIGH)} AS high_performer_pct, {_r1(STAYED)} AS overall_retention,
 {_r1(STAYED, HIGH)} AS high_performer_retention, {cnt('performance_rating = 1')} AS improvement_plan_count""",
    "compensation": f"""round({GAP}, 2) AS pay_gap_pct, round(CAST(sum(salary + bonus) AS DOUBLE) / 1e6, 1) AS total_comp_cost_m,
 round(100e0 * avg(CAST(bonus AS DOUBLE) / salary), 1) AS avg_bonus_ratio_pct""",
    "recruitment": f"""{_r1("recruitment_source = 'Internal Transfer'")} AS internal_hire_rate, {avg('performance_rating')} AS avg_performance,
 count(DISTINCT recruitment_source) AS channels""",
    "diversity": f"""{_r1(FEMALE)} AS female_pct, {_r1(FEMALE, SENIOR)} AS female_senior_pct, abs(round({GAP}, 2)) AS pay_gap_pct,
 round(100e0 * (CAST({cnt(f'{LEFT} AND {FEMALE}')} AS DOUBLE) / {cnt(FEMALE)} - CAST({cnt(f'{LEFT} AND {MALE}')} AS DOUBLE) / {cnt(MALE)}), 1)
 AS attrition_differential_pp""",
}
for _name, _sql in STRIPS.items():
    query(f"a52_headline_{_name}", emp(f"SELECT {_sql} FROM es", SOURCES, EMPLOYEE_SOURCE))(
        lambda t, name=_name: workforce.headline_kpis(t.employee_with_source, name)
    )


@query("a52_below_market", emp(f"""
SELECT count(*) AS n, {cnt('compa_ratio < 0.85')} AS below, {pct(cnt('compa_ratio < 0.85'))} AS below_market_pct FROM compa""", COMPA))
def below_market(t):
    return compensation.below_market(with_compa(t), 0.85)


@query("a53_top_source_by_volume", emp("""
SELECT recruitment_source, count(*) AS volume FROM es GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1""", SOURCES, EMPLOYEE_SOURCE))
def top_source_volume(t):
    return talent.source_ranking_top1(t.employee_with_source, "recruitment_source", n_rows(), "volume")


@query("a53_top_source_by_engagement", emp(f"""
SELECT recruitment_source, {avg('engagement_score', digits=4)} AS measure FROM es GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1""", SOURCES, EMPLOYEE_SOURCE))
def top_source_engagement(t):
    return talent.source_ranking_top1(t.employee_with_source, "recruitment_source", round_half_up(mean("engagement_score"), 4))


@query("s08_kpi_pairs", emp(f"""
SELECT * FROM (SELECT unnest(['total_headcount', 'attrited', 'high_performers']) AS metric,
 unnest([CAST(count(*) AS VARCHAR), CAST({cnt(LEFT)} AS VARCHAR), CAST({cnt(HIGH)} AS VARCHAR)]) AS value FROM employee)"""))
def kpi_rows(t):
    kpis = t.employee.agg(
        n_rows().alias("total_headcount"), count_if(scores.is_attrited()).alias("attrited"),
        count_if(scores.is_high_performer()).alias("high_performers"),
    )
    return kpi_pairs(kpis)
