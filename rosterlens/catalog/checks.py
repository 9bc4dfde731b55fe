"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.columns import RULE, TIER
from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import LEFT, LEVELS, avg, cnt, emp, pct
from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct as pct_col
from rosterlens.models import risk
from rosterlens.operators import compensation, quality, workforce
from rosterlens.operators.grouping import exact_quantiles
from rosterlens.operators.reshape import domain_index

ZERO = "SELECT '{0}' AS check_name, CAST({1} AS DOUBLE) AS value, '0' AS expected, {1} = 0 AS passed FROM {2}".format


def zeros(rules: dict[str, str], source: str = "employee") -> str:
    return " UNION ALL ".join(ZERO(name, cnt(cond), source) for name, cond in rules.items())


@query("c01_row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, CAST(count(*) AS DOUBLE) AS value, '{e}' AS expected, count(*) = {e} AS passed FROM {n}"
    for n, e in (("region", 5), ("nation", 25), ("orders", 10000), ("customer", 1500))
))
def row_counts(t):
    tables = {"region": t.region, "nation": t.nation, "orders": t.orders, "customer": t.customer}
    return quality.row_counts(tables, {"region": 5, "nation": 25, "orders": 10_000, "customer": 1500})


# Employees of a manager, a level and an order that do not exist are added to the given ones.
STRAYS = """staffed AS (SELECT employee_id, manager_id, job_level FROM employee
 UNION ALL SELECT -1 - employee_id, -2 - employee_id, 'L0' FROM employee WHERE performance_rating = 1)"""
ORPHANS = """SELECT 'orphaned_manager' AS check_name, CAST(count(*) AS DOUBLE) AS value, '0' AS expected, count(*) = 0 AS passed
 FROM staffed WHERE manager_id IS NOT NULL AND manager_id NOT IN (SELECT employee_id FROM staffed)
UNION ALL SELECT 'orphaned_level', CAST(count(*) AS DOUBLE), '0', count(*) = 0 FROM staffed WHERE job_level NOT IN (SELECT job_level FROM levels)
UNION ALL SELECT 'orphaned_order', CAST(count(*) AS DOUBLE), '0', count(*) = 0 FROM staffed WHERE employee_id NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'self_managing_employee', CAST(count(*) AS DOUBLE), '0', count(*) = 0 FROM staffed WHERE employee_id = manager_id"""


@query("c02_orphans", emp(ORPHANS, LEVELS, STRAYS))
def orphans(t):
    columns = ["employee_id", "manager_id", "job_level"]
    key = F.col("employee_id")
    strays = t.employee.where("performance_rating = 1").select((-1 - key).alias("employee_id"), (-2 - key).alias("manager_id"), F.lit("L0").alias("job_level"))
    staffed = t.employee.select(*columns).unionByName(strays)
    references = {
        "orphaned_manager": ("manager_id", staffed, "employee_id"),
        "orphaned_level": ("job_level", t.job_levels, "job_level"),
        "orphaned_order": ("employee_id", t.lineitem.select("l_orderkey"), "l_orderkey"),
    }
    return quality.orphans(staffed, references, ("employee_id", "manager_id"))


@query("c03_completeness", emp(zeros({
    "null_names": "employee_name IS NULL OR employee_name = ''", "bad_salaries": "salary IS NULL OR salary <= 0",
    "bad_attrition_flag": "attrition IS NULL OR attrition NOT IN ('Yes', 'No')",
    "attrited_missing_reason": f"{LEFT} AND exit_reason IS NULL", "active_with_reason": "attrition = 'No' AND exit_reason IS NOT NULL",
})))
def completeness(t):
    return quality.completeness(t.employee)


RANGES = {
    "age": "age NOT BETWEEN 16 AND 80", "gender": "gender NOT IN ('Male', 'Female', 'Non-binary')",
    "work_mode": "work_mode NOT IN ('On-site', 'Hybrid', 'Remote')", "job_level": "job_level NOT IN ('L1','L2','L3','L4','L5','L6','L7','L8')",
    "years_at_company": "years_at_company < 0", "salary": "salary NOT BETWEEN 30000 AND 2000000", "bonus": "bonus < 0",
    "performance_rating": "performance_rating NOT BETWEEN 1 AND 5", "attendance_pct": "attendance_pct NOT BETWEEN 0 AND 100",
    "training_hours": "training_hours < 0", "engagement_score": "engagement_score NOT BETWEEN 0 AND 100",
    "satisfaction_score": "satisfaction_score NOT BETWEEN 0 AND 100", "promotions": "promotions < 0",
    "leave_count": "leave_count NOT BETWEEN 0 AND 365", "attrition": "attrition NOT IN ('Yes', 'No')",
}


@query("c04_domain_ranges", emp(zeros({f"{c}_out_of_domain": f"{c} IS NULL OR {rule}" for c, rule in RANGES.items()})))
def domain_ranges(t):
    return quality.domain_ranges(t.employee)


@query("c05_unique_key", """
SELECT 'unique_o_orderkey' AS check_name, CAST(count(*) AS DOUBLE) AS value, '0' AS expected, count(*) = 0 AS passed FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique_line', CAST(count(*) AS DOUBLE), '0', count(*) = 0 FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def unique_key(t):
    return quality.unique_key(t.orders, ["o_orderkey"]).unionByName(
        quality.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], "unique_line")
    )


COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_clerk", "o_orderdate")


@query("c06_columns_present", " UNION ALL ".join(
    f"""SELECT '{c}' AS check_name, {float(c != 'o_clerk')}::DOUBLE AS value, '1' AS expected, {c != 'o_clerk'} AS passed,
 {'count(' + c + ')' if c != 'o_clerk' else 'CAST(count(*) * 0 AS BIGINT)'} AS filled_rows FROM orders""" for c in COLUMNS
))
def columns_present(t):
    return quality.columns_present(t.orders, COLUMNS)


def band(name: str, expr: str, low, high) -> str:
    return (f"SELECT '{name}' AS check_name, round({expr}, 4) AS value, '{low}..{high}' AS expected, "
            f"round({expr}, 4) BETWEEN {low} AND {high} AS passed FROM employee")


@query("c07_sanity_bands", emp(" UNION ALL ".join([
    band("attrition_rate_pct", pct(cnt(LEFT), digits=None), 22.0, 25.5), band("avg_salary", avg("salary", digits=None), 165000, 175000),
    band("avg_engagement", avg("engagement_score", digits=None), 60, 75), band("avg_tenure", avg("years_at_company", digits=None), 2.3, 3.1),
    band("high_performer_share", f"CAST({cnt('performance_rating >= 4')} AS DOUBLE) / count(*)", 0.2, 0.4),
    band("departments", "CAST(count(DISTINCT department) AS DOUBLE)", 11, 11),
    band("improvement_plan_share", f"CAST({cnt('performance_rating = 1')} AS DOUBLE) / count(*)", 0, 0.1),
])))
def sanity_bands(t):
    # Accepted bands of the company figures.
    share = lambda cond: count_if(cond).cast("double") / n_rows()
    return quality.sanity_bands(t.employee, {
        "attrition_rate_pct": (F.lit(100.0) * count_if(scores.is_attrited()) / n_rows(), 22.0, 25.5),
        "avg_salary": (mean("salary"), 165000, 175000),
        "avg_engagement": (mean("engagement_score"), 60, 75),
        "avg_tenure": (mean("years_at_company"), 2.3, 3.1),
        "high_performer_share": (share(scores.is_high_performer()), 0.2, 0.4),
        "departments": (F.countDistinct("department"), 11, 11),
        "improvement_plan_share": (share(F.col("performance_rating") == 1), 0, 0.1),
    })


SCORED = f"scored AS (SELECT *, {TIER} AS risk_tier FROM (SELECT *, {RULE} AS risk_score FROM employee))"


@query("c08_monotonic", emp(f"""
SELECT 'median_pay_by_level' AS check_name, CAST({cnt('v < p')} AS DOUBLE) AS value, '0' AS expected, {cnt('v < p')} = 0 AS passed
FROM (SELECT v, lag(v) OVER (ORDER BY job_level) AS p FROM (SELECT job_level, quantile_cont(salary, 0.5) AS v FROM employee GROUP BY 1))
UNION ALL
SELECT 'outcome_by_tier', CAST({cnt('v < p')} AS DOUBLE), '0', {cnt('v < p')} = 0
FROM (SELECT v, lag(v) OVER (ORDER BY o) AS p FROM (SELECT CASE risk_tier WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS o,
 {pct(cnt(LEFT), digits=4)} AS v FROM scored GROUP BY 1))""", SCORED))
def monotonic(t):
    pay = exact_quantiles(t.employee, ["job_level"], "salary", {"median_salary": 0.5})
    scored = risk.rule_based_fallback(t.employee)
    tiers = scored.groupBy(domain_index("risk_tier", bands.RISK_TIERS).alias("tier_order")).agg(
        pct_col(count_if(scores.is_attrited()), n_rows(), 4).alias("rate")
    )
    return quality.monotonic(pay, "job_level", "median_salary", "median_pay_by_level").unionByName(
        quality.monotonic(tiers, "tier_order", "rate", "outcome_by_tier")
    )


@query("c09_partition_sums", emp(
    ZERO("engagement_tiers_cover_all", "(" + " + ".join(cnt(c) for c in (
        "engagement_score < 40", "engagement_score >= 40 AND engagement_score < 60", "engagement_score >= 60 AND engagement_score < 75", "engagement_score >= 75"
    )) + " - count(*))", "employee") + " UNION ALL " + ZERO("two_of_three_modes", f"({cnt(chr(119) + 'ork_mode IN (' + repr('Remote') + ', ' + repr('Hybrid') + ')')} - count(*))", "employee")))
def partition_sums(t):
    e = F.col("engagement_score")
    tiers = {"high": e < 40, "medium": (e >= 40) & (e < 60), "low": (e >= 60) & (e < 75), "engaged": e >= 75}
    modes = {m: F.col("work_mode") == m for m in ("Remote", "Hybrid")}
    return quality.partition_sums(t.employee, tiers, "engagement_tiers_cover_all").unionByName(
        quality.partition_sums(t.employee, modes, "two_of_three_modes")
    )


CONSISTENT = """base AS (SELECT *, risk_score / 100 + CASE WHEN employee_id % 97 = 0 THEN 0.02::DOUBLE ELSE 0 END AS model_probability,
 CASE WHEN employee_id % 101 = 0 THEN '' ELSE 'a | b | c' END AS top_drivers FROM scored)"""


@query("c10_score_consistency", emp(zeros({
    "score_outside_0_100": "risk_score NOT BETWEEN 0 AND 100", "probability_outside_0_1": "model_probability NOT BETWEEN 0 AND 1",
    "score_probability_mismatch": "abs(risk_score - model_probability * 100) >= 0.5", "missing_drivers": "length(top_drivers) = 0",
    "unknown_tier": "risk_tier NOT IN ('Low', 'Medium', 'High', 'Critical')",
}, "base"), SCORED, CONSISTENT))
def score_consistency(t):
    key = F.col("employee_id")
    scored = risk.rule_based_fallback(t.employee).withColumns({
        "model_probability": F.col("risk_score") / 100 + F.when(key % 97 == 0, F.lit(0.02)).otherwise(F.lit(0.0)),
        "top_drivers": F.when(key % 101 == 0, "").otherwise("a | b | c"),
    })
    return quality.score_consistency(scored)


@query("c11_view_counts", emp("""
SELECT 'department_kpis' AS check_name, CAST(count(DISTINCT department) AS DOUBLE) AS value, '>= 1' AS expected, count(DISTINCT department) >= 1 AS passed FROM employee
UNION ALL SELECT 'pay_equity', CAST(count(*) AS DOUBLE), '>= 20', count(*) >= 20 FROM (SELECT DISTINCT job_level, gender FROM employee)"""))
def view_counts(t):
    views = {
        "department_kpis": workforce.department_kpis(t.employee),
        "pay_equity": compensation.pay_equity_by_level_gender(t.employee),
    }
    return quality.view_counts(views, {"department_kpis": 1, "pay_equity": 20})




@query("c12_cohort_contrast", emp(f"""
SELECT 'cohort_rate_minus_overall' AS check_name, round(c - a, 6) AS value, '> 0' AS expected, c > a AS passed FROM (
 SELECT CAST({cnt(f'{LEFT} AND years_at_company < 1')} AS DOUBLE) / {cnt('years_at_company < 1')} AS c, CAST({cnt(LEFT)} AS DOUBLE) / count(*) AS a FROM employee)
UNION ALL SELECT 'cohort_exits_minus_total_exits', CAST({cnt(f'{LEFT} AND years_at_company < 1')} - {cnt(LEFT)} AS DOUBLE), '<= 0',
 {cnt(f'{LEFT} AND years_at_company < 1')} <= {cnt(LEFT)} FROM employee
UNION ALL SELECT 'group_rate_stddev', round(stddev_samp(r), 6), '> 0.02', stddev_samp(r) > 0.02 FROM (
 SELECT CAST({cnt(LEFT)} AS DOUBLE) / count(*) AS r FROM employee GROUP BY department)"""))
def cohort_contrast(t):
    return quality.cohort_contrast(t.employee, F.col("years_at_company") < 1, scores.is_attrited(), "department")
