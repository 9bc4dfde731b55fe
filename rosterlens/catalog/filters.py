"""Filters (F01-F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import HIGH, LEFT, STAYED, emp
from rosterlens.operators import filters, search
from rosterlens.operators.grouping import having_min_team
from rosterlens.session import scratch_path

IDS = "SELECT employee_id, department, attrition FROM employee WHERE "
COLUMNS = ("employee_id", "department", "attrition")


@query("f01_active_only", emp(IDS + STAYED))
def active_only(t):
    return filters.active_only(t.employee).select(*COLUMNS)


@query("f01_attrited_only", emp(IDS + LEFT))
def attrited_only(t):
    return filters.attrited_only(t.employee).select(*COLUMNS)


@query("f02_optional_filters", emp(IDS + f"department = 'BUILDING' AND years_at_company >= 2 AND {HIGH}"))
def optional_filters(t):
    return filters.optional_filters(t.employee, department="BUILDING", min_tenure=2, regrettable_only=True).select(*COLUMNS)


@query("f03_multi_select", emp(IDS + "department IN ('BUILDING', 'MACHINERY') AND work_mode IN ('Remote')"))
def multi_select(t):
    return filters.multi_select(
        t.employee, department=["BUILDING", "MACHINERY"], work_mode=["Remote"], location=[]
    ).select(*COLUMNS)


@query("f04_range_filter", emp(IDS + "salary BETWEEN 100000 AND 200000 AND engagement_score <= 60"))
def range_filter(t):
    ranged = filters.range_filter(t.employee, "salary", 100_000, 200_000)
    return filters.range_filter(ranged, "engagement_score", None, 60).select(*COLUMNS)


@query("f05_name_search", emp(IDS + "contains(lower(employee_name), 'p 12')"))
def name_search(t):
    return filters.name_search(t.employee, "employee_name", "P 12").select(*COLUMNS)


@query("f05_name_search_by_index", emp("SELECT employee_id, employee_name FROM employee WHERE contains(lower(employee_name), 'p 12')"))
def name_search_by_index(t):
    """The rows of the scan, from trigram postings."""
    path = scratch_path(t.spark, "names")
    search.build_name_index(t.employee, "employee_id", "employee_name", path)
    return search.indexed_name_search(t.spark, path, "employee_id", "employee_name", "P 12")


@query("f06_attrition_view_voluntary", emp(IDS + f"{LEFT} AND exit_reason IS NOT NULL AND exit_reason NOT IN ('N/A', '')"))
def voluntary_view(t):
    return filters.attrition_view(t.employee, "voluntary").select(*COLUMNS)


@query("f06_attrition_view_regrettable", emp(IDS + f"{LEFT} AND {HIGH}"))
def regrettable_view(t):
    return filters.attrition_view(t.employee, "regrettable").select(*COLUMNS)


@query("f07_having_min_team", emp("""SELECT manager_id, count(*) AS team_size FROM employee WHERE manager_id IS NOT NULL
GROUP BY 1 HAVING count(*) >= 8"""))
def min_team(t):
    teams = t.employee.where(F.col("manager_id").isNotNull()).groupBy("manager_id").agg(F.count(F.lit(1)).alias("team_size"))
    return having_min_team(teams, 8)


@query("f08_not_null_keys", emp(IDS + "manager_id IS NOT NULL AND exit_reason IS NOT NULL"))
def not_null_keys(t):
    return filters.not_null_keys(t.employee, ["manager_id", "exit_reason"]).select(*COLUMNS)


# Leavers end 400 days after hire; the snapshot month is June 1999.
ELIGIBLE = """SELECT employee_id, status AS employment_status_code, strftime(ended, '%Y-%m-%d') AS termination_date FROM (
SELECT employee_id, CASE WHEN attrition = 'Yes' THEN 'Terminated' ELSE 'Active' END AS status,
 CASE WHEN attrition = 'Yes' THEN hire_date + 400 END AS ended FROM employee)
WHERE status <> 'Terminated' OR ended >= DATE '1999-06-01'"""


@query("f09_snapshot_eligibility", emp(ELIGIBLE))
def snapshot_eligibility(t):
    left = F.col("attrition") == "Yes"
    df = t.employee.select(
        "employee_id", F.when(left, "Terminated").otherwise("Active").alias("employment_status_code"),
        F.when(left, F.date_add("hire_date", 400)).alias("termination_date"),
    )
    kept = filters.snapshot_eligibility(df, F.lit("1999-06-30").cast("date"))
    return kept.withColumn("termination_date", F.date_format("termination_date", "yyyy-MM-dd"))


@query("f10_exact_lag_filter", "SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-24'")
def exact_lag(t):
    days = t.events.withColumn("day", F.col("ts").cast("date"))
    return filters.exact_lag_filter(days, "day", "2024-01-31", 7).select("event_id", "user_id")


@query("f11_prefix_scope", emp("""SELECT employee_id, path FROM (
SELECT employee_id, concat_ws('/', region, location, department) AS path FROM employee)
WHERE path LIKE 'ASIA/%' OR path LIKE 'EUROPE/NATION_1%'"""))
def prefix_scope(t):
    from rosterlens.functions import masking
    from rosterlens.operators.security import scope_by_path

    df = t.employee.select("employee_id", F.concat_ws("/", "region", "location", "department").alias("path"))
    assignments = t.spark.createDataFrame(
        [("u1", "ASIA/"), ("u1", "EUROPE/NATION_1"), ("u2", "AFRICA")], "hrbp_employee_id string, business_unit_path string"
    )
    return scope_by_path(df, assignments, "u1", masking.HRBP)


@query("f12_employee_search", emp(f"""SELECT employee_id, employee_name, department, job_level, manager_id, location, salary,
 CAST(engagement_score AS DOUBLE) AS engagement_score, performance_rating, attrition, work_mode FROM employee
WHERE contains(lower(employee_name), 'emp 1') AND job_level IN ('L3', 'L4') AND attrition IN ('No')
 AND engagement_score BETWEEN 40 AND 90 AND salary BETWEEN 100000 AND 400000 AND years_at_company BETWEEN 0 AND 5
ORDER BY employee_id LIMIT 200"""))
def employee_search(t):
    found = filters.employee_search(
        t.employee, "EMP 1", {"job_level": ["L3", "L4"], "attrition": ["No"]},
        {"engagement_score": (40, 90), "salary": (100_000, 400_000), "years_at_company": (0, 5)},
    )
    return found.withColumn("engagement_score", F.col("engagement_score").cast("double"))


@query("f12_employee_search_by_index", emp("""SELECT employee_id, employee_name, department, salary FROM employee
WHERE contains(lower(employee_name), 'mp 77') AND salary BETWEEN 100000 AND 400000"""))
def employee_search_by_index(t):
    """Names by the index first; the other conditions on the employees found."""
    path = scratch_path(t.spark, "names")
    search.build_name_index(t.employee, "employee_id", "employee_name", path)
    found = search.indexed_name_search(t.spark, path, "employee_id", "employee_name", "MP 77").select("employee_id")
    rows = filters.range_filter(t.employee.join(found, "employee_id", "left_semi"), "salary", 100_000, 400_000)
    return rows.select("employee_id", "employee_name", "department", "salary")
