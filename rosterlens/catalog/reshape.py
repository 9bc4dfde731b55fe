"""Ordering, top-k, set operations and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.columns import RULE, TIER
from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import LEFT, STAYED, avg, cnt, emp, pct
from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct as pct_col, round_half_up
from rosterlens.operators import reshape, talent


@query("o01_order_by_measure", emp(f"""
SELECT department, {pct(cnt(LEFT))} AS attrition_pct, count(*) AS headcount FROM employee GROUP BY 1 ORDER BY 2 DESC, 1"""))
def order_by_measure(t):
    g = t.employee.groupBy("department").agg(
        pct_col(count_if(scores.is_attrited()), n_rows()).alias("attrition_pct"), n_rows().alias("headcount")
    )
    return reshape.order_by_measure(g, ("attrition_pct", "desc"), ("department", "asc"))


@query("o02_order_by_domain", emp("""
SELECT engagement_tier, n, CASE engagement_tier WHEN 'High Risk' THEN 1 WHEN 'Medium Risk' THEN 2 WHEN 'Low Risk' THEN 3 ELSE 4 END AS sort_index
FROM (SELECT CASE WHEN engagement_score < 40 THEN 'High Risk' WHEN engagement_score < 60 THEN 'Medium Risk'
 WHEN engagement_score < 75 THEN 'Low Risk' ELSE 'Engaged' END AS engagement_tier, count(*) AS n FROM employee GROUP BY 1)"""))
def order_by_domain(t):
    g = t.employee.groupBy(bands.engagement_tier("engagement_score").alias("engagement_tier")).agg(n_rows().alias("n"))
    return reshape.order_by_domain(g, "engagement_tier", bands.ENGAGEMENT_TIERS)


@query("o03_top_k", emp("SELECT employee_id, salary FROM employee ORDER BY salary DESC, employee_id LIMIT 50"))
def top_k(t):
    return reshape.top_k(t.employee.select("employee_id", "salary"), [F.desc("salary"), F.col("employee_id")], 50)


@query("o04_top_risk_list", emp(f"""
SELECT employee_id, employee_name, department, manager_id, risk_score, risk_tier FROM (
 SELECT *, {TIER} AS risk_tier FROM (SELECT *, {RULE} AS risk_score FROM employee WHERE {STAYED}))
WHERE risk_tier IN ('Critical', 'High') ORDER BY risk_score DESC, employee_id LIMIT 50"""))
def top_risk_list(t):
    scored = t.employee.where(scores.is_active()).withColumn("risk_score", scores.rule_risk_score())
    scored = scored.withColumn("risk_tier", scores.rule_risk_tier("risk_score"))
    return talent.top_risk_list(scored).select("employee_id", "employee_name", "department", "manager_id", "risk_score", "risk_tier")


@query("u01_union_all", """
SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, NULL AS quantity FROM orders
UNION ALL SELECT 'line', l_orderkey, l_extendedprice, l_quantity FROM lineitem""")
def union_all(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = t.lineitem.select(
        F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
    )
    return reshape.union_all([a, b])


@query("u02_distinct", emp("SELECT DISTINCT department, job_level FROM employee"))
def distinct(t):
    return reshape.distinct_values(t.employee, ["department", "job_level"])


@query("u03_set_difference", "SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(t):
    used = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return reshape.set_difference(t.customer, used, ["c_custkey"])


@query("u04_disjoint", emp("""
SELECT count(*) AS shared, count(*) = 0 AS is_disjoint FROM (
 SELECT employee_id FROM employee WHERE department = 'BUILDING' INTERSECT SELECT employee_id FROM employee WHERE department = 'MACHINERY')"""))
def disjoint(t):
    a = t.employee.where("department = 'BUILDING'")
    b = t.employee.where("department = 'MACHINERY'")
    return reshape.disjoint(a, b, "employee_id")


@query("u05_unpivot", emp(f"""
SELECT department, 'avg_salary' AS metric, {avg('salary')} AS value FROM employee GROUP BY 1
UNION ALL SELECT department, 'avg_bonus', {avg('bonus')} FROM employee GROUP BY 1"""))
def unpivot(t):
    wide = t.employee.groupBy("department").agg(
        round_half_up(mean("salary")).alias("avg_salary"), round_half_up(mean("bonus")).alias("avg_bonus")
    )
    return reshape.unpivot(wide, ["department"], ["avg_salary", "avg_bonus"], "metric", "value")


LEVELS = ("L2", "L3", "L4", "L5", "L6")


@query("u06_pivot", emp("SELECT gender, " + ", ".join(
    f"round(CAST(sum(salary) FILTER (WHERE job_level = '{x}') AS DOUBLE) / nullif(count(*) FILTER (WHERE job_level = '{x}'), 0), 2) AS {x}" for x in LEVELS
) + " FROM employee GROUP BY 1"))
def pivot(t):
    return reshape.pivot(t.employee, ["gender"], "job_level", round_half_up(mean("salary")), LEVELS)


@query("u07_sample", emp("""
SELECT employee_id, performance_rating, salary FROM employee ORDER BY md5('42:' || CAST(employee_id AS VARCHAR)), employee_id LIMIT 2000"""))
def sample(t):
    return reshape.sample_rows(t.employee.select("employee_id", "performance_rating", "salary"), 2000, "employee_id")
