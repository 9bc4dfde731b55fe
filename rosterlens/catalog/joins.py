"""Join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import LEVELS, RATINGS, SOURCES, avg, emp
from rosterlens.functions.numeric import mean, round_half_up
from rosterlens.operators import joins
from rosterlens.plans import calendar

STAR = """SELECT employee_id, department, job_level, level_name, career_track, recruitment_source, source_type,
 performance_label, is_high_performer FROM employee JOIN levels USING (job_level)
 JOIN sources USING (recruitment_source_id) JOIN ratings USING (performance_rating)"""


@query("j01_star_join", emp(STAR, LEVELS, SOURCES, RATINGS))
def star_join(t):
    dims = {"job_level": t.job_levels, "recruitment_source_id": t.recruitment_sources, "performance_rating": t.ratings}
    return joins.star_join(t.employee, dims).select(
        "employee_id", "department", "job_level", "level_name", "career_track", "recruitment_source", "source_type",
        "performance_label", "is_high_performer",
    )


@query("j02_gold_star_join", emp("""
SELECT e.employee_id, e.department, d.department_key, l.level_name, m.employee_name AS manager_name
FROM employee e
JOIN (SELECT c_mktsegment AS department, CAST(min(c_custkey) AS BIGINT) AS department_key FROM customer GROUP BY 1) d USING (department)
JOIN levels l USING (job_level) LEFT JOIN employee m ON e.manager_id = m.employee_id""", LEVELS))
def gold_star_join(t):
    departments = t.customer.groupBy(F.col("c_mktsegment").alias("department")).agg(F.min("c_custkey").alias("department_key"))
    levels = t.job_levels.withColumn("is_current_flag", F.lit(True))
    managers = t.employee.select(
        F.col("employee_id").alias("manager_id"), F.col("employee_name").alias("manager_name")
    )
    joined = joins.gold_star_join(t.employee, {"department": departments, "job_level": levels}, managers)
    return joined.select("employee_id", "department", "department_key", "level_name", "manager_name")


@query("j03_latest_then_left_join", """
SELECT c_custkey, event_id, value FROM customer LEFT JOIN (
 SELECT user_id AS c_custkey, event_id, value FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) USING (c_custkey)""")
def latest_then_left(t):
    history = t.events.select(F.col("user_id").alias("c_custkey"), "ts", "event_id", "value")
    return joins.latest_then_left_join(t.customer.select("c_custkey"), history, "c_custkey", ["ts", "event_id"]).select(
        "c_custkey", "event_id", "value"
    )


@query("j04_self_join_manager", emp(f"""
SELECT e.manager_id, m.employee_name AS manager_name, count(*) AS team_size, {avg('e.salary')} AS avg_team_salary
FROM employee e JOIN employee m ON e.manager_id = m.employee_id GROUP BY ALL"""))
def self_join_manager(t):
    teams = t.employee.where(F.col("manager_id").isNotNull()).groupBy("manager_id").agg(
        F.count(F.lit(1)).alias("team_size"), round_half_up(mean("salary")).alias("avg_team_salary")
    )
    return joins.self_join_manager(teams, t.employee, {"employee_name": "manager_name"})


@query("j05_left_self_join_manager", emp("""
SELECT e.employee_id, e.manager_id, m.employee_name AS manager_name FROM employee e LEFT JOIN employee m ON e.manager_id = m.employee_id"""))
def left_self_join(t):
    return joins.left_self_join_manager(t.employee.select("employee_id", "manager_id"), t.employee)


@query("j06_anti_join_orphans", """
SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey FROM lineitem UNION ALL SELECT -1 - l_orderkey FROM lineitem WHERE l_linenumber = 2)
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def orphans(t):
    # Lines of orders that do not exist are added to the given ones.
    strays = t.lineitem.where("l_linenumber = 2").select((F.lit(-1) - F.col("l_orderkey")).alias("l_orderkey"))
    return joins.anti_join_orphans(t.lineitem.select("l_orderkey").unionByName(strays), t.orders, "l_orderkey", "o_orderkey")


SPINE = """SELECT employee_id, strftime(month_end, '%Y-%m-%d') AS month_end FROM employee
JOIN (SELECT last_day(CAST(m AS DATE)) AS month_end FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH) r(m)) s
 ON month_end >= last_day(hire_date) AND (attrition = 'No' OR month_end <= last_day(hire_date + 400))"""


@query("j07_month_spine", emp(SPINE))
def month_spine(t):
    end = F.when(F.col("attrition") == "Yes", F.date_add("hire_date", 400)).otherwise(F.lit("2001-12-31").cast("date"))
    rows = joins.month_spine_rows(t.employee, F.col("hire_date"), end, "1995-01-01", "2001-12-31")
    return rows.select("employee_id", F.date_format("month_end", "yyyy-MM-dd").alias("month_end"))


@query("j08_left_using_joins", emp("""
SELECT employee_id, coalesce(level_name, 'Unknown') AS level_name, coalesce(last_event, -1) AS last_event
FROM (SELECT employee_id, job_level FROM employee UNION ALL SELECT -1 - employee_id, 'L0' FROM employee WHERE gender = 'Non-binary') LEFT JOIN levels USING (job_level)
LEFT JOIN (SELECT user_id AS employee_id, max(event_id) AS last_event FROM events GROUP BY 1) USING (employee_id)""", LEVELS))
def left_using(t):
    last = t.events.groupBy(F.col("user_id").alias("employee_id")).agg(F.max("event_id").alias("last_event"))
    levels = t.job_levels.select("job_level", "level_name")
    # Employees of a level that does not exist are added to the given ones.
    strays = t.employee.where("gender = 'Non-binary'").select((F.lit(-1) - F.col("employee_id")).alias("employee_id"), F.lit("L0").alias("job_level"))
    joined = joins.left_using_joins(
        t.employee.select("employee_id", "job_level").unionByName(strays), {"job_level": levels, "employee_id": last},
        {"level_name": "Unknown", "last_event": -1},
    )
    return joined.select("employee_id", "level_name", "last_event")


@query("j10_semi_join_scope", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join_scope(t):
    scope = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi_join_scope(t.orders, scope, "o_custkey").select("o_orderkey")


# Scores: one per event user, newest value as probability.
SCORES = """scores AS (SELECT user_id AS employee_id, max(value) AS model_value FROM events GROUP BY 1)"""


def user_scores(t):
    return t.events.groupBy(F.col("user_id").alias("employee_id")).agg(F.max("value").alias("model_value"))


@query("j11_prediction_left_join", emp("SELECT employee_id, attrition, model_value FROM employee LEFT JOIN scores USING (employee_id)", SCORES))
def prediction_left(t):
    return joins.prediction_left_join(t.employee.select("employee_id", "attrition"), user_scores(t))


@query("j12_score_outcome_join", emp("SELECT employee_id, attrition, model_value FROM employee JOIN scores USING (employee_id)", SCORES))
def score_outcome(t):
    return joins.score_outcome_join(user_scores(t), t.employee)


@query("j13_group_total_join", emp("""
SELECT department, gender, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY department), 2) AS pct
FROM employee GROUP BY 1, 2"""))
def group_total(t):
    counts = t.employee.groupBy("department", "gender").agg(F.count(F.lit(1)).alias("n"))
    return joins.group_total_join(counts, ["department"])


@query("j14_snapshot_compare", """
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_totalprice AS old_price, b.o_totalprice AS new_price
FROM (SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P') a
FULL JOIN (SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT 1000000000 + o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P') b ON a.o_orderkey = b.o_orderkey""")
def snapshot_compare(t):
    # Each image has orders that the other one lacks, added to the given ones.
    slim, key = t.orders.select("o_orderkey", "o_totalprice"), F.col("o_orderkey")
    more = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    old, new = (slim.unionByName(more.withColumn("o_orderkey", moved)) for moved in (-1 - key, key + 1_000_000_000))
    both = joins.snapshot_compare(old, new, "o_orderkey")
    return both.select("o_orderkey", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


@query("j15_map_lookup", emp("""
SELECT employee_id, CASE performance_rating WHEN 1 THEN 'Unacceptable' WHEN 3 THEN 'Meets' WHEN 5 THEN 'Distinguished' END AS label FROM employee"""))
def map_lookup(t):
    label = joins.map_lookup("performance_rating", {1: "Unacceptable", 3: "Meets", 5: "Distinguished"})
    return t.employee.select("employee_id", label.alias("label"))


@query("j16_role_playing_date_join", f"""
SELECT 'order' AS role, year(d) AS year_num, 'Q' || quarter(d) AS quarter_label, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY ALL
UNION ALL
SELECT 'ship' AS role, year(d) AS year_num, 'Q' || quarter(d) AS quarter_label, count(*) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY ALL""")
def role_playing_dates(t):
    dates = calendar.date_dimension(t.spark, "1990-01-01", "2010-12-31")
    columns = ["year_num", "quarter_label"]
    counts = []
    for role, fact, day_col in (("order", t.orders, "o_orderdate"), ("ship", t.lineitem, "l_shipdate")):
        joined = joins.role_playing_date_join(fact.select(F.col(day_col).cast("date").alias(day_col)), dates, day_col, columns)
        counts.append(
            joined.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit(role))
            .withColumn("year_num", F.col("year_num").cast("bigint"))
        )
    return counts[0].unionByName(counts[1])
