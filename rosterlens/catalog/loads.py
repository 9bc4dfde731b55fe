"""Load, change-tracking, fact and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.columns import codes_sql
from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import (
    COMPA, FEMALE, HIGH, LEFT, LEVELS, MALE, RATINGS, SOURCES, STAYED, avg, case_bands, cnt, emp, pct, ratio, with_,
)
from rosterlens.functions import bands, cleaning
from rosterlens.functions.dates import date_key
from rosterlens.functions.numeric import n_rows, round_half_up
from rosterlens.operators.ranking import compa_ratio_level_median
from rosterlens.plans import calendar, changes, facts, medallion, rollups, storing, summaries
from rosterlens.session import scratch_path, written_table

AS_OF = "2001-12-31"

# --- raw workers -----------------------------------------------------------------------

# One extract per order of a customer: several versions of the same worker, in source spelling.
RAW_WORKERS = {
    "worker_id": "CAST(o_custkey AS {str})",
    "first_name": "CASE WHEN o_orderkey % 13 = 0 THEN '   ' ELSE concat(' First', CAST(o_custkey AS {str}), ' ') END",
    "last_name": "concat('Last', CAST(o_custkey % 100 AS {str}))",
    "email_primary": "CASE WHEN o_orderkey % 5 <> 0 THEN concat('w', CAST(o_custkey AS {str}), '@example.org ') END",
    "hire_date": "CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE {day} END",
    "termination_date": "CASE WHEN o_orderstatus = 'F' THEN {day} ELSE '' END",
    "worker_status": "CASE o_orderstatus WHEN 'F' THEN ' terminated' WHEN 'O' THEN 'Active ' ELSE 'leave' END",
    "employee_type": "CASE o_orderkey % 4 WHEN 0 THEN 'ft' WHEN 1 THEN 'Part-Time' WHEN 2 THEN 'intern' ELSE 'unknown' END",
    "fte_percentage": "CASE o_orderkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '0.5' WHEN 2 THEN 'x' END",
    "birth_date": "concat(CAST(1940 + o_custkey % 60 AS {str}), '-06-15')",
    "gender": "CASE o_custkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN ' FEMALE' WHEN 2 THEN 'nb' ELSE '' END",
    "ethnicity": "CASE WHEN o_custkey % 3 <> 0 THEN concat(' group ', CAST(o_custkey % 3 AS {str})) ELSE ' ' END",
    "nationality_iso": "'US'",
}
RAW_SQL = "raw AS (SELECT " + ", ".join(
    f"{e.format(str='VARCHAR', day=chr(123) + '}').replace(chr(123) + '}', 'strftime(o_orderdate, ' + repr('%Y-%m-%d') + ')')} AS {n}"
    for n, e in RAW_WORKERS.items()
) + ", o_orderdate + to_microseconds(o_orderkey) AS extracted_at FROM orders)"


def raw_workers(t):
    columns = [f"{e.format(str='STRING', day='date_format(o_orderdate, ' + repr('yyyy-MM-dd') + ')')} AS {n}" for n, e in RAW_WORKERS.items()]
    stamp = "o_orderdate + make_dt_interval(0, 0, 0, CAST(o_orderkey / 1000000.0D AS DECIMAL(18, 6))) AS extracted_at"
    return t.orders.selectExpr(*columns, stamp)


BRONZE_SQL = """bronze AS (SELECT worker_id AS employee_id, nullif(trim(first_name), '') AS first_name, nullif(trim(last_name), '') AS last_name,
 nullif(trim(email_primary), '') AS email_work, CAST(try_strptime(hire_date, '%Y-%m-%d') AS DATE) AS hire_date,
 CAST(try_strptime(termination_date, '%Y-%m-%d') AS DATE) AS termination_date, upper(trim(worker_status)) AS employment_status_raw,
 upper(trim(employee_type)) AS employee_type_raw, TRY_CAST(fte_percentage AS DECIMAL(5,2)) AS fte_value,
 CAST(try_strptime(birth_date, '%Y-%m-%d') AS DATE) AS birth_date, nullif(trim(gender), '') AS gender_raw,
 nullif(trim(ethnicity), '') AS ethnicity_raw, nationality_iso AS nationality_code, 'WORKDAY' AS source_system_code, extracted_at AS ingestion_timestamp FROM raw)"""
TEXT_DATES = "strftime({0}, '%Y-%m-%d') AS {0}".format
STAMP = "strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp"


def text_dates(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def text_stamp(df):
    return df.withColumn("ingestion_timestamp", F.date_format("ingestion_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("l01_bronze_employees", with_(RAW_SQL, BRONZE_SQL, then=f"""
SELECT * REPLACE ({TEXT_DATES('hire_date')}, {TEXT_DATES('termination_date')}, {TEXT_DATES('birth_date')}, {STAMP}, CAST(fte_value AS DOUBLE) AS fte_value) FROM bronze"""))
def bronze(t):
    df = medallion.bronze_employees(raw_workers(t)).drop("bronze_loaded_at").withColumn("fte_value", F.col("fte_value").cast("double"))
    return text_stamp(text_dates(df, "hire_date", "termination_date", "birth_date"))


@query("l02_incremental_filter", """
SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-03-01')""")
def incremental(t):
    target = t.orders.where("o_orderstatus = 'F' AND o_orderdate < DATE'1999-03-01'")
    return medallion.incremental_filter(t.orders, target, "o_orderdate").select("o_orderkey")


AGE = "(2001 - year(birth_date))"


def silver_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT employee_id, first_name, last_name, first_name || ' ' || last_name AS full_name, email_work, hire_date, termination_date,
 birth_date, {case_bands(AGE, bands.AGE_EDGES, bands.AGE_LABELS_SHORT)} AS age_band_code,
 {codes_sql('employment_status_raw', cleaning.STATUS_CODES, 'Unknown')} AS employment_status_code,
 {codes_sql('employee_type_raw', cleaning.EMPLOYEE_TYPE_CODES, 'Full-Time')} AS employee_type_code,
 {codes_sql('gender_raw', cleaning.GENDER_CODES, 'Prefer-not-to-say')} AS gender_code, ethnicity_raw AS ethnicity_code, nationality_code,
 CAST(coalesce(fte_value, 1.0) AS DOUBLE) AS fte_value, source_system_code, ingestion_timestamp FROM {source}
 WHERE employee_id IS NOT NULL AND first_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY ingestion_timestamp DESC) = 1)"""


def silver(t, where=None):
    raw = raw_workers(t)
    raw = raw if where is None else raw.where(where)
    df = medallion.silver_employees(medallion.bronze_employees(raw), F.lit(AS_OF).cast("date"))
    return df.withColumn("fte_value", F.col("fte_value").cast("double"))


@query("l06_silver_employees", with_(RAW_SQL, BRONZE_SQL, silver_sql("bronze", "silver"), then=f"""
SELECT * REPLACE ({TEXT_DATES('hire_date')}, {TEXT_DATES('termination_date')}, {TEXT_DATES('birth_date')}, {STAMP}) FROM silver"""))
def silver_query(t):
    return text_stamp(text_dates(silver(t), "hire_date", "termination_date", "birth_date"))


# --- upsert and change log -------------------------------------------------------------

# The batch: every tenth employee with new pay (every thirtieth also a new rating), plus one unseen
# employee per hundred.
BATCH = """batch AS (SELECT * REPLACE (CASE WHEN employee_id % 20 = 0 THEN salary + 1000 ELSE salary END AS salary, bonus + 1 AS bonus,
 CASE WHEN employee_id % 30 = 0 THEN 5 ELSE performance_rating END AS performance_rating,
 CASE WHEN employee_id % 40 = 0 THEN NULL ELSE attrition END AS attrition) FROM employee WHERE employee_id % 10 = 0
 UNION ALL SELECT * REPLACE (employee_id + 1000000000 AS employee_id) FROM employee WHERE employee_id % 100 = 1)"""


def batch(t):
    e = t.employee
    key = F.col("employee_id")
    changed = e.where(key % 10 == 0).withColumns({
        "salary": F.when(key % 20 == 0, F.col("salary") + 1000).otherwise(F.col("salary")),
        "bonus": F.col("bonus") + 1,
        "performance_rating": F.when(key % 30 == 0, 5).otherwise(F.col("performance_rating")),
        "attrition": F.when(key % 40 != 0, F.col("attrition")),
    })
    fresh = e.where(key % 100 == 1).withColumn("employee_id", key + 1_000_000_000)
    return changed.unionByName(fresh)


COMPARED = " OR ".join(f"t.{c} IS DISTINCT FROM s.{c}" for c in changes.COMPARE_COLUMNS)
UPSERT = f"""applied AS (SELECT coalesce(t.employee_id, s.employee_id) AS employee_id,
 CASE WHEN t.employee_id IS NULL THEN 'insert' WHEN s.employee_id IS NOT NULL AND ({COMPARED}) THEN 'update' ELSE 'unchanged' END AS action,
 t AS t, s AS s FROM employee t FULL JOIN batch s ON t.employee_id = s.employee_id)"""
FRESH = "CASE WHEN action <> 'unchanged' THEN s.{0} ELSE t.{0} END AS {0}".format
ONLY_NEW = "CASE WHEN action = 'insert' THEN s.{0} ELSE t.{0} END AS {0}".format


@query("l03_upsert_employees", emp(f"""
SELECT employee_id, action, {FRESH('salary')}, {FRESH('bonus')}, {FRESH('performance_rating')}, {FRESH('attrition')}, {ONLY_NEW('age')}, {ONLY_NEW('manager_id')}
FROM applied""", BATCH, UPSERT))
def upsert(t):
    return changes.upsert(t.employee, batch(t), "employee_id").select(
        "employee_id", "action", "salary", "bonus", "performance_rating", "attrition", "age", "manager_id"
    )


@query("l03_upsert_counts", emp(f"""
SELECT {cnt("action = 'insert'")} AS rows_inserted, {cnt("action = 'update'")} AS rows_updated, {cnt("action = 'unchanged'")} AS rows_unchanged FROM applied""", BATCH, UPSERT))
def upsert_counts(t):
    return changes.upsert_counts(changes.upsert(t.employee, batch(t), "employee_id"))


@query("l03_upsert_by_key", emp(f"""
SELECT employee_id, {FRESH('salary')}, {FRESH('bonus')}, {FRESH('performance_rating')}, {FRESH('attrition')}, {ONLY_NEW('age')}, {ONLY_NEW('manager_id')} FROM applied""", BATCH, UPSERT))
def upsert_by_key(t):
    """The table as it stands after a load that rewrote only the partitions with changed keys."""
    path = scratch_path(t.spark, "employees")
    storing.write_by_key(t.employee, path, "employee_id", 32)
    changes.upsert_by_key(t.spark, path, batch(t), "employee_id", 32)
    return t.spark.read.parquet(path).select("employee_id", "salary", "bonus", "performance_rating", "attrition", "age", "manager_id")


LOG = " UNION ALL ".join(
    f"""SELECT o.employee_id, '{c}' AS changed_column, CAST(o.{c} AS VARCHAR) AS old_value, CAST(n.{c} AS VARCHAR) AS new_value
 FROM employee o JOIN batch n USING (employee_id) WHERE o.{c} IS DISTINCT FROM n.{c}""" for c in changes.AUDIT_COLUMNS
)


@query("l04_change_log", emp(LOG, BATCH))
def change_log(t):
    return changes.change_log(t.employee, batch(t), "employee_id")


# --- versions --------------------------------------------------------------------------

DIM_COLUMNS = ("employee_id", "full_name", "email_work", "age_band_code", "gender_code", "employment_status_code", "employee_type_code", "fte_value")
DIM_LIST = ", ".join(DIM_COLUMNS)
CHECKED = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in changes.VERSIONED_COLUMNS)
EARLY = "early AS (SELECT * FROM bronze WHERE ingestion_timestamp < TIMESTAMP '1999-01-01')"
# Workers that the second snapshot lacks are added to the first one.
GONE = "first AS (SELECT * FROM base UNION ALL SELECT * REPLACE ('X' || employee_id AS employee_id) FROM base WHERE CAST(employee_id AS BIGINT) % 17 = 3)"
SNAPSHOTS = (RAW_SQL, BRONZE_SQL, EARLY, silver_sql("early", "base"), GONE, silver_sql("bronze", "second"))
A_COLUMNS = ", ".join(f"a.{c}" for c in DIM_COLUMNS)
B_COLUMNS = ", ".join(f"b.{c}" for c in DIM_COLUMNS)
SCD2 = f"""SELECT {A_COLUMNS}, 1 AS scd_version, '1999-01-01' AS effective_start_date,
 CASE WHEN b.employee_id IS NULL OR {CHECKED} THEN '2000-01-01' END AS effective_end_date, NOT (b.employee_id IS NULL OR {CHECKED}) AS is_current_flag
FROM first a LEFT JOIN second b USING (employee_id)
UNION ALL
SELECT {B_COLUMNS}, CASE WHEN a.employee_id IS NULL THEN 1 ELSE 2 END, '2000-01-01', NULL, true
FROM second b LEFT JOIN first a USING (employee_id) WHERE a.employee_id IS NULL OR {CHECKED}"""


def snapshots(t):
    """The image of January 1999, with workers that are gone a year later, and that of all extracts."""
    first = silver(t, "extracted_at < TIMESTAMP_NTZ'1999-01-01 00:00:00'").select(*DIM_COLUMNS)
    gone = first.where("CAST(employee_id AS BIGINT) % 17 = 3").withColumn("employee_id", F.concat(F.lit("X"), "employee_id"))
    return first.unionByName(gone), silver(t).select(*DIM_COLUMNS)


def scd2_dimension(t):
    first, second = snapshots(t)
    return changes.scd2_snapshot(changes.scd2_initial(first, "1999-01-01"), second, "employee_id", as_of="2000-01-01")


@query("l05_scd2_snapshot", with_(*SNAPSHOTS, then=SCD2))
def scd2(t):
    return text_dates(scd2_dimension(t), "effective_start_date", "effective_end_date")


@query("l05_scd2_applied_twice", with_(*SNAPSHOTS, then=SCD2))
def scd2_twice(t):
    _, second = snapshots(t)
    again = changes.scd2_snapshot(scd2_dimension(t), second, "employee_id", as_of="2000-06-01")
    return text_dates(again, "effective_start_date", "effective_end_date")


@query("l05_scd2_load", with_(*SNAPSHOTS, then=SCD2))
def scd2_load(t):
    """Two loads into a folder, the second of which rewrites the partitions with changed keys; repeating it changes nothing."""
    root = scratch_path(t.spark, "dimension")
    first, second = snapshots(t)
    changes.scd2_create(first, root, "employee_id", "1999-01-01", 16)
    for _ in range(2):
        changes.scd2_load(t.spark, root, second, "employee_id", changes.VERSIONED_COLUMNS, "2000-01-01", 16)
    return text_dates(changes.scd2_read(t.spark, root), "effective_start_date", "effective_end_date")


MIDDLE = "middle AS (SELECT * FROM bronze WHERE ingestion_timestamp < TIMESTAMP '1999-07-01')"
D_COLUMNS, L_COLUMNS = (", ".join(f"{x}.{c}" for c in DIM_COLUMNS) for x in ("d", "l"))
DIFFERS = " OR ".join(f"d.{c} IS DISTINCT FROM l.{c}" for c in changes.VERSIONED_COLUMNS)


@query("l05_late_snapshot", with_(*SNAPSHOTS, MIDDLE, silver_sql("middle", "mid"),
    f"dim AS (SELECT * REPLACE (CAST(effective_start_date AS DATE) AS effective_start_date, CAST(effective_end_date AS DATE) AS effective_end_date) FROM ({SCD2}))",
    f"""joined AS (SELECT d.*, l.employee_id IS NOT NULL AND ({DIFFERS}) AS split FROM dim d LEFT JOIN mid l ON d.employee_id = l.employee_id
 AND d.effective_start_date <= DATE '1999-07-01' AND (d.effective_end_date IS NULL OR d.effective_end_date > DATE '1999-07-01'))""",
    f"""pieces AS (SELECT {DIM_LIST}, effective_start_date AS s, CASE WHEN split THEN DATE '1999-07-01' ELSE effective_end_date END AS e, is_current_flag AND NOT split AS c FROM joined
 UNION ALL SELECT {L_COLUMNS}, DATE '1999-07-01', least(coalesce(d.effective_end_date, DATE '2000-01-01'), DATE '2000-01-01'), false FROM joined d JOIN mid l USING (employee_id) WHERE split
 UNION ALL SELECT {DIM_LIST}, DATE '2000-01-01', effective_end_date, is_current_flag FROM joined WHERE split AND (effective_end_date IS NULL OR effective_end_date > DATE '2000-01-01')
 UNION ALL SELECT {L_COLUMNS}, DATE '1999-07-01', least(coalesce((SELECT min(effective_start_date) FROM dim x WHERE x.employee_id = l.employee_id AND x.effective_start_date > DATE '1999-07-01'), DATE '2000-01-01'), DATE '2000-01-01'), false
 FROM mid l WHERE NOT EXISTS (SELECT 1 FROM dim d WHERE d.employee_id = l.employee_id AND d.effective_start_date <= DATE '1999-07-01' AND (d.effective_end_date IS NULL OR d.effective_end_date > DATE '1999-07-01')))""", then=f"""
SELECT {DIM_LIST}, CAST(row_number() OVER (PARTITION BY employee_id ORDER BY s) AS INT) AS scd_version, strftime(s, '%Y-%m-%d') AS effective_start_date,
 strftime(e, '%Y-%m-%d') AS effective_end_date, c AS is_current_flag FROM pieces"""))
def late_snapshot(t):
    """The snapshot of July 1999, which arrives after that of January 2000."""
    late = silver(t, "extracted_at < TIMESTAMP_NTZ'1999-07-01 00:00:00'").select(*DIM_COLUMNS)
    out = changes.scd2_late_snapshot(scd2_dimension(t), late, "employee_id", changes.VERSIONED_COLUMNS, "1999-07-01", "2000-01-01")
    return text_dates(out, "effective_start_date", "effective_end_date")


@query("l05_scd2_from_history", """
SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS effective_start,
 strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS effective_end,
 lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_current_flag
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type""")
def scd2_history(t):
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    history = t.events.select("user_id", "event_id", "event_type", "ts")
    out = changes.scd2_from_history(history, "user_id", ["ts", "event_id"], ["event_type"], F.to_date("ts"))
    return out.withColumns({c: F.date_format(c, fmt) for c in ("effective_start", "effective_end")})


# --- calendar --------------------------------------------------------------------------

CALENDAR = """
SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, strftime(d, '%Y-%m-%d') AS full_date, CAST(isodow(d) AS INT) AS day_of_week_num,
 dayname(d) AS day_of_week_name, substr(dayname(d), 1, 3) AS day_of_week_short, CAST(day(d) AS INT) AS day_of_month, CAST(dayofyear(d) AS INT) AS day_of_year,
 CAST(week(d) AS INT) AS week_of_year, isoyear(d) || '-W' || lpad(CAST(week(d) AS VARCHAR), 2, '0') AS iso_year_week, CAST(month(d) AS INT) AS month_num,
 monthname(d) AS month_name, substr(monthname(d), 1, 3) AS month_short, substr(monthname(d), 1, 3) || '-' || year(d) AS month_year,
 CAST(quarter(d) AS INT) AS quarter_num, 'Q' || quarter(d) AS quarter_label, CAST(year(d) AS INT) AS year_num, year(d) || '-Q' || quarter(d) AS year_quarter,
 isodow(d) <= 5 AS is_weekday_flag, isodow(d) > 5 AS is_weekend_flag, false AS is_company_holiday_flag,
 (month(d) = 1 AND day(d) = 1) OR (month(d) = 6 AND day(d) = 19) OR (month(d) = 7 AND day(d) = 4) OR (month(d) = 11 AND day(d) = 11) OR (month(d) = 12 AND day(d) = 25)
  OR (isodow(d) = 1 AND ((month(d) IN (1, 2) AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND day(d) > 24) OR (month(d) = 9 AND day(d) <= 7) OR (month(d) = 10 AND day(d) BETWEEN 8 AND 14)))
  OR (isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28) AS is_us_federal_holiday_flag,
 d = last_day(d) AS is_month_end_flag, d = last_day(d) AND month(d) % 3 = 0 AS is_quarter_end_flag, d = last_day(d) AND month(d) = 12 AS is_year_end_flag,
 CAST(year(s) + 1 AS INT) AS fiscal_year, CAST(quarter(s) AS INT) AS fiscal_quarter_num,
 'FY' || lpad(CAST((year(s) + 1) % 100 AS VARCHAR), 2, '0') || '-Q' || quarter(s) AS fiscal_quarter_label, CAST(month(s) AS INT) AS fiscal_month_num,
 'FY' || lpad(CAST((year(s) + 1) % 100 AS VARCHAR), 2, '0') || '-P' || lpad(CAST(month(s) AS VARCHAR), 2, '0') AS fiscal_period_label,
 CAST(day(last_day(d)) AS INT) AS days_in_month, CAST(d - DATE '2001-12-31' AS INT) AS relative_day_offset,
 CAST((year(d) - 2001) * 12 + month(d) - 12 AS INT) AS relative_month_offset, coalesce(n, 0) AS orders
FROM (SELECT CAST(d AS DATE) AS d, CAST(d - INTERVAL 3 MONTH AS DATE) AS s FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) r(d))
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) USING (d)"""


@query("l07_date_dimension_with_orders", CALENDAR)
def date_dimension(t):
    dates = calendar.date_dimension(t.spark, "1995-01-01", AS_OF, as_of=AS_OF)
    daily = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("full_date")).agg(n_rows().alias("orders"))
    joined = dates.join(daily, "full_date", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    return text_dates(joined, "full_date")


# --- monthly fact ----------------------------------------------------------------------

STAFF = """staff AS (SELECT *, CASE WHEN attrition = 'Yes' THEN 'Terminated' ELSE 'Active' END AS employment_status_code,
 CASE WHEN attrition = 'Yes' THEN hire_date + CAST(30 + (employee_id * 7) % 900 AS INT) END AS termination_date,
 CASE WHEN attrition = 'Yes' THEN exit_reason IS NOT NULL END AS voluntary_exit_flag,
 CASE employee_id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1e0 END AS fte_value FROM employee)"""
PAY = """pay AS (SELECT l_orderkey AS employee_id, l_discount AS compa_ratio, l_extendedprice AS base_salary FROM lineitem WHERE l_linestatus = 'O'
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_discount DESC, l_extendedprice DESC) = 1)"""
SURVEY = """survey AS (SELECT user_id AS employee_id, value AS engagement FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
risk AS (SELECT user_id AS employee_id, max(value) AS flight_risk_score FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-24' GROUP BY 1)"""


def _fact_sql(first: str) -> str:
    return f"""fact AS (SELECT s.employee_id, s.department, s.location, s.job_level, s.performance_rating, s.hire_date, s.termination_date, s.employment_status_code,
 s.voluntary_exit_flag, coalesce(s.fte_value, 1e0) AS fte_value, p.compa_ratio, p.base_salary, v.engagement AS engagement_score, r.flight_risk_score,
 coalesce(d.department_key, -1) AS department_key, month_end, CAST(strftime(month_end, '%Y%m%d') AS INT) AS date_key,
 CAST((year(month_end) - year(hire_date)) * 12 + month(month_end) - month(hire_date) AS INT) AS tenure_months,
 s.employment_status_code = 'Active' AS is_active_flag, coalesce(last_day(s.termination_date) = month_end, false) AS is_exit
 FROM staff s JOIN (SELECT last_day(CAST(m AS DATE)) AS month_end FROM range(DATE '{first}', DATE '2002-01-01', INTERVAL 1 MONTH) x(m)) c
  ON c.month_end >= last_day(s.hire_date) AND (s.termination_date IS NULL OR s.termination_date >= date_trunc('month', c.month_end))
 LEFT JOIN pay p USING (employee_id) LEFT JOIN survey v USING (employee_id) LEFT JOIN risk r USING (employee_id)
 LEFT JOIN (SELECT c_mktsegment AS department, CAST(min(c_custkey) AS BIGINT) AS department_key FROM customer GROUP BY 1) d USING (department))"""


FACT = (STAFF, PAY, SURVEY, _fact_sql("1995-01-01"))


def staff(t):
    left = F.col("attrition") == "Yes"
    key = F.col("employee_id")
    return t.employee.withColumns({
        "employment_status_code": F.when(left, "Terminated").otherwise("Active"),
        "termination_date": F.when(left, F.date_add("hire_date", (F.lit(30) + (key * 7) % 900).cast("int"))),
        "voluntary_exit_flag": F.when(left, F.col("exit_reason").isNotNull()),
        "fte_value": F.when(key % 4 == 0, F.lit(0.5)).when(key % 4 == 1, F.lit(1.0)),
    })


FACT_STAFF = ("employee_id", "employee_name", "department", "location", "job_level", "performance_rating", "manager_id", "hire_date",
              "termination_date", "employment_status_code", "voluntary_exit_flag", "fte_value")


def snapshot_fact(t, since=None, each=None):
    pay = t.lineitem.select(
        F.col("l_orderkey").alias("employee_id"), F.col("l_shipdate").alias("effective_date"),
        F.col("l_discount").alias("compa_ratio"), F.col("l_extendedprice").alias("base_salary"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("end_date"),
    )
    survey = t.events.select(F.col("user_id").alias("employee_id"), F.col("ts").alias("survey_date"), F.col("value").alias("score"))
    from rosterlens.operators.filters import exact_lag_filter

    risk = exact_lag_filter(t.events.withColumn("day", F.col("ts").cast("date")), "day", "2024-01-31")
    risk = risk.groupBy(F.col("user_id").alias("employee_id")).agg(F.max("value").alias("risk_score"))
    departments = t.customer.groupBy(F.col("c_mktsegment").alias("department")).agg(
        F.min("c_custkey").alias("department_key")
    )
    return facts.employee_snapshot_fact(
        staff(t).select(*FACT_STAFF), "1995-01-01", AS_OF, {"department": departments}, pay, survey, risk, since, each
    )


FACT_COLUMNS = ("employee_id", "date_key", "department_key", "tenure_months", "tenure_band_code", "employment_status_code", "fte_value",
                "is_active_flag", "is_exit", "compa_ratio", "base_salary", "engagement_score", "flight_risk_score")
FACT_SELECT = f"""SELECT employee_id, date_key, department_key, tenure_months,
 {case_bands('tenure_months', bands.TENURE_MONTH_EDGES, bands.TENURE_MONTH_LABELS)} AS tenure_band_code, employment_status_code, fte_value, is_active_flag,
 is_exit, compa_ratio, base_salary, engagement_score, flight_risk_score FROM fact"""


@query("l08_employee_snapshot_fact", emp(FACT_SELECT, *FACT))
def fact_query(t):
    return snapshot_fact(t).select(*FACT_COLUMNS)


@query("l08_snapshot_fact_incremental", emp(FACT_SELECT, STAFF, PAY, SURVEY, _fact_sql("2001-10-01")))
def fact_incremental(t):
    return snapshot_fact(t, since="2001-09-30").select(*FACT_COLUMNS)


@query("l08_fact_as_of_pay_version", emp("""
SELECT f.employee_id, f.date_key, v.pay FROM fact f LEFT JOIN versions v
 ON f.employee_id = v.employee_id AND f.month_end >= v.s AND (v.e IS NULL OR f.month_end < v.e)""", *FACT, """
versions AS (SELECT employee_id, s, lead(s) OVER (PARTITION BY employee_id ORDER BY s) AS e, pay
 FROM (SELECT l_orderkey AS employee_id, CAST(l_shipdate AS DATE) AS s, max(l_extendedprice) AS pay FROM lineitem GROUP BY 1, 2))"""))
def fact_as_of_version(t):
    """Each month end with the pay version that was valid on it; months before the first version keep a null."""
    from rosterlens.operators.sequence import next_row

    daily = t.lineitem.groupBy(F.col("l_orderkey").alias("employee_id"), F.col("l_shipdate").cast("date").alias("effective_start_date")).agg(
        F.max("l_extendedprice").alias("pay")
    )
    follows = next_row(daily, ["employee_id"], ["effective_start_date"], ["effective_start_date"], F.year("effective_start_date"))
    versions = follows.withColumn("effective_end_date", F.col("next.effective_start_date"))
    # The join shuffles whole facts, so they bring only what the result shows; an employee has at most twelve of them a year.
    fact = snapshot_fact(t).select("employee_id", F.to_date(F.col("date_key").cast("string"), "yyyyMMdd").alias("day"))
    year = lambda day: F.trunc(day, "YYYY")
    return facts.as_of_version_join(fact, versions, "employee_id", "day", ["pay"], year).select("employee_id", date_key("day").alias("date_key"), "pay")


@query("l09_current_employees_view", emp("""
SELECT f.employee_id, f.date_key, f.tenure_months, l.level_name, l.career_track, m.employee_name AS manager_name
FROM fact f JOIN levels l USING (job_level) JOIN employee e ON f.employee_id = e.employee_id LEFT JOIN employee m ON e.manager_id = m.employee_id
WHERE f.is_active_flag""", *FACT, LEVELS))
def current_employees(t):
    managers = t.employee.select(F.col("employee_id").alias("manager_id"), F.col("employee_name").alias("manager_name"))
    levels = F.broadcast(t.job_levels.select("job_level", "level_name", "career_track"))
    # Level and manager do not change with the month, so they are joined to employees, not to their months.
    view = snapshot_fact(t, each=lambda people: facts.current_employees_view(people, {"job_level": levels}, managers))
    return view.select("employee_id", "date_key", "tenure_months", "level_name", "career_track", "manager_name")


@query("l10_attrition_events_view", emp("""
SELECT employee_id, date_key, voluntary_exit_flag, tenure_months AS tenure_at_exit, level_name, year_num, fiscal_quarter_label, engagement_score
FROM (SELECT *, CAST(year(month_end) AS INT) AS year_num, 'FY' || lpad(CAST((year(CAST(month_end - INTERVAL 3 MONTH AS DATE)) + 1) % 100 AS VARCHAR), 2, '0')
 || '-Q' || quarter(CAST(month_end - INTERVAL 3 MONTH AS DATE)) AS fiscal_quarter_label FROM fact) JOIN levels USING (job_level)
WHERE is_exit AND voluntary_exit_flag IS NOT NULL""", *FACT, LEVELS))
def attrition_events(t):
    dates = calendar.date_dimension(t.spark, "1995-01-01", AS_OF).select("date_key", "year_num", "fiscal_quarter_label")
    dims = {"job_level": F.broadcast(t.job_levels.select("job_level", "level_name")), "date_key": dates}
    return facts.attrition_events_view(snapshot_fact(t), dims).select(
        "employee_id", "date_key", "voluntary_exit_flag", "tenure_at_exit", "level_name", "year_num", "fiscal_quarter_label", "engagement_score"
    )


HEADCOUNT = emp(f"""
SELECT date_key, department, location, job_level, count(*) AS total_headcount, {cnt('is_active_flag')} AS active_headcount, round(sum(fte_value), 2) AS fte_total,
 {avg('tenure_months')} AS avg_tenure_months, {avg('CAST(compa_ratio AS DECIMAL(14,4))', digits=4)} AS avg_compa_ratio, {avg('CAST(flight_risk_score AS DECIMAL(14,4))')} AS avg_flight_risk_score,
 {avg('CAST(engagement_score AS DECIMAL(14,4))')} AS avg_engagement_score FROM fact GROUP BY 1, 2, 3, 4""", *FACT)


@query("l11_headcount_monthly", HEADCOUNT)
def headcount_monthly(t):
    return summaries.headcount_monthly(snapshot_fact(t, each=lambda people: summaries.headcount_spans(people, SEGMENT)), SEGMENT)


HEADS = f"(({cnt(chr(104) + 'ire_date < date_trunc(' + repr('month') + ', month_end)')} + {cnt('NOT is_exit')}) / 2e0)"


ATTRITION = emp(f"""
SELECT *, coalesce(round(voluntary_separations / nullif(avg_headcount_in_period, 0), 6), 0) AS voluntary_attrition_rate,
 coalesce(round(regrettable_separations / nullif(avg_headcount_in_period, 0), 6), 0) AS regrettable_attrition_rate FROM (
SELECT date_key, department, location, job_level, {cnt('is_exit')} AS total_separations, {cnt('is_exit AND voluntary_exit_flag')} AS voluntary_separations,
 {cnt('is_exit AND NOT voluntary_exit_flag')} AS involuntary_separations, {cnt(f'is_exit AND {HIGH}')} AS regrettable_separations,
 {cnt('is_exit AND termination_date - hire_date < 90')} AS new_hire_90day_exits, {HEADS} AS avg_headcount_in_period FROM fact GROUP BY 1, 2, 3, 4)""", *FACT)


@query("l12_attrition_monthly", ATTRITION)
def attrition_monthly(t):
    return summaries.attrition_monthly(snapshot_fact(t), ["department", "location", "job_level"])


SEGMENT = ["department", "location", "job_level"]
HEADCOUNT_COLUMNS = ["tenure_months", "compa_ratio", "flight_risk_score", "engagement_score"]
ATTRITION_COLUMNS = ["voluntary_exit_flag", "performance_rating", "hire_date", "termination_date", "month_end"]


def kept_up(t, rollup, first, second, wrong=None):
    """The sums of a rollup after a first load, a second one, and a repetition of the second.

    `wrong` are rows that the first load brings with false values; the second takes them away and brings the right ones.
    """
    path = scratch_path(t.spark, "rollup")
    signed = lambda df, sign: df.withColumn("sign", F.lit(sign))
    opening, delta = signed(first, 1), signed(second, 1)
    if wrong is not None:
        opening, delta = opening.unionByName(signed(wrong, 1)), delta.unionByName(signed(wrong, -1))
    rollups.add_load(t.spark, path, rollup, opening, 1, "sign")
    for _ in range(2):
        rollups.add_load(t.spark, path, rollup, delta, 2, "sign")
    return rollups.read_rollup(t.spark, path, rollup, first)


def loads_of_fact(t, columns):
    """Months up to September 2001, the months after, and rows of August that the first load has with a false head count.

    The fact is written with the columns that the sums are formed from."""
    fact = written_table(snapshot_fact(t).select("date_key", *SEGMENT, "is_exit", "is_active_flag", "fte_value", *columns), "fact")
    wrong = fact.where("date_key = 20010831 AND is_exit").withColumns({"fte_value": F.lit(7.0), "is_active_flag": F.lit(True)})
    return fact.where("date_key <= 20010930"), fact.where("date_key > 20010930"), wrong


@query("l11_headcount_kept_up", HEADCOUNT)
def headcount_kept_up(t):
    """The table of l11_headcount_monthly after two loads, the second of which rewrites only the months it touches."""
    return summaries.headcount_from_sums(kept_up(t, summaries.headcount_rollup(SEGMENT), *loads_of_fact(t, HEADCOUNT_COLUMNS)), SEGMENT)


@query("l12_attrition_kept_up", ATTRITION)
def attrition_kept_up(t):
    return summaries.attrition_from_sums(kept_up(t, summaries.attrition_rollup(SEGMENT), *loads_of_fact(t, ATTRITION_COLUMNS)), SEGMENT)


# Stand-ins for role and kind of employment.
ROLES, KINDS = ("Analyst", "Engineer", "Consultant", "Specialist", "Coordinator"), ("Full-time", "Part-time", "Contract", "Intern")
BY_ROLE = ["department", "job_role", "employment_type"]
ROLE_SQL = f"{list(ROLES)}[CAST(employee_id * 3 % 5 AS INT) + 1] AS job_role, {list(KINDS)}[CAST(employee_id % 4 AS INT) + 1] AS employment_type"


def with_roles(df):
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    return df.withColumns({"job_role": pick(ROLES, F.col("employee_id") * 3 % 5), "employment_type": pick(KINDS, F.col("employee_id") % 4)})


def by_role(sql: str) -> str:
    """The statement over rows with role and kind of employment instead of place and level."""
    return sql.replace("department, location, job_level", ", ".join(BY_ROLE)).replace("FROM fact GROUP BY", f"FROM (SELECT *, {ROLE_SQL} FROM fact) GROUP BY")


@query("l11_headcount_by_role", by_role(HEADCOUNT))
def headcount_by_role(t):
    return summaries.headcount_monthly(snapshot_fact(t, each=lambda people: summaries.headcount_spans(with_roles(people), BY_ROLE)), BY_ROLE)


@query("l12_attrition_by_role", by_role(ATTRITION))
def attrition_by_role(t):
    return summaries.attrition_monthly(with_roles(snapshot_fact(t)), BY_ROLE)


# --- event facts -----------------------------------------------------------------------

HIRES = """hires AS (SELECT s.*, days_to_fill, o.o_orderstatus <> 'P' AS offer_accepted_flag, CAST(leave_count AS DOUBLE) AS interview_score
 FROM staff s JOIN orders o ON s.employee_id = o.o_orderkey LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS shipped FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey,
 LATERAL (SELECT shipped - CAST(o.o_orderdate AS DATE) AS days_to_fill))"""


QUALITY = emp(f"""
SELECT year(hire_date) || '-Q' || quarter(hire_date) AS quarter_key, recruitment_source, department, job_level, count(*) AS total_hires, {avg('days_to_fill')} AS avg_days_to_fill,
 round({ratio(cnt('offer_accepted_flag'), default=None)}, 4) AS offer_acceptance_rate, round(avg(interview_score), 2) AS avg_interview_score,
 round({ratio(cnt('kept'), default=None)}, 4) AS retention_12m_rate,
 round({avg('performance_rating', digits=None)} / 5 * 0.35::DOUBLE + {ratio(cnt('kept'), default=None)} * 0.35::DOUBLE + {avg('engagement_score', digits=None)} / 100 * 0.30::DOUBLE, 4) AS quality_of_hire_score
FROM (SELECT *, termination_date IS NULL OR termination_date >= CAST(hire_date + INTERVAL 12 MONTH AS DATE) AS kept FROM hires JOIN sources USING (recruitment_source_id)) GROUP BY 1, 2, 3, 4""", STAFF, HIRES, SOURCES)


@query("l13_source_quality_quarterly", QUALITY)
def source_quality_quarterly(t):
    return summaries.source_quality_quarterly(hired(t), ["recruitment_source", "department", "job_level"])


@query("l13_source_quality_by_role", QUALITY.replace("recruitment_source, department, job_level, count(*)", "recruitment_source, job_role, count(*)").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3")
       .replace("AS quality_of_hire_score", f"AS quality_of_hire_score, {avg('CAST(bonus + days_to_fill * 10 AS DECIMAL(18,2))')} AS cost_per_hire")
       .replace("(SELECT *, termination_date", f"(SELECT *, {ROLE_SQL}, termination_date"))
def source_quality_by_role(t):
    rows = with_roles(hired(t)).withColumn("hire_cost", F.col("bonus") + F.col("days_to_fill") * 10)
    return summaries.source_quality_quarterly(rows, ["recruitment_source", "job_role"])


def hired(t):
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("employee_id")).agg(F.min(F.col("l_shipdate").cast("date")).alias("shipped"))
    status = t.orders.select(F.col("o_orderkey").alias("employee_id"), (F.col("o_orderstatus") != "P").alias("offer_accepted_flag"))
    hires = staff(t).join(F.broadcast(t.recruitment_sources), "recruitment_source_id").join(status, "employee_id").join(shipped, "employee_id", "left")
    return hires.withColumns({"days_to_fill": F.datediff("shipped", "hire_date"), "interview_score": F.col("leave_count").cast("double")})


EQUITY = """paid AS (SELECT department, gender, region, salary, compa_ratio_raw FROM compa),
spread AS (SELECT department, gender AS g, region AS r, salary, compa_ratio_raw FROM paid UNION ALL SELECT department, gender, 'Overall', salary, compa_ratio_raw FROM paid
 UNION ALL SELECT department, 'Overall', region, salary, compa_ratio_raw FROM paid UNION ALL SELECT department, 'Overall', 'Overall', salary, compa_ratio_raw FROM paid),
cells AS (SELECT department, g AS gender_group, r AS ethnicity_group, count(*) AS n, CAST(sum(salary) AS DOUBLE) / count(*) AS m, var_samp(CAST(salary AS DOUBLE)) / count(*) AS se2,
 quantile_cont(salary, 0.5) AS med, avg(compa_ratio_raw) AS c FROM spread GROUP BY 1, 2, 3)"""
Z = 1.959963984540054
CRIT = f"CASE WHEN nu < 31 THEN ({list(summaries.T_POINTS)})[greatest(CAST(floor(nu) AS INT), 1)] ELSE ({Z}::DOUBLE + {(Z**3 + Z) / 4!r}::DOUBLE / nu + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96!r}::DOUBLE / (nu * nu)) END"


@query("l14_comp_equity", emp(f"""
SELECT department, gender_group, ethnicity_group, n AS employee_count, round(m, 2) AS avg_base_salary, med AS median_base_salary, round(c, 4) AS avg_compa_ratio,
 round(100e0 * (mm - m) / mm, 4) AS pay_gap_vs_male_pct, round(mm - m, 2) AS pay_gap_amt, coalesce(abs(mm - m) / nullif(sqrt(se2 + mse2), 0) > ({CRIT}), false) AS gap_is_significant_flag
FROM (SELECT a.*, b.m AS mm, b.se2 AS mse2, (a.se2 + b.se2) * (a.se2 + b.se2) / nullif(a.se2 * a.se2 / nullif(a.n - 1, 0) + b.se2 * b.se2 / nullif(b.n - 1, 0), 0) AS nu
 FROM cells a LEFT JOIN cells b ON a.department = b.department AND a.ethnicity_group = b.ethnicity_group AND b.gender_group = 'Male')""", COMPA, EQUITY))
def comp_equity(t):
    rows = compa_ratio_level_median(t.employee, name="compa_ratio", digits=None)
    return summaries.comp_equity(rows, ["department"], group="region")


@query("l14_controlled_pay_gap", emp(f"""
SELECT department, CAST(sum(nm) AS BIGINT) AS male_count, CAST(sum(nf) AS BIGINT) AS female_count,
 round(sum(coalesce((mp - fp) * w, 0)) / sum(w), 2) AS controlled_gap_amt
FROM (SELECT *, coalesce(CAST(nm * nf AS DOUBLE) / nullif(nm + nf, 0), 0) AS w FROM (SELECT department, job_level, {cnt(MALE)} AS nm, {cnt(FEMALE)} AS nf,
 {avg('salary', MALE, None)} AS mp, {avg('salary', FEMALE, None)} AS fp FROM employee GROUP BY 1, 2)) GROUP BY 1"""))
def controlled_pay_gap(t):
    return summaries.controlled_pay_gap(t.employee, ["department"], ["job_level"])


# The same elimination on DuckDB's sums: intercept by covariances, then age, then tenure.
@query("l14_adjusted_pay_gap", emp("""
SELECT department, nm AS male_count, nf AS female_count, n - 4 AS degrees_of_freedom, round(-b, 2) AS adjusted_gap_amt, round(se, 2) AS std_error, abs(b / se) > t AS gap_is_significant_flag
FROM (SELECT *, fy / ff AS b, sqrt((yy - fy * fy / ff) / (n - 4) / ff) AS se,
 1.959963984540054 + (1.959963984540054::DOUBLE ** 3 + 1.959963984540054) / 4 / (n - 4) + (5 * 1.959963984540054::DOUBLE ** 5 + 16 * 1.959963984540054::DOUBLE ** 3 + 3 * 1.959963984540054) / 96 / ((n - 4) * (n - 4)) AS t FROM second)""", """
rows AS (SELECT department, CAST(gender = 'Female' AS INT)::DOUBLE AS f, CAST(age AS DOUBLE) AS a, CAST(years_at_company AS DOUBLE) AS t, CAST(salary AS DOUBLE) AS y FROM employee WHERE gender IN ('Male', 'Female')),
centred AS (SELECT department, count(*) AS n, count(*) FILTER (WHERE f = 0) AS nm, count(*) FILTER (WHERE f = 1) AS nf, count(*) * covar_pop(a, a) AS aa, count(*) * covar_pop(a, t) AS ta,
 count(*) * covar_pop(a, f) AS af, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(t, t) AS tt, count(*) * covar_pop(t, f) AS tf, count(*) * covar_pop(t, y) AS ty,
 count(*) * covar_pop(f, f) AS ff, count(*) * covar_pop(f, y) AS fy, count(*) * covar_pop(y, y) AS yy FROM rows GROUP BY 1),
first AS (SELECT department, n, nm, nf, tt - ta * ta / aa AS tt, tf - ta * af / aa AS tf, ty - ta * ay / aa AS ty, ff - af * af / aa AS ff, fy - af * ay / aa AS fy, yy - ay * ay / aa AS yy FROM centred),
second AS (SELECT department, n, nm, nf, ff - tf * tf / tt AS ff, fy - tf * ty / tt AS fy, yy - ty * ty / tt AS yy FROM first)"""))
def adjusted_pay_gap(t):
    """Gap per department with age and tenure held fixed."""
    return summaries.adjusted_pay_gap(t.employee, ["department"], {"age": F.col("age"), "tenure": F.col("years_at_company")})


TRAINING = """training AS (SELECT CAST(strftime(last_day(CAST(l_shipdate AS DATE)), '%Y%m%d') AS INT) AS date_key, p_type AS skill_domain, department, job_level, l_linestatus = 'F' AS done,
 l_linenumber <= 3 AS must, l_returnflag = 'R' AS late, CAST(50 + l_discount * 500 AS DECIMAL(10,4)) AS score, CAST(l_quantity AS DECIMAL(18,2)) AS hours,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey JOIN employee ON l_orderkey = employee_id)"""


COMPLIANCE = emp(f"""
SELECT date_key, skill_domain, department, job_level, count(*) AS total_enrollments, {cnt('done')} AS completions, {cnt('done AND must')} AS mandatory_completions, {cnt('must')} AS mandatory_total,
 {cnt('late')} AS overdue_count, round({ratio(cnt('done AND must'), cnt('must'), None)}, 4) AS compliance_rate, {avg('score', 'done')} AS avg_assessment_score,
 round(CAST(sum(hours) FILTER (WHERE done) AS DOUBLE), 2) AS total_hours_completed, round(CAST(sum(cost) AS DOUBLE), 2) AS total_cost FROM training GROUP BY 1, 2, 3, 4""", TRAINING)


@query("l15_training_compliance", COMPLIANCE)
def training_compliance(t):
    return summaries.training_compliance(training_rows(t), ["date_key", "skill_domain", "department", "job_level"])


def training_rows(t, *more):
    from rosterlens.functions.dates import date_key

    joined = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(
        t.employee.select(*dict.fromkeys(("employee_id", "department", "job_level", *more))), F.col("l_orderkey") == F.col("employee_id")
    )
    return joined.select(
        date_key(F.last_day(F.col("l_shipdate").cast("date"))).alias("date_key"), F.col("p_type").alias("skill_domain"), "department", "job_level",
        (F.col("l_linestatus") == "F").alias("completion_flag"), (F.col("l_linenumber") <= 3).alias("is_mandatory_flag"),
        (F.col("l_returnflag") == "R").alias("is_overdue_flag"), (F.lit(50) + F.col("l_discount") * 500).alias("assessment_score"),
        F.col("l_quantity").alias("hours"), F.col("l_extendedprice").alias("cost"), *more,
    )


@query("l15_training_by_role", COMPLIANCE.replace("skill_domain, department, job_level, count(*)", "skill_domain, job_role, employment_type, count(*)").replace(
    "AS total_cost FROM training", f"AS total_cost, {avg('CAST(satisfaction_score AS DECIMAL(10,4))')} AS avg_satisfaction_score FROM (SELECT *, {ROLE_SQL} FROM training)")
       .replace("department, job_level, l_linestatus", "employee_id, satisfaction_score, department, job_level, l_linestatus"))
def training_by_role(t):
    rows = with_roles(training_rows(t, "employee_id", "satisfaction_score"))
    return summaries.training_compliance(rows, ["date_key", "skill_domain", "job_role", "employment_type"])


@query("l15_training_kept_up", COMPLIANCE)
def training_kept_up(t):
    by = ["date_key", "skill_domain", "department", "job_level"]
    rows = written_table(training_rows(t), "training")
    return summaries.training_from_sums(kept_up(t, summaries.training_rollup(by), rows.where("date_key <= 19981231"), rows.where("date_key > 19981231")), by)


@query("l16_funnel_metrics", f"""
WITH steps AS (SELECT event_type, user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS micros FROM events),
g AS (SELECT event_type, count(*) AS entries, count(DISTINCT user_id) AS candidates,
 round(CAST(sum(micros) AS DOUBLE) / count(micros) / 3.6e9, 2) AS avg_hours_in_stage FROM steps GROUP BY 1)
SELECT *, {pct('candidates', "(SELECT candidates FROM g WHERE event_type = 'signup')")} AS conversion_pct FROM g""")
def funnel_metrics(t):
    stages = t.events.select("user_id", "event_type", "ts", "event_id")
    return summaries.funnel_metrics(stages, "user_id", "event_type", "ts", ["ts", "event_id"], "signup")


STAGES = ("signup", "view", "click", "purchase")
REACHED = [f"""r1 AS (SELECT user_id, min(ts) AS at, CAST(NULL AS BIGINT) AS waited FROM events WHERE event_type = '{STAGES[0]}' GROUP BY 1)"""] + [
    f"""r{k} AS (SELECT e.user_id, min(e.ts) AS at, epoch_us(min(e.ts)) - epoch_us(min(p.at)) AS waited FROM events e JOIN r{k - 1} p ON e.user_id = p.user_id AND e.ts > p.at
 WHERE event_type = '{name}' GROUP BY 1)""" for k, name in enumerate(STAGES[1:], 2)]
STEPS = " UNION ALL ".join(f"SELECT {k} AS position, '{name}' AS stage, count(*) AS candidates, sum(waited) AS micros FROM r{k}" for k, name in enumerate(STAGES, 1))


@query("l16_ordered_funnel", with_(*REACHED, f"steps AS ({STEPS})", then="""
SELECT position, stage, candidates, round(100e0 * candidates / first_value(candidates) OVER w, 2) AS conversion_pct,
 round(100e0 * candidates / coalesce(lag(candidates) OVER w, candidates), 2) AS step_conversion_pct, round(CAST(micros AS DOUBLE) / candidates / 3.6e9, 2) AS avg_hours_from_previous
FROM steps WINDOW w AS (ORDER BY position)"""))
def ordered_funnel(t):
    return summaries.ordered_funnel(t.events, "user_id", "event_type", "ts", STAGES)


@query("l17_attendance_metrics", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS records, round(CAST(sum(h) AS DOUBLE), 2) AS hours_worked,
 round(CAST(sum(greatest(h - 8, 0)) AS DOUBLE), 2) AS hours_overtime, {cnt("event_type = 'error'")} AS unplanned_absences,
 {pct(cnt("event_type = 'error'"))} AS unplanned_absence_pct, {cnt('late > 0')} AS late_arrivals, CAST(sum(late) AS BIGINT) AS late_minutes
FROM (SELECT *, CAST(value / 10 AS DECIMAL(18,2)) AS h, CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS late FROM events) GROUP BY 1""")
def attendance_metrics(t):
    attendance = t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), round_half_up(F.col("value") / 10, 2).alias("hours_worked"),
        (F.col("event_type") == "error").alias("unplanned_absence_flag"),
        F.when(F.col("event_type") == "click", F.floor("value")).otherwise(F.lit(0)).cast("bigint").alias("late_minutes"),
    )
    return summaries.attendance_metrics(attendance, ["day"])


@query("l18_compensation_changes", """
SELECT o_custkey, o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, prev AS previous_salary, round(o_totalprice - prev, 2) AS change_amt,
 round(100e0 * (o_totalprice - prev) / nullif(prev, 0), 4) AS change_pct, strftime(nxt, '%Y-%m-%d') AS end_date, nxt IS NULL AS is_current
FROM (SELECT *, lag(o_totalprice) OVER w AS prev, lead(o_orderdate) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def compensation_changes(t):
    pay = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    out = summaries.compensation_changes(pay, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return text_dates(out, "o_orderdate", "end_date")


@query("l19_latest_risk_view", emp(f"""
SELECT employee_id, department, job_level, event_id, value AS flight_risk_score FROM employee LEFT JOIN (
 SELECT user_id AS employee_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) USING (employee_id)
WHERE {STAYED}"""))
def latest_risk(t):
    history = t.events.select(F.col("user_id").alias("employee_id"), "ts", "event_id", F.col("value").alias("flight_risk_score"))
    return facts.latest_risk_view(t.employee, history, ["ts", "event_id"]).select(
        "employee_id", "department", "job_level", "event_id", "flight_risk_score"
    )


MASTER = ("employee_id", "department", "location", "region", "level_name", "career_track", "recruitment_source", "source_type", "performance_label",
          "age_band", "tenure_band", "salary_band", "engagement_tier", "total_comp", "band_midpoint", "compa_ratio", "expected_promotions",
          "promotion_gap", "attrition_flag", "is_regrettable_exit")
MID = "(band_min + floor((band_max - band_min) / 2))"


@query("l20_master_view", emp(f"""
SELECT employee_id, department, location, region, level_name, career_track, recruitment_source, source_type, performance_label,
 {case_bands('age', bands.AGE_EDGES, bands.AGE_LABELS)} AS age_band, {case_bands('years_at_company', bands.TENURE_EDGES, bands.TENURE_LABELS)} AS tenure_band,
 {case_bands('salary', bands.SALARY_EDGES, bands.SALARY_LABELS)} AS salary_band, {case_bands('engagement_score', bands.ENGAGEMENT_EDGES, bands.ENGAGEMENT_TIERS)} AS engagement_tier,
 salary + bonus AS total_comp, CAST({MID} AS INT) AS band_midpoint, round(CAST(salary AS DOUBLE) / {MID}, 4) AS compa_ratio,
 round(CAST(years_at_company AS DOUBLE) / 2.8::DOUBLE, 2) AS expected_promotions, round(CAST(years_at_company AS DOUBLE) / 2.8::DOUBLE - promotions, 2) AS promotion_gap,
 CASE WHEN {LEFT} THEN 1 ELSE 0 END AS attrition_flag, CASE WHEN {LEFT} AND {HIGH} THEN 1 ELSE 0 END AS is_regrettable_exit
FROM employee JOIN levels USING (job_level) JOIN sources USING (recruitment_source_id) JOIN ratings USING (performance_rating)""", LEVELS, SOURCES, RATINGS))
def master_view(t):
    dims = {"job_level": t.job_levels, "recruitment_source_id": t.recruitment_sources, "performance_rating": t.ratings}
    return facts.master_view(t.employee, dims).select(*MASTER)


CLOSURE = """closure AS (SELECT employee_id, manager_id AS ancestor, 0 AS distance FROM employee WHERE manager_id IS NOT NULL
 UNION ALL SELECT c.employee_id, e.manager_id, c.distance + 1 FROM closure c JOIN employee e ON c.ancestor = e.employee_id WHERE e.manager_id IS NOT NULL)"""


@query("l21_manager_dimension", emp(f"""
SELECT manager_id, m.employee_name AS full_name, m.department, m.job_level AS management_level, direct_report_count, total_org_size, span_of_control_ratio,
 manager_effectiveness_score, team_exit_rate_rolling, team_engagement_avg, team_performance_avg, promotion_rate_of_team
FROM (SELECT manager_id, round({avg('engagement_score', digits=None)} * 0.40::DOUBLE + 100e0 * {ratio(cnt(STAYED), default=None)} * 0.40::DOUBLE
  + 100e0 * {ratio(cnt(HIGH), default=None)} * 0.20::DOUBLE, 2) AS manager_effectiveness_score,
  round({ratio(cnt("voluntary_exit_flag AND termination_date > DATE '2000-12-31' AND termination_date <= DATE '2001-12-31'"), default=None)}, 4) AS team_exit_rate_rolling,
  {avg('engagement_score')} AS team_engagement_avg, {avg('performance_rating')} AS team_performance_avg, round({ratio(cnt('promotions >= 1'), default=None)}, 4) AS promotion_rate_of_team
  FROM staff WHERE manager_id IS NOT NULL GROUP BY 1) s
JOIN (SELECT ancestor AS manager_id, {cnt('distance = 0')} AS direct_report_count, count(*) AS total_org_size,
  round(CAST({cnt('distance = 0')} AS DOUBLE) / count(*), 4) AS span_of_control_ratio FROM closure GROUP BY 1) USING (manager_id)
JOIN employee m ON m.employee_id = manager_id""", STAFF, CLOSURE))
def manager_dimension(t):
    return summaries.manager_dimension(staff(t), AS_OF)


MONTHS = """cells AS (SELECT e.manager_id, year(month_end) * 12 + month(month_end) AS m, count(*) FILTER (WHERE NOT is_exit) AS team, count(*) FILTER (WHERE is_exit AND voluntary_exit_flag) AS exits,
 sum(CAST(f.engagement_score AS DECIMAL(14,4))) AS score, count(f.engagement_score) AS scored FROM fact f JOIN employee e USING (employee_id) WHERE e.manager_id IS NOT NULL GROUP BY 1, 2),
spine AS (SELECT manager_id, min(m) AS first, unnest(range(min(m), max(m) + 1)) AS m FROM cells GROUP BY 1),
filled AS (SELECT manager_id, first, m, coalesce(team, 0) AS team, coalesce(exits, 0) AS exits, score, scored FROM spine LEFT JOIN cells USING (manager_id, m)),
monthly AS (SELECT manager_id, last_day(make_date(CAST((m - 1) // 12 AS INT), CAST((m - 1) % 12 + 1 AS INT), 1)) AS month_end, team AS team_size, CAST(sum(exits) OVER w AS BIGINT) AS exits_rolling,
 round(CAST(sum(exits) OVER w AS DOUBLE) / nullif(CAST(sum(team) OVER w AS DOUBLE) / count(*) OVER w, 0), 4) AS exit_rate_rolling, round(CAST(score AS DOUBLE) / nullif(scored, 0), 2) AS team_engagement_avg,
 CAST(m - first AS BIGINT) AS tenure_as_manager_months FROM filled WINDOW w AS (PARTITION BY manager_id ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("l21_manager_months", emp("""
SELECT manager_id, strftime(month_end, '%Y-%m-%d') AS month_end, team_size, exits_rolling, exit_rate_rolling, team_engagement_avg, tenure_as_manager_months FROM monthly""", *FACT, MONTHS))
def manager_months(t):
    return text_dates(summaries.manager_months(snapshot_fact(t)), "month_end")


@query("l21_manager_versions", emp("""
SELECT manager_id, team_size, exit_rate_rolling, strftime(month_end, '%Y-%m-%d') AS effective_start_date,
 strftime(lead(month_end) OVER (PARTITION BY manager_id ORDER BY month_end), '%Y-%m-%d') AS effective_end_date, lead(month_end) OVER (PARTITION BY manager_id ORDER BY month_end) IS NULL AS is_current_flag
FROM (SELECT *, lag(struct_pack(a := team_size, b := exit_rate_rolling)) OVER (PARTITION BY manager_id ORDER BY month_end) AS prev FROM monthly)
WHERE prev IS NULL OR prev.a IS DISTINCT FROM team_size OR prev.b IS DISTINCT FROM exit_rate_rolling""", *FACT, MONTHS))
def manager_versions(t):
    return text_dates(summaries.manager_versions(summaries.manager_months(snapshot_fact(t))), "effective_start_date", "effective_end_date")


@query("l22_performance_metrics", emp("""
SELECT employee_id, cycle, department, performance_rating, coalesce(round(CAST(performance_rating - lo AS DOUBLE) / nullif(hi - lo, 0), 4), 0) AS rating_normalized,
 round(CAST(performance_rating AS DOUBLE) - m, 4) AS calibration_delta, performance_rating = 1 AS pip_flag
FROM (SELECT employee_id, 'Annual-' || year(hire_date) AS cycle, department, performance_rating FROM employee) e
JOIN (SELECT 'Annual-' || year(hire_date) AS cycle, min(performance_rating) AS lo, max(performance_rating) AS hi FROM employee GROUP BY 1) USING (cycle)
JOIN (SELECT 'Annual-' || year(hire_date) AS cycle, department, CAST(sum(performance_rating) AS DOUBLE) / count(*) AS m FROM employee GROUP BY 1, 2) USING (cycle, department)"""))
def performance_metrics(t):
    reviews = t.employee.select(
        "employee_id", F.concat(F.lit("Annual-"), F.year("hire_date").cast("string")).alias("cycle"), "department", "performance_rating"
    )
    return summaries.performance_metrics(reviews, "cycle", "performance_rating", "department")


@query("l22_goal_achievement", emp("""
SELECT employee_id, cycle, department, performance_rating, promotions, leave_count, CASE WHEN hi > lo THEN round(CAST(performance_rating - lo AS DOUBLE) / (hi - lo), 4) ELSE 0 END AS rating_normalized,
 round(CAST(performance_rating AS DOUBLE) - m, 4) AS calibration_delta, performance_rating = 1 AS pip_flag, round(100e0 * promotions / nullif(leave_count, 0), 2) AS goal_achievement_pct
FROM (SELECT *, min(performance_rating) OVER (PARTITION BY cycle) AS lo, max(performance_rating) OVER (PARTITION BY cycle) AS hi,
 CAST(sum(performance_rating) OVER (PARTITION BY cycle, department) AS DOUBLE) / count(*) OVER (PARTITION BY cycle, department) AS m
 FROM (SELECT employee_id, CASE WHEN performance_rating <> 3 THEN 'Annual-' || year(hire_date) END AS cycle, department, performance_rating, promotions, leave_count FROM employee))"""))
def goal_achievement(t):
    """Metrics with goals met and set; reviews of no cycle stand as a cycle of their own."""
    cycle = F.when(F.col("performance_rating") != 3, F.concat(F.lit("Annual-"), F.year("hire_date").cast("string")))
    reviews = t.employee.select("employee_id", cycle.alias("cycle"), "department", "performance_rating", "promotions", "leave_count")
    return summaries.performance_metrics(reviews, "cycle", "performance_rating", "department", ("promotions", "leave_count"))
