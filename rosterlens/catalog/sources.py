"""Files, key resolution and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import EMPLOYEE_SOURCE, RATINGS, SOURCES, emp
from rosterlens.session import scratch_path
from rosterlens.sources import files, seeds
from rosterlens.operators.workforce import department_detail

FLAT = f"""flat AS (SELECT 'E' || employee_id AS employee_id, employee_name, age, gender, department, 'Role ' || job_level AS job_role, job_level,
 'E' || manager_id AS manager_id, location, work_mode, CAST(years_at_company AS DOUBLE) AS years_at_company, salary, bonus, recruitment_source,
 performance_rating, performance_label, CAST(attendance_pct AS DOUBLE) AS attendance_pct, CAST(training_hours AS DOUBLE) AS training_hours,
 CAST(engagement_score AS DOUBLE) AS engagement_score, CAST(satisfaction_score AS DOUBLE) AS satisfaction_score, promotions, leave_count, attrition, exit_reason
 FROM es JOIN ratings USING (performance_rating))"""
FLAT_CTES = (SOURCES, EMPLOYEE_SOURCE, RATINGS, FLAT)


def flat(t):
    """The 24-column extract of the employee table."""
    e = t.employee_with_source.join(F.broadcast(t.ratings), "performance_rating")
    return e.select(
        F.concat(F.lit("E"), F.col("employee_id").cast("string")).alias("Employee_ID"), F.col("employee_name").alias("Employee_Name"),
        F.col("age").alias("Age"), F.col("gender").alias("Gender"), F.col("department").alias("Department"),
        F.concat(F.lit("Role "), F.col("job_level")).alias("Job_Role"), F.col("job_level").alias("Job_Level"),
        F.concat(F.lit("E"), F.col("manager_id").cast("string")).alias("Manager_ID"), F.col("location").alias("Location"),
        F.col("work_mode").alias("Work_Mode"), F.col("years_at_company").alias("Years_At_Company"), F.col("salary").alias("Salary"),
        F.col("bonus").alias("Bonus"), F.col("recruitment_source").alias("Recruitment_Source"),
        F.col("performance_rating").alias("Performance_Rating"), F.col("performance_label").alias("Performance_Label"),
        F.col("attendance_pct").alias("Attendance_Pct"), F.col("training_hours").alias("Training_Hours"),
        F.col("engagement_score").alias("Engagement_Score"), F.col("satisfaction_score").alias("Satisfaction_Score"),
        F.col("promotions").alias("Promotions"), F.col("leave_count").alias("Leave_Count"), F.col("attrition").alias("Attrition"),
        F.col("exit_reason").alias("Exit_Reason"),
    )


DECIMALS = ("years_at_company", "attendance_pct", "training_hours", "engagement_score", "satisfaction_score")


def as_doubles(df):
    return df.withColumns({c: F.col(c).cast("double") for c in DECIMALS})


def exported(t) -> str:
    path = scratch_path(t.spark, "extract")
    files.export_table(flat(t), path, "csv")
    return path


@query("s01_read_hr_csv", emp("SELECT * FROM flat", *FLAT_CTES))
def read_hr_csv(t):
    return as_doubles(files.snake_case(files.read_hr_csv(t.spark, exported(t))))


@query("s02_read_hr_flat", emp("SELECT * REPLACE (coalesce(exit_reason, 'N/A') AS exit_reason) FROM flat", *FLAT_CTES))
def read_hr_flat(t):
    return as_doubles(files.read_hr_flat(t.spark, exported(t)))


@query("s03_read_predictions", emp("""SELECT 'E' || employee_id AS employee_id, attrition, round(CAST(engagement_score AS DOUBLE), 2) AS risk_score FROM employee"""))
def read_predictions(t):
    scored = t.employee.select(
        F.concat(F.lit("E"), F.col("employee_id").cast("string")).alias("Employee_ID"), F.col("attrition").alias("Attrition"),
        F.col("engagement_score").cast("double").alias("Risk_Score"), F.lit("Low").alias("Risk_Tier"), F.lit(0.5).alias("Model_Probability"),
        F.lit("a | b | c").alias("Top_3_Drivers"), F.lit("none").alias("Recommended_Action"),
    )
    path = scratch_path(t.spark, "scores")
    files.export_table(scored, path, "csv")
    return files.snake_case(files.read_predictions(t.spark, path)).select("employee_id", "attrition", "risk_score")


@query("s03_read_predictions_absent", emp("SELECT employee_id, CAST(NULL AS DOUBLE) AS risk_score FROM employee"))
def read_predictions_absent(t):
    none = files.snake_case(files.read_predictions(t.spark, scratch_path(t.spark, "absent"))).select(
        F.col("employee_id").cast("bigint").alias("employee_id"), "risk_score"
    )
    return t.employee.select("employee_id").join(none, "employee_id", "left")


# Staging: two departments are misspelt for some rows, blank managers and 'N/A' reasons as text.
STAGING = """staging AS (SELECT employee_id, CASE WHEN employee_id % 25 = 3 THEN 'UNKNOWN' ELSE department END AS department, location,
 CASE WHEN employee_id % 40 = 9 THEN 'Fax' ELSE recruitment_source END AS recruitment_source, coalesce(CAST(manager_id AS VARCHAR), '') AS manager_id,
 coalesce(exit_reason, 'N/A') AS exit_reason FROM es),
departments AS (SELECT c_mktsegment AS department, CAST(min(c_custkey) AS BIGINT) AS department_id FROM customer GROUP BY 1)"""


def staging(t):
    key = F.col("employee_id")
    return t.employee_with_source.select(
        "employee_id", F.when(key % 25 == 3, "UNKNOWN").otherwise(F.col("department")).alias("department"), "location",
        F.when(key % 40 == 9, "Fax").otherwise(F.col("recruitment_source")).alias("recruitment_source"),
        F.coalesce(F.col("manager_id").cast("string"), F.lit("")).alias("manager_id"),
        F.coalesce("exit_reason", F.lit("N/A")).alias("exit_reason"),
    )


def lookups(t):
    departments = t.customer.groupBy(F.col("c_mktsegment").alias("department")).agg(F.min("c_custkey").alias("department_id"))
    locations = t.nation.select(F.col("n_name").alias("location"), F.col("n_nationkey").alias("location_id"))
    return departments, locations, t.recruitment_sources.select("recruitment_source", "recruitment_source_id")


@query("s04_resolve_keys", emp("""
SELECT employee_id, department_id, n_nationkey AS location_id, recruitment_source_id, nullif(manager_id, '') AS manager_id, nullif(exit_reason, 'N/A') AS exit_reason
FROM staging JOIN departments USING (department) JOIN nation ON location = n_name JOIN sources USING (recruitment_source)""", SOURCES, EMPLOYEE_SOURCE, STAGING))
def resolve_keys(t):
    return files.resolve_keys(staging(t), *lookups(t)).select(
        "employee_id", "department_id", "location_id", "recruitment_source_id", "manager_id", "exit_reason"
    )


@query("s04_rejected_rows", emp("""
SELECT employee_id, CASE WHEN department = 'UNKNOWN' THEN 'department' ELSE 'recruitment_source' END AS rejected_for FROM staging
WHERE department = 'UNKNOWN' OR recruitment_source = 'Fax'""", SOURCES, EMPLOYEE_SOURCE, STAGING))
def rejected_rows(t):
    return files.rejected_rows(staging(t), *lookups(t)).select("employee_id", "rejected_for")


def _names_sql(rows) -> str:
    return "[" + ", ".join("'" + r[0].replace("'", "''") + "'" for r in rows) + "]"


@query("s05_seed_dims", emp(f"""
SELECT 'departments' AS dim, ({_names_sql(seeds.DEPARTMENTS)})[employee_id % {len(seeds.DEPARTMENTS)} + 1] AS name, count(*) AS employees FROM employee GROUP BY 2
UNION ALL SELECT 'locations', ({_names_sql(seeds.LOCATIONS)})[employee_id % {len(seeds.LOCATIONS)} + 1], count(*) FROM employee GROUP BY 2
UNION ALL SELECT 'job_levels' AS dim, job_level AS name, count(*) AS employees FROM employee GROUP BY 2
UNION ALL SELECT 'recruitment_sources', recruitment_source, count(*) FROM es GROUP BY 2
UNION ALL SELECT 'ratings', performance_label, count(*) FROM employee JOIN ratings USING (performance_rating) GROUP BY 2""", SOURCES, EMPLOYEE_SOURCE, RATINGS))
def seed_dims(t):
    dims = seeds.seed_dims(t.spark)
    # Departments and locations of the model have other names; employees are dealt to the seeds by their id.
    dealt = t.employee.withColumns({
        "department_id": (F.col("employee_id") % dims["departments"].count() + 1).cast("int"),
        "location_id": (F.col("employee_id") % dims["locations"].count() + 1).cast("int"),
    }).drop("department", "location")
    out = None
    for dim, key, label in (("departments", "department_id", "department"), ("locations", "location_id", "location"), ("job_levels", "job_level", "job_level"), ("recruitment_sources", "recruitment_source_id", "recruitment_source"),
                            ("ratings", "performance_rating", "performance_label")):
        used = dealt.join(dims[dim], key).groupBy(F.col(label).alias("name")).agg(F.count(F.lit(1)).alias("employees"))
        used = used.withColumn("dim", F.lit(dim))
        out = used if out is None else out.unionByName(used)
    return out


@query("s06_bronze_source", """
SELECT CAST(o_custkey AS VARCHAR) AS worker_id, concat('Last', CAST(o_custkey % 100 AS VARCHAR)) AS last_name,
 strftime(o_orderdate + to_microseconds(o_orderkey), '%Y-%m-%d %H:%M:%S.%f') AS extracted_at FROM orders""")
def bronze_source(t):
    from rosterlens.catalog.loads import raw_workers
    from rosterlens.plans.medallion import bronze_source as source

    path = scratch_path(t.spark, "workers")
    raw_workers(t).write.parquet(path)
    return source(t.spark.read.parquet(path)).select(
        "worker_id", "last_name", F.date_format("extracted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("extracted_at")
    )


@query("s07_export_table", emp("""
SELECT department, count(*) AS headcount FROM employee GROUP BY 1"""))
def export_table(t):
    path = scratch_path(t.spark, "export")
    files.export_table(department_detail(t.employee).select("department", "headcount"), path, "json")
    return t.spark.read.schema("department string, headcount bigint").json(path)
