"""CSV, score and table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.functions.cleaning import null_if

CORRUPT = "_corrupt_record"
FLAT_SCHEMA = (
    "Employee_ID string, Employee_Name string, Age int, Gender string, Department string, Job_Role string, Job_Level string, "
    "Manager_ID string, Location string, Work_Mode string, Years_At_Company decimal(5,2), Salary int, Bonus int, "
    "Recruitment_Source string, Performance_Rating int, Performance_Label string, Attendance_Pct decimal(5,2), "
    "Training_Hours decimal(6,2), Engagement_Score decimal(6,2), Satisfaction_Score decimal(6,2), Promotions int, "
    "Leave_Count int, Attrition string, Exit_Reason string"
)
PREDICTION_SCHEMA = (
    "Employee_ID string, Attrition string, Risk_Score double, Risk_Tier string, Model_Probability double, "
    "Top_3_Drivers string, Recommended_Action string"
)


def read_hr_csv(spark: SparkSession, path: str, schema: str = FLAT_SCHEMA, keep_corrupt: bool = False) -> DataFrame:
    """Flat extract with a header and a fixed schema.

    Malformed lines go to the _corrupt_record column when keep_corrupt is set and fail the
    read otherwise.
    """
    reader = spark.read.option("header", True).option("sep", ",").option("lineSep", "\n")
    if keep_corrupt:
        return reader.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", CORRUPT
        ).csv(path)
    return reader.schema(schema).option("mode", "FAILFAST").csv(path)


def snake_case(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


def read_hr_flat(spark: SparkSession, path: str) -> DataFrame:
    """Extract as the dashboards use it: lower-case names, missing exit reason shown as 'N/A'."""
    df = snake_case(read_hr_csv(spark, path))
    return df.withColumn("exit_reason", F.coalesce("exit_reason", F.lit("N/A")))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Score file, or an empty table of the same shape when there is none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], PREDICTION_SCHEMA)
    return spark.read.option("header", True).schema(PREDICTION_SCHEMA).csv(path)


def resolve_keys(staging: DataFrame, departments: DataFrame, locations: DataFrame, sources: DataFrame) -> DataFrame:
    """Names to keys. Rows with an unknown name are left out; see rejected_rows.

    Blank managers and 'N/A' reasons become null.
    """
    keyed = (
        staging.join(departments, "department")
        .join(locations, "location")
        .join(sources, "recruitment_source")
    )
    return keyed.withColumns({"manager_id": null_if("manager_id", ""), "exit_reason": null_if("exit_reason", "N/A")})


def rejected_rows(staging: DataFrame, departments: DataFrame, locations: DataFrame, sources: DataFrame) -> DataFrame:
    """Staging rows that resolve_keys drops, with the first name that failed."""
    marked = (
        staging.join(departments.select("department", F.lit(1).alias("__d")), "department", "left")
        .join(locations.select("location", F.lit(1).alias("__l")), "location", "left")
        .join(sources.select("recruitment_source", F.lit(1).alias("__s")), "recruitment_source", "left")
    )
    reason = (
        F.when(F.col("__d").isNull(), "department").when(F.col("__l").isNull(), "location")
        .when(F.col("__s").isNull(), "recruitment_source")
    )
    return marked.withColumn("rejected_for", reason).where(F.col("rejected_for").isNotNull()).drop("__d", "__l", "__s")


def export_table(df: DataFrame, path: str, fmt: str = "csv", rows: int | None = None, order: Sequence[str] = ()) -> None:
    """Write a result table as csv, json or parquet.

    The document variant keeps the first `rows` rows in the given order, in one file; without it
    all rows are written, by as many tasks as there are partitions.
    """
    if rows is not None and not order:
        raise ValueError("the first rows need an order")
    out = df if rows is None else df.orderBy(*order).limit(rows)
    writer = out.write.mode("overwrite")
    {"csv": writer.option("header", True).csv, "json": writer.json, "parquet": writer.parquet}[fmt](path)
