"""Bronze and silver layers, incremental filter, and the layer runner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import bands, cleaning, dates
from rosterlens.operators.filters import not_null_keys
from rosterlens.operators.ranking import latest_per_key

SOURCE_SYSTEM = "WORKDAY"


def bronze_source(raw: DataFrame) -> DataFrame:
    """Raw worker extract with only the columns the layer needs."""
    return raw.select(
        "worker_id", "first_name", "last_name", "email_primary", "hire_date", "termination_date", "worker_status",
        "employee_type", "fte_percentage", "birth_date", "gender", "ethnicity", "nationality_iso", "extracted_at",
    )


def bronze_employees(raw: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Typed raw rows: trimmed text, safe dates, upper-case codes, source and load time."""
    src = bronze_source(raw)
    return src.select(
        F.col("worker_id").cast("string").alias("employee_id"),
        cleaning.clean_string("first_name").alias("first_name"),
        cleaning.clean_string("last_name").alias("last_name"),
        cleaning.clean_string("email_primary").alias("email_work"),
        dates.safe_date("hire_date").alias("hire_date"),
        dates.safe_date("termination_date").alias("termination_date"),
        F.upper(F.trim("worker_status")).alias("employment_status_raw"),
        F.upper(F.trim("employee_type")).alias("employee_type_raw"),
        F.col("fte_percentage").try_cast("decimal(5,2)").alias("fte_value"),
        dates.safe_date("birth_date").alias("birth_date"),
        cleaning.clean_string("gender").alias("gender_raw"),
        cleaning.clean_string("ethnicity").alias("ethnicity_raw"),
        cleaning.clean_string("nationality_iso").alias("nationality_code"),
        F.lit(SOURCE_SYSTEM).alias("source_system_code"),
        F.col("extracted_at").alias("ingestion_timestamp"),
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("bronze_loaded_at"),
    )


def incremental_filter(source: DataFrame, target: DataFrame, ts_col: str) -> DataFrame:
    """Rows newer than the newest row of the target; everything when the target is empty."""
    mark = target.select(F.max(ts_col)).scalar()
    return source.where((F.col(ts_col) > mark) | mark.isNull())


def silver_employees(bronze: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Canonical codes, names and age band; newest row per employee.

    Rows are reduced to the newest per key first (partial maxima before the shuffle), so the
    code mapping runs on the survivors only. Ties on the timestamp fall to the remaining
    columns in order, which keeps reloads repeatable.
    """
    today = F.current_date() if as_of is None else as_of
    valid = not_null_keys(bronze, ["employee_id", "first_name"])
    newest = latest_per_key(valid.drop("bronze_loaded_at"), ["employee_id"], ["ingestion_timestamp", "hire_date"])
    age = dates.age_years("birth_date", today)
    return newest.select(
        "employee_id", "first_name", "last_name",
        cleaning.full_name("first_name", "last_name").alias("full_name"),
        "email_work", "hire_date", "termination_date", "birth_date",
        F.coalesce(bands.cut(age, bands.AGE_EDGES, bands.AGE_LABELS_SHORT), F.lit("65+")).alias("age_band_code"),
        cleaning.employment_status("employment_status_raw").alias("employment_status_code"),
        cleaning.employee_type("employee_type_raw").alias("employee_type_code"),
        cleaning.gender("gender_raw").alias("gender_code"),
        cleaning.clean_string("ethnicity_raw").alias("ethnicity_code"),
        "nationality_code",
        cleaning.null_default("fte_value", 1.0).cast("decimal(5,2)").alias("fte_value"),
        "source_system_code", "ingestion_timestamp",
    )
