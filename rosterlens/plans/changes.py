"""Upserts, change logs and slowly changing dimensions on plain files.

The plain functions return the complete new state; storing.publish writes it to a fresh folder
and only then makes it current, so a failed load leaves the previous version readable. The
functions on folders (upsert_by_key, scd2_load) rewrite only the partitions that hold changed keys;
a load that is repeated after a failure gives the same state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlens.functions.cleaning import surrogate_key
from rosterlens.operators.joins import snapshot_compare
from rosterlens.operators.ranking import latest_per_key
from rosterlens.operators.reshape import stack_rows
from rosterlens.operators.sequence import next_row, previous_row
from rosterlens.plans import storing
from rosterlens.session import written_table

# Compared and updated columns of the employee load, audited columns, versioned columns.
COMPARE_COLUMNS = ("salary", "department", "job_level", "performance_rating", "engagement_score", "attrition")
UPDATE_COLUMNS = (
    "salary", "bonus", "department", "job_level", "performance_rating", "engagement_score", "satisfaction_score",
    "attendance_pct", "training_hours", "attrition", "exit_reason",
)
AUDIT_COLUMNS = ("salary", "performance_rating", "attrition")
VERSIONED_COLUMNS = (
    "employment_status_code", "employee_type_code", "full_name", "email_work", "gender_code", "age_band_code", "fte_value",
)


def differs(a: str, b: str, columns: Sequence[str]) -> Column:
    """Any of the columns differs between struct a and struct b; null counts as a value."""
    parts = [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    return reduce(lambda x, y: x | y, parts)


def upsert(target: DataFrame, source: DataFrame, key: str, compare: Sequence[str] = COMPARE_COLUMNS,
           update: Sequence[str] = UPDATE_COLUMNS) -> DataFrame:
    """New state of the target plus an `action` column: insert, update or unchanged.

    Matched rows change only when a compared column differs; then all update columns are taken.
    """
    both = snapshot_compare(target, source.select(*target.columns), key)
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNotNull() & differs("old", "new", compare), "update")
        .otherwise("unchanged")
    )
    both = both.withColumn("action", action)
    columns = []
    for name in target.columns:
        fresh = F.col("action") == "insert"
        if name in update:
            fresh = fresh | (F.col("action") == "update")
        columns.append(F.when(fresh, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name))
    return both.select(*columns, "action")


def upsert_counts(result: DataFrame) -> DataFrame:
    """One row: rows inserted, updated and left alone."""
    return result.agg(*[
        F.count(F.when(F.col("action") == name, 1)).alias(label)
        for name, label in (("insert", "rows_inserted"), ("update", "rows_updated"), ("unchanged", "rows_unchanged"))
    ])


def upsert_by_key(spark: SparkSession, path: str, batch: DataFrame, key: str, parts: int, compare: Sequence[str] = COMPARE_COLUMNS,
                  update: Sequence[str] = UPDATE_COLUMNS) -> list[int]:
    """Upsert into a table written by storing.write_by_key; the numbers of the partitions rewritten.

    Only the partitions of the batch's keys are read, and of these only those with an insert or update are written again.
    """
    near = storing.touched_parts(batch, key, parts)
    if not near:
        return []
    old = spark.read.parquet(path).where(F.col(storing.PART).isin(near)).drop(storing.PART)
    merged = upsert(old, batch, key, compare, update).withColumn(storing.PART, storing.key_part(key, parts))
    changed = sorted(r[0] for r in merged.where("action <> 'unchanged'").select(storing.PART).distinct().collect())
    if changed:
        storing.write_partitions(written_table(merged.where(F.col(storing.PART).isin(changed)).drop("action"), "upsert"), path, [storing.PART])
    return changed


def change_log(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str] = AUDIT_COLUMNS) -> DataFrame:
    """One row per changed column of every key present in both images, values as text."""
    left = old.select(key, *[F.col(c).alias(f"__old_{c}") for c in columns])
    pairs = left.join(new.select(key, *columns), key)
    rows = [
        {
            "changed_column": F.lit(c), "old_value": F.col(f"__old_{c}").cast("string"), "new_value": F.col(c).cast("string"),
            "__same": F.col(f"__old_{c}").eqNullSafe(F.col(c)),
        }
        for c in columns
    ]
    return stack_rows(pairs, rows, [key]).where(~F.col("__same")).drop("__same")


def _opened(row: str, columns: Sequence[str], version: Column, as_of: str) -> Column:
    return F.struct(
        *[F.col(f"{row}.{c}").alias(c) for c in columns],
        version.cast("int").alias("scd_version"),
        F.lit(as_of).cast("date").alias("effective_start_date"),
        F.lit(None).cast("date").alias("effective_end_date"),
        F.lit(True).alias("is_current_flag"),
    )


def scd2_initial(snapshot: DataFrame, as_of: str) -> DataFrame:
    """First version of every row."""
    return snapshot.select(
        "*", F.lit(1).alias("scd_version"), F.lit(as_of).cast("date").alias("effective_start_date"),
        F.lit(None).cast("date").alias("effective_end_date"), F.lit(True).alias("is_current_flag"),
    )


def scd2_snapshot(dim: DataFrame, snapshot: DataFrame, key: str, check_cols: Sequence[str] = VERSIONED_COLUMNS,
                  as_of: str = "", keep_deleted: bool = False) -> DataFrame:
    """Apply a snapshot to a versioned dimension.

    A changed row closes its current version and opens the next; a new row opens one; a row
    gone from the snapshot is closed (unless keep_deleted); an unchanged row stays. Applying
    the same snapshot again changes nothing.
    """
    columns = snapshot.columns
    last = latest_per_key(dim, [key], ["scd_version"])
    both = snapshot_compare(last, snapshot, key)

    current = F.coalesce(F.col("old.is_current_flag"), F.lit(False))
    changed = current & F.col("new").isNotNull() & differs("old", "new", check_cols)
    gone = current & F.col("new").isNull()
    gone = gone & F.lit(not keep_deleted)
    opens = F.col("new").isNotNull() & (~current | changed)

    def stored(closing: bool) -> Column:
        """The stored current version, with its end set when closing."""
        return F.struct(
            *[F.col(f"old.{c}").alias(c) for c in columns],
            F.col("old.scd_version").cast("int").alias("scd_version"),
            F.col("old.effective_start_date").alias("effective_start_date"),
            (F.lit(as_of).cast("date") if closing else F.col("old.effective_end_date")).alias("effective_end_date"),
            F.lit(not closing).alias("is_current_flag"),
        )

    version = F.coalesce(F.col("old.scd_version"), F.lit(0)) + 1
    rows = F.array_compact(F.array(
        F.when(changed | gone, stored(True)).when(current, stored(False)),
        F.when(opens, _opened("new", columns, version, as_of)),
    ))
    renewed = both.select(F.explode(rows).alias("r")).select("r.*")
    closed_before = dim.where(~F.col("is_current_flag")).select(*renewed.columns)
    return closed_before.unionByName(renewed)


def scd2_create(snapshot: DataFrame, root: str, key: str, as_of: str, parts: int) -> None:
    """Start a versioned dimension in a folder: `latest` has every key's newest version by partitions of keys, `history` the versions before."""
    storing.write_by_key(scd2_initial(snapshot, as_of), f"{root}/latest", key, parts)


def scd2_load(spark: SparkSession, root: str, snapshot: DataFrame, key: str, check_cols: Sequence[str], as_of: str, parts: int,
              keep_deleted: bool = False) -> list[int]:
    """Apply a snapshot like scd2_snapshot; the numbers of the partitions rewritten.

    Closed history is never read or written again: superseded versions go to one new partition of `history` named after the load,
    and only the partitions of `latest` that hold a changed key are replaced. Repeating the load of a day replaces what it wrote.
    """
    latest = spark.read.parquet(f"{root}/latest").drop(storing.PART)
    rows = scd2_snapshot(latest, snapshot, key, check_cols, as_of, keep_deleted).withColumn(storing.PART, storing.key_part(key, parts))
    day = F.lit(as_of).cast("date")
    moved = (F.col("effective_start_date") == day) | F.col("effective_end_date").eqNullSafe(day)
    changed = sorted(r[0] for r in rows.where(moved).select(storing.PART).distinct().collect())  # at most `parts` numbers
    if not changed:
        return []
    staged = written_table(rows.where(F.col(storing.PART).isin(changed)), "versions")
    newest = staged.groupBy(key).agg(F.max("scd_version").alias("scd_version"))
    superseded = staged.join(newest, [key, "scd_version"], "left_anti").withColumn("load_date", F.lit(as_of))
    storing.write_partitions(superseded.drop(storing.PART).select(*latest.columns, "load_date"), f"{root}/history", ["load_date"])
    storing.write_partitions(staged.join(newest, [key, "scd_version"], "left_semi").select(*latest.columns, storing.PART), f"{root}/latest", [storing.PART])
    return changed


def scd2_read(spark: SparkSession, root: str) -> DataFrame:
    """All versions of a dimension kept by scd2_load."""
    latest = spark.read.parquet(f"{root}/latest").drop(storing.PART)
    if not storing.exists(spark, f"{root}/history"):
        return latest
    return spark.read.schema(latest.schema).parquet(f"{root}/history").select(*latest.columns).unionByName(latest)


def scd2_late_snapshot(dim: DataFrame, snapshot: DataFrame, key: str, check_cols: Sequence[str], as_of: str, next_load: str) -> DataFrame:
    """Work in a snapshot that arrives after a later one (of the day next_load) was applied.

    It tells the states from as_of up to next_load. A version valid on as_of that differs is split: it ends on as_of, the late
    state lasts to next_load or to the version's own end, and the old state goes on after. A key without a version on as_of
    gets one up to its next version or next_load. Keys that the late snapshot lacks stay as they are. Versions are numbered anew.
    """
    columns = snapshot.columns
    day, after = F.lit(as_of).cast("date"), F.lit(next_load).cast("date")
    span = ["effective_start_date", "effective_end_date", "is_current_flag"]
    valid = (F.col("effective_start_date") <= day) & (F.col("effective_end_date").isNull() | (F.col("effective_end_date") > day))
    late = snapshot.select(key, F.struct(*columns).alias("new"))
    old = dim.where(valid).select(key, F.struct(*columns, *span).alias("old"))
    state = lambda side, start, end, current: F.struct(
        *[F.col(f"{side}.{c}").alias(c) for c in columns], start.alias(span[0]), end.alias(span[1]), current.alias(span[2]))
    start, end, current = (F.col(f"old.{c}") for c in span)
    split = F.col("new").isNotNull() & differs("old", "new", check_cols)
    until = F.least(F.coalesce(end, after), after)
    goes_on = end.isNull() | (end > after)
    pieces = F.when(~split, F.array(state("old", start, end, current))).otherwise(F.array_compact(F.array(
        F.when(start < day, state("old", start, day, F.lit(False))),
        state("new", day, until, F.lit(False)),
        F.when(goes_on, state("old", after, end, current)),
    )))
    renewed = old.join(late, key, "left").select(F.explode(pieces).alias("r")).select("r.*")
    others = dim.where(~F.coalesce(valid, F.lit(False))).select(*columns, *span)
    first = dim.where(F.col("effective_start_date") > day).groupBy(key).agg(F.min("effective_start_date").alias("__first"))
    fresh = late.join(old, key, "left_anti").join(first, key, "left")
    fresh = fresh.select(state("new", day, F.least(F.coalesce("__first", after), after), F.lit(False)).alias("r")).select("r.*")
    number = F.row_number().over(Window.partitionBy(key).orderBy("effective_start_date")).cast("int")
    return renewed.unionByName(others).unionByName(fresh).withColumn("scd_version", number).select(*dim.columns)


def with_version_key(dim: DataFrame, key: str) -> DataFrame:
    """Stable surrogate key per version."""
    return dim.withColumn("employee_key", surrogate_key(key, "scd_version"))


def scd2_from_history(history: DataFrame, key: str, order: Sequence[str], check_cols: Sequence[str], bucket: Column) -> DataFrame:
    """Versions from an ordered change history: consecutive equal states are merged.

    order[0] is the effective timestamp. A version ends where the next one starts.
    """
    seen = previous_row(history, [key], order, check_cols, bucket, "__prev")
    same = F.col("__prev").isNotNull() & reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__prev.{c}")) for c in check_cols]
    )
    starts = seen.where(~same).drop("__prev")
    ended = next_row(starts, [key], order, [order[0]], bucket, "__next")
    return ended.select(
        "*", F.col(f"__next.{order[0]}").alias("effective_end"), F.col("__next").isNull().alias("is_current_flag")
    ).drop("__next").withColumnRenamed(order[0], "effective_start")
