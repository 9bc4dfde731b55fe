"""Join shapes of the workforce model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.dates import date_key
from rosterlens.operators.ranking import latest_per_key


def star_join(fact: DataFrame, dims: Mapping[str, DataFrame], how: str = "inner") -> DataFrame:
    """Fact joined to its literal reference tables, keyed by the shared column name.

    The optimizer chooses how each side travels, by its size.
    """
    for key, dim in dims.items():
        fact = fact.join(dim, key, how)
    return fact


def gold_star_join(fact: DataFrame, dims: Mapping[str, DataFrame], manager: DataFrame | None = None,
                   current: str = "is_current_flag") -> DataFrame:
    """Inner joins to the current version of each dimension, optional join to the manager dimension."""
    for key, dim in dims.items():
        if current in dim.columns:
            dim = dim.where(current).drop(current)
        fact = fact.join(dim, key)
    if manager is not None:
        fact = fact.join(manager, "manager_id", "left")
    return fact


def latest_then_left_join(df: DataFrame, history: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Reduce the history to its newest row per key, then attach it."""
    return df.join(latest_per_key(history, [key], order), key, "left")


def self_join_manager(teams: DataFrame, employee: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Attach manager attributes to rows already aggregated by manager_id."""
    managers = employee.select(F.col("employee_id").alias("manager_id"), *[F.col(s).alias(n) for s, n in columns.items()])
    return teams.join(managers, "manager_id")


def left_self_join_manager(df: DataFrame, employee: DataFrame) -> DataFrame:
    """Attach the manager's name where there is one.

    The lookup side is two columns wide with unique keys; a huge team is split by adaptive
    skew handling on the row side.
    """
    names = employee.select(F.col("employee_id").alias("manager_id"), F.col("employee_name").alias("manager_name"))
    return df.join(names, "manager_id", "left")


def anti_join_orphans(df: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Foreign key values (with their row counts) that the dimension lacks."""
    used = df.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    return used.join(dim.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def month_spine_rows(df: DataFrame, start: Column, end: Column, first: str, last: str, name: str = "month_end") -> DataFrame:
    """Each row repeated for every month end of its own interval, clipped to [first, last].

    Generated per row with sequence(), so no pairing with a separate calendar takes place.
    """
    low = F.greatest(F.trunc(start, "MM"), F.trunc(F.lit(first).cast("date"), "MM"))
    high = F.least(F.trunc(end, "MM"), F.trunc(F.lit(last).cast("date"), "MM"))
    months = F.when(low <= high, F.sequence(low, high, F.expr("interval 1 month")))
    return df.withColumn("__month", F.explode(months)).withColumn(name, F.last_day("__month")).drop("__month")


def left_using_joins(df: DataFrame, rights: Mapping[str, DataFrame], unknown: Mapping[str, object] | None = None) -> DataFrame:
    """LEFT JOIN USING for each (key, table); unmatched keys take the given defaults."""
    for key, right in rights.items():
        df = df.join(right, key, "left")
    for column, default in (unknown or {}).items():
        df = df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))
    return df


def semi_join_scope(df: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    return df.join(scope.select(key).distinct(), key, "left_semi")


def prediction_left_join(df: DataFrame, scores: DataFrame, key: str = "employee_id") -> DataFrame:
    return df.join(scores, key, "left")


def score_outcome_join(scores: DataFrame, employee: DataFrame, key: str = "employee_id") -> DataFrame:
    return scores.join(employee.select(key, "attrition"), key)


def group_total_join(counts: DataFrame, keys: Sequence[str], count_col: str = "n", name: str = "pct") -> DataFrame:
    from rosterlens.operators.grouping import share_of_total

    return share_of_total(counts, count_col, keys, name)


def snapshot_compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both images of each key side by side as structs old/new (null when absent)."""
    left = old.select(key, F.struct(*old.columns).alias("old"))
    right = new.select(key, F.struct(*new.columns).alias("new"))
    return left.join(right, key, "full_outer")


def map_lookup(column: Column | str, mapping: Mapping) -> Column:
    """Literal dictionary lookup; null for unknown keys."""
    column = F.col(column) if isinstance(column, str) else column
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def role_playing_date_join(fact: DataFrame, dates: DataFrame, day_col: str, columns: Sequence[str]) -> DataFrame:
    """Join the calendar through any date column of the fact; facts outside the calendar or without a date are kept."""
    return fact.withColumn("date_key", date_key(day_col)).join(dates.select("date_key", *columns), "date_key", "left")
