"""Set operations, pivots, ordering and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name; columns missing from one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_rows(df: DataFrame, rows: Sequence[Mapping[str, Column]], ids: Sequence[str] = ()) -> DataFrame:
    """Turn one aggregated row into several labelled rows without rescanning its input."""
    structs = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    exploded = df.select(*ids, F.explode(F.array(*structs)).alias("__row"))
    return exploded.select(*ids, "__row.*")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def set_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), list(key), "left_anti")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys two scopes share and whether they are disjoint."""
    shared = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("shared")).withColumn("is_disjoint", F.col("shared") == 0)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in columns], variable, value)


def pivot(df: DataFrame, index: Sequence[str], column: str, value: Column, values: Sequence) -> DataFrame:
    """Long to wide over a fixed, ordered value list."""
    return df.groupBy(*index).pivot(column, list(values)).agg(value)


def kpi_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One-row KPI frame as (metric, value) text pairs."""
    names = list(columns or df.columns)
    return stack_rows(df, [{"metric": F.lit(n), "value": F.col(n).cast("string")} for n in names])


def order_by_measure(df: DataFrame, *columns: tuple[Column | str, str]) -> DataFrame:
    """Order by (column, 'asc'|'desc') pairs, nulls always last."""
    keys = []
    for column, direction in columns:
        column = F.col(column) if isinstance(column, str) else column
        keys.append(column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last())
    return df.orderBy(*keys)


def domain_index(column: Column | str, order: Sequence[str]) -> Column:
    """Position of a category in a custom order, unknown ones last."""
    column = F.col(column) if isinstance(column, str) else column
    result = None
    for i, label in enumerate(order, 1):
        result = F.when(column == label, i) if result is None else result.when(column == label, i)
    return result.otherwise(len(order) + 1)


def order_by_domain(df: DataFrame, column: str, order: Sequence[str], name: str = "sort_index") -> DataFrame:
    """Add the domain position and sort by it."""
    return df.withColumn(name, domain_index(column, order)).orderBy(name)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows; planned as a per-partition top-k followed by one merge of k rows each."""
    return df.orderBy(*order).limit(k)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most n rows chosen by a seeded MD5 of the key, so the choice is repeatable anywhere."""
    return top_k(df, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)], n)
