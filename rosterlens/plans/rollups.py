"""Summary tables kept up by adding what a load brings.

A rollup stores additive partial sums per month and segment. A load sums its own rows, merges them with the stored sums of the
months it touches and rewrites these months alone; averages and rates are formed when the table is read. Corrections are
loads too: the old row with sign -1, the new one with +1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.plans import storing
from rosterlens.session import written_table

ROWS, LOAD = "row_count", "last_load"


@dataclass(frozen=True)
class Rollup:
    """Keys (the month first) and the sums kept: name -> numeric expression over a row; null counts as nothing."""

    keys: Sequence[str]
    sums: Mapping[str, Column]

    def kind(self, name: str) -> str:
        """Sums of decimals and whole numbers, so that additions in any order give the same."""
        return "bigint" if name == ROWS or name.startswith("n_") else "decimal(38,4)"


def partial_sums(rows: DataFrame, rollup: Rollup, sign: str | None = None) -> DataFrame:
    """Keys, row_count and the sums; rows with a column `sign` of -1 are taken away. Combined before the shuffle."""
    factor = F.lit(1) if sign is None else F.col(sign)
    named = {ROWS: F.lit(1), **rollup.sums}
    sums = [F.sum(F.coalesce(x.cast(rollup.kind(name)), F.lit(0)) * factor).cast(rollup.kind(name)).alias(name) for name, x in named.items()]
    return rows.groupBy(*rollup.keys).agg(*sums)


def add_load(spark: SparkSession, path: str, rollup: Rollup, rows: DataFrame, load: int, sign: str | None = None) -> list:
    """Merge a load into the table at `path`; the months rewritten.

    Loads are numbered upwards. A month that has seen the load already is left alone, so a load that is repeated after a failure
    between two months adds nothing twice. Segments without rows left disappear.
    """
    month = rollup.keys[0]
    delta = written_table(partial_sums(rows, rollup, sign), "delta")
    months = sorted(r[0] for r in delta.select(month).distinct().collect())  # as many as the load has months
    merged, names = delta, [ROWS, *rollup.sums]
    if storing.exists(spark, path):
        stored = spark.read.schema(delta.withColumn(LOAD, F.lit(0)).schema).parquet(path).where(F.col(month).isin(months))
        seen = {r[0] for r in stored.where(F.col(LOAD) >= load).select(month).distinct().collect()}
        months = [m for m in months if m not in seen]
        merged = stored.drop(LOAD).unionByName(delta)
    if not months:
        return []
    merged = merged.where(F.col(month).isin(months)).groupBy(*rollup.keys).agg(*[F.sum(n).cast(rollup.kind(n)).alias(n) for n in names])
    merged = written_table(merged.withColumn(LOAD, F.lit(load)), "merged")
    storing.write_partitions(merged, path, [month])
    return months


def read_rollup(spark: SparkSession, path: str, rollup: Rollup, like: DataFrame) -> DataFrame:
    """Stored sums of all months; `like` has the keys' types (the rows of any load)."""
    schema = partial_sums(like, rollup).withColumn(LOAD, F.lit(0)).schema
    return spark.read.schema(schema).parquet(path).where(F.col(ROWS) > 0).drop(LOAD).select(*rollup.keys, ROWS, *rollup.sums)
