"""Previous and next row per key without putting one key's whole history into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.operators.ranking import same_keys


def neighbour_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], bucket: Column,
                  name: str, direction: str = "previous") -> DataFrame:
    """Add a struct of the neighbouring row's columns (null at the end of the history).

    `bucket` must grow with the order (a month of the date, say). lag/lead run inside each
    (key, bucket); the border row of every bucket is taken by an aggregate and carried over
    to the adjacent bucket. Rows with a null key or order are kept: null keys form a history, null
    orders come first.
    """
    back = direction == "previous"
    step = F.lag if back else F.lead
    border = F.max_by if back else F.min_by
    row, position = F.struct(*columns), F.struct(*order)
    bucketed = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    local = bucketed.withColumn("__local", step(row).over(inside))
    borders = bucketed.groupBy(*keys, "__bucket").agg(border(row, position).alias("__border"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    carried = borders.select(*keys, "__bucket", step("__border").over(across).alias("__carried"))
    return same_keys(local, carried, [*keys, "__bucket"]).select(
        *df.columns, F.coalesce("__local", "__carried").alias(name)
    )


def previous_row(df, keys, order, columns, bucket, name="previous") -> DataFrame:
    return neighbour_row(df, keys, order, columns, bucket, name, "previous")


def next_row(df, keys, order, columns, bucket, name="next") -> DataFrame:
    return neighbour_row(df, keys, order, columns, bucket, name, "next")


def carried_forward(facts: DataFrame, versions: DataFrame, keys: Sequence[str], day: str, start: str, columns: Sequence[str],
                    bucket: Callable[[Column], Column], name: str = "carried") -> DataFrame:
    """Every fact with a struct of the newest version that starts on or before its day (null if there is none).

    Facts and versions stand in one column of time per key, and the last version is carried forward by a window inside (key, bucket),
    so that facts are not multiplied by versions and a hot key is spread over its buckets. The newest version of the earlier buckets
    enters each bucket that has facts as one more row, so the facts are shuffled once. `bucket` must grow with time (a month of the
    day, say); between buckets one row per (key, bucket) is ordered. Of versions that start together the largest by `columns` counts.
    Null keys and null days have no version.
    """
    version = F.struct(F.col(start), *[F.col(c) for c in columns if c != start])
    known = versions.where(F.col(start).isNotNull()).select(*keys, bucket(F.col(start)).alias("__bucket"), version.alias("__version"))
    kind = known.schema["__version"].dataType
    rows = facts.select(*keys, bucket(F.col(day)).alias("__bucket"), F.struct(*facts.columns).alias("__row"))
    at = F.col("__row").getField(day)
    whole = at.isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    # In a bucket's order its facts come first, its newest version second.
    used = rows.where(whole).select(*keys, "__bucket").distinct().withColumns({"__border": F.lit(None).cast(kind), "__used": F.lit(True)})
    newest = known.groupBy(*keys, "__bucket").agg(F.max("__version").alias("__border")).withColumn("__used", F.lit(False))
    before = Window.partitionBy(*keys).orderBy("__bucket", F.desc("__used")).rowsBetween(Window.unboundedPreceding, -1)
    carried = used.unionByName(newest).withColumn("__version", F.last("__border", ignorenulls=True).over(before))
    carried = carried.where("__used AND __version IS NOT NULL").select(*keys, "__bucket", "__version")
    both = known.unionByName(carried).unionByName(rows, allowMissingColumns=True).repartition(*keys, "__bucket")
    # Formed behind the shuffle, which moves the fact's day and the version's start once.
    order = [F.coalesce(at, F.col("__version").getField(start)), F.col("__row").isNotNull(), F.col("__version")]
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__last", F.last("__version", ignorenulls=True).over(inside)).where("__row IS NOT NULL")
    return found.select("__row.*", F.when(whole, F.col("__last")).alias(name))
