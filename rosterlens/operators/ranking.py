"""Ranks, n-tiles and running totals that never sort one whole group in a single task.

Rank-type windows over a few large groups would put each group into one task. Here the
rows are first counted per distinct value; a running total over those values, in ranges that
are taken from the data, gives each value its position, and the rows look it up. Any orderable
type will do. Null keys are groups and null values come last, as in SQL; no row is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions.numeric import col
from rosterlens.session import written_table


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as an aggregate: partial maxima are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    newest = F.max(F.struct(*order, *rest)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__row.{c}") for c in (*order, *rest)])


def row_number_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row per key as row_number() = 1; the row limit is applied before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal; the result has left's columns and right's others."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def running_total(df: DataFrame, keys: Sequence[str], order: str, weight: str, before: str = "before", total: str = "total") -> DataFrame:
    """For rows unique per (keys, order): weight strictly before each row, and the group total.

    The rows are dealt by range of (keys, order) and written once, so that the ranges stay as they
    are; totals run over the range sums (one row per range and group) and inside each range.
    """
    ordered = [F.col(k).asc_nulls_last() for k in (*keys, order)]
    placed = written_table(df.repartitionByRange(*ordered).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*keys, "__range").agg(F.sum(weight).alias("__sum"))
    across = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "__range",
        F.coalesce(F.sum("__sum").over(across), F.lit(0)).alias("__offset"),
        F.sum("__sum").over(Window.partitionBy(*keys)).alias(total),
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return same_keys(running, offsets, [*keys, "__range"]).select(*df.columns, (F.col("__offset") + F.col("__inside")).alias(before), total)


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per (keys, value): rows with that value (`ties`), rows below it (`before`) and group size (`total`)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    keyed = counts if keys else counts.withColumn("__all", F.lit(1))
    return running_total(keyed, list(keys) or ["__all"], value, "ties").select(*keys, value, "ties", "before", "total")


def position_lookup(df: DataFrame, keys: Sequence[str], value: str, outputs: Mapping[str, Column]) -> DataFrame:
    """Expressions over ties/before/total per (keys, value)."""
    return value_positions(df, keys, value).select(*keys, value, *[c.alias(n) for n, c in outputs.items()])


def _common(df: DataFrame, values: Sequence[str]) -> str:
    """One type that holds the values of all columns and orders them as their own types do."""
    floating = any(df.schema[v].dataType.typeName() in ("double", "float") for v in values)
    return "double" if floating else "decimal(30,8)"


def stacked_positions(df: DataFrame, views: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Positions like value_positions for several (keys, value) views of the same numeric rows, in one count and one range pass.

    Columns: view, k0, k1, ... (the view's keys as text), value, ties, before, total; `view_lookup` and grouping.view_quantiles read them.
    """
    width = max(len(keys) for keys, _ in views.values())
    kind = _common(df, [value for _, value in views.values()])
    key = lambda keys, i: (F.col(keys[i]).cast("string") if i < len(keys) else F.lit(None).cast("string")).alias(f"k{i}")
    parts = [F.struct(F.lit(name).alias("view"), *[key(keys, i) for i in range(width)], F.col(value).cast(kind).alias("value")) for name, (keys, value) in views.items()]
    stacked = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*")
    names = ["view", *[f"k{i}" for i in range(width)]]
    counts = stacked.groupBy(*names, "value").agg(F.count(F.lit(1)).alias("ties"))
    return running_total(counts, names, "value", "ties").select(*names, "value", "ties", "before", "total")


def view_lookup(df: DataFrame, positions: DataFrame, view: str, keys: Sequence[str], value: str, outputs: Mapping[str, Column]) -> DataFrame:
    """Join expressions over ties/before/total of one view of stacked_positions to the rows."""
    mine = positions.where(F.col("view") == view).select(
        *[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(keys))], F.col("value").alias("__value"), *[c.alias(name) for name, c in outputs.items()]
    )
    condition = F.col(value).cast(mine.schema["__value"].dataType).eqNullSafe(F.col("__value"))
    for i, k in enumerate(keys):
        condition = condition & F.col(k).cast("string").eqNullSafe(F.col(f"__k{i}"))
    return df.join(mine, condition).select(*df.columns, *outputs)


def rank_asc() -> Column:
    return (F.col("before") + 1).cast("bigint")


def rank_desc() -> Column:
    return (F.col("total") - F.col("before") - F.col("ties") + 1).cast("bigint")


def percent_rank() -> Column:
    """(rank - 1) / (rows - 1), 0 for a single row."""
    return F.coalesce(F.try_divide(F.col("before").cast("double"), (F.col("total") - 1).cast("double")), F.lit(0.0))


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, outputs: Mapping[str, Column]) -> DataFrame:
    """Join rank expressions (over ties/before/total) back to the rows."""
    return same_keys(df, position_lookup(df, keys, value, outputs), [*keys, value])


def global_percent_rank(df: DataFrame, value: str, name: str = "pct_rank") -> DataFrame:
    return with_ranks(df, [], value, {name: percent_rank()})


def _tile(position: Column, total: Column, n: int) -> Column:
    """Bucket number of a 1-based position among n near-equal tiles (larger ones first)."""
    base, extra = F.floor(total / F.lit(n)), total % n
    cutoff = extra * (base + 1)
    early = F.floor((position - 1) / (base + 1)) + 1
    late = extra + F.floor(F.try_divide(position - cutoff - 1, base)) + 1
    return F.when(position <= cutoff, early).otherwise(late).cast("bigint")


def assign_by_position(df: DataFrame, value: str, key: str, outputs: Mapping[str, Callable[[Column, Column], Column]],
                       source: DataFrame | None = None) -> DataFrame:
    """Step functions of the exact position among all rows ordered by (value, key).

    Each output maps (1-based position, row count) to a label that only changes at a few
    positions. A value whose rows all get the same labels needs no tiebreak; only the few
    values that straddle a change are ordered by key, again by range. Rows that repeat a value and
    key share the labels of the first of them. `source`
    may name a cheaper table with the same rows to count the values from.
    """
    total = F.col("total")
    first, last = F.col("before") + 1, F.col("before") + F.col("ties")
    straddles = F.lit(False)
    for label in outputs.values():
        straddles = straddles | (label(first, total) != label(last, total))
    helper = ["ties", "before", "total", "__straddles"]
    columns = {"ties": F.col("ties"), "before": F.col("before"), "total": total, "__straddles": straddles}
    placed = same_keys(df, position_lookup(df if source is None else source, [], value, columns), [value])

    whole = placed.where(~F.col("__straddles"))
    whole = whole.withColumns({name: label(first, total) for name, label in outputs.items()})

    split = placed.where("__straddles")
    tied = split.groupBy(value, key).agg(F.count(F.lit(1)).alias("__n"))
    ordered = running_total(tied, [value], key, "__n", "__tied_before", "__tied_total").select(value, key, "__tied_before")
    split = same_keys(split, ordered, [value, key])
    place = F.col("before") + F.col("__tied_before") + 1
    split = split.withColumns({name: label(place, total) for name, label in outputs.items()})
    return whole.drop(*helper).unionByName(split.drop(*helper, "__tied_before"))


def global_ntile(df: DataFrame, value: str, tiles: Mapping[str, int], key: str, source: DataFrame | None = None) -> DataFrame:
    """Exact n-tiles over all rows ordered by (value, key)."""
    return assign_by_position(
        df, value, key, {name: (lambda position, total, n=n: _tile(position, total, n)) for name, n in tiles.items()},
        source,
    )


def ordered_tiles(df: DataFrame, tiles: Mapping[str, tuple[str, int]], key: str) -> DataFrame:
    """n-tiles over all rows for several columns of numbers: name -> (column, n); every order is by (column, key).

    All orders are numbered in one range pass over (order, value, key); a row finds its tiles again by the key. Rows that repeat a key
    share the tiles of the first of them.
    """
    columns = sorted({column for column, _ in tiles.values()})
    kind = _common(df, columns)
    parts = [F.struct(F.lit(c).alias("view"), F.struct(F.col(c).isNull().alias("absent"), F.col(c).cast(kind).alias("value"), F.col(key).alias("key")).alias("place")) for c in columns]
    stacked = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*").groupBy("view", "place").agg(F.count(F.lit(1)).alias("__n"))
    ordered = running_total(stacked, ["view"], "place", "__n")
    found = [F.min(F.when(F.col("view") == column, _tile(F.col("before") + 1, F.col("total"), n))).alias(name) for name, (column, n) in tiles.items()]
    by_key = ordered.groupBy(F.col("place.key").alias("__key")).agg(*found)
    return df.join(by_key, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def top_fraction(df: DataFrame, value: str, fraction: float, key: str, name: str = "in_top") -> DataFrame:
    """Flag the highest floor(fraction * rows) rows by (value, key)."""
    return assign_by_position(
        df, value, key, {name: lambda position, total: position > total - F.floor(total * F.lit(fraction))}
    )


def deviation_from_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """value minus its group mean; the means are one row per group."""
    means = df.groupBy(*keys).agg(F.try_divide(F.sum(value).cast("double"), F.count(value)).alias("__mean"))
    joined = same_keys(df, means, list(keys))
    return joined.withColumn(name, F.col(value).cast("double") - F.col("__mean")).drop("__mean")


def median_over_partition(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Group median attached to every row."""
    from rosterlens.operators.grouping import exact_quantiles

    medians = exact_quantiles(df, keys, value, {name: 0.5})
    return same_keys(df, medians, list(keys), "left")


def compa_ratio_level_median(df: DataFrame, salary: str = "salary", level: str = "job_level",
                             name: str = "compa_ratio", digits: int | None = 4) -> DataFrame:
    """Salary over the median salary of the level; null where the median is zero."""
    from rosterlens.functions.numeric import round_half_up

    joined = median_over_partition(df, [level], salary, "level_median_salary")
    ratio = F.try_divide(col(salary).cast("double"), F.col("level_median_salary"))
    return joined.withColumn(name, ratio if digits is None else round_half_up(ratio, digits))


def cumulative_by_band(df: DataFrame, band: str, columns: Mapping[str, str]) -> DataFrame:
    """Running totals over an already aggregated, small set of ordered bands."""
    window = Window.orderBy(band).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.sum(source).over(window) for name, source in columns.items()})
