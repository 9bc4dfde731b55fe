"""Grouped sums, exact quantiles and shares that stay distributed under skew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.numeric import count_if, round_half_up, safe_divide
from rosterlens.operators.ranking import same_keys, value_positions

_FREQ = "__n"


def value_counts_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Row count per group and distinct value: the shuffle key includes the value, so a hot group is spread."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(_FREQ))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
                    distributed: bool | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, one column per name in `probs`.

    The quantiles are read off the positions of a running total over value ranges, so no task holds the values of a
    whole group. distributed=False takes them from value frequencies in one buffer, for columns with a fixed and small number of values.
    """
    if distributed is not False:
        return _quantiles_by_position(df, by, value, probs)
    counts = value_counts_by(df, by, value)
    return counts.groupBy(*by).agg(
        *[F.percentile(value, F.lit(float(p)), F.col(_FREQ)).alias(name) for name, p in probs.items()]
    )


def _quantiles_by_position(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    return quantiles_of_positions(value_positions(df.where(F.col(value).isNotNull()), by, value), by, value, probs)


def view_quantiles(positions: DataFrame, view: str, by: Sequence[str], probs: Mapping[str, float], more: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact quantiles of one view of ranking.stacked_positions (no null values in it), and aggregates over value and ties."""
    mine = positions.where(F.col("view") == view).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(by)], "value", "ties", "before", "total")
    return quantiles_of_positions(mine, by, "value", probs, more)


def quantiles_of_positions(placed: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], more: Mapping[str, Column] | None = None) -> DataFrame:
    """Interpolated quantiles per group from value positions, plus the aggregates `more`."""
    number = F.col(value).cast("double")

    def at(index: Column) -> Column:
        """Value at a 0-based position: exactly one row of the group covers it."""
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("ties")), number))

    aggregates, result = [], {}
    for i, (name, p) in enumerate(probs.items()):
        spot = (F.col("total") - 1) * F.lit(float(p))
        aggregates += [at(F.floor(spot)).alias(f"__lo{i}"), at(F.ceil(spot)).alias(f"__hi{i}"),
                       F.max(spot - F.floor(spot)).alias(f"__part{i}")]
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        result[name] = low + (high - low) * F.col(f"__part{i}")
    more = more or {}
    grouped = placed.groupBy(*by).agg(*aggregates, *[c.alias(name) for name, c in more.items()])
    return grouped.select(*by, *[c.alias(name) for name, c in result.items()], *more)


def grouped_sums(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column], quantile_of: str | None = None,
                 probs: Mapping[str, float] | None = None) -> DataFrame:
    """Sums per group plus, in the same pass over the rows, exact quantiles of one measure.

    Level one sums per (group, value); level two adds those up and takes the quantiles from
    the value frequencies. The input is scanned once and nothing is written, which suits measures with a limited
    range (pay in whole dollars); exact_quantiles takes any measure.
    """
    if quantile_of is None:
        return df.groupBy(*by).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    first = df.groupBy(*by, quantile_of).agg(
        F.count(F.lit(1)).alias(_FREQ), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    return first.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in sums],
        *[F.percentile(quantile_of, F.lit(float(p)), F.col(_FREQ)).alias(n) for n, p in (probs or {}).items()],
    )


def one(cond: Column) -> Column:
    """1 where the condition holds, else 0: a row expression to be summed."""
    return F.when(cond, 1).otherwise(0)


def when_value(cond: Column, value: Column | str) -> Column:
    return F.when(cond, F.col(value) if isinstance(value, str) else value)


def total_of(df: DataFrame, column: str) -> Column:
    """Grand total of an aggregated column as a scalar subquery (one row, no join)."""
    return df.select(F.sum(column)).scalar()


def share_of_total(df: DataFrame, count_col: str, by: Sequence[str] = (), name: str = "pct_of_total",
                   digits: int = 2) -> DataFrame:
    """Share of each aggregated row in the grand total or in its group's total."""
    if by:
        totals = df.groupBy(*by).agg(F.sum(count_col).alias("__total"))
        joined = same_keys(df, totals, list(by))
        return joined.withColumn(
            name, round_half_up(safe_divide(F.lit(100.0) * F.col(count_col), F.col("__total")), digits)
        ).drop("__total")
    return df.withColumn(
        name, round_half_up(safe_divide(F.lit(100.0) * F.col(count_col), total_of(df, count_col)), digits)
    )


def crosstab_count(df: DataFrame, row: str, column: str, name: str = "n") -> DataFrame:
    """Long-form cross tabulation."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias(name))


def crosstab_pct(df: DataFrame, row: str, column: str, name: str = "pct", digits: int = 2) -> DataFrame:
    """Cross tabulation normalised within each row category."""
    return share_of_total(crosstab_count(df, row, column), "n", [row], name, digits)


def value_counts(df: DataFrame, column: str, categories: Sequence | None = None, name: str = "n") -> DataFrame:
    """Counts per value; with a category list, in its order and zero-filled."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    if categories is None:
        return counts
    schema = f"{column} {df.schema[column].dataType.simpleString()}, sort_index int"
    wanted = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(categories, 1)], schema)
    return wanted.join(counts, column, "left").select(
        column, "sort_index", F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    )


def rate_matrix(df: DataFrame, row: str, column: str, cond: Column, values: Sequence[str], digits: int = 2) -> DataFrame:
    """Wide matrix of 100 x rate(cond): rows by `row`, one column per value of `column`."""
    cells = [
        round_half_up(
            safe_divide(F.lit(100.0) * count_if((F.col(column) == v) & cond), count_if(F.col(column) == v)), digits
        ).alias(slug(v))
        for v in values
    ]
    return df.groupBy(row).agg(*cells)


def slug(label: str) -> str:
    """Column name of a category label."""
    return "".join(ch if ch.isalnum() else "_" for ch in label.lower()).strip("_")


def having_min_team(df: DataFrame, n: int, size_col: str = "team_size") -> DataFrame:
    return df.where(F.col(size_col) >= n)
