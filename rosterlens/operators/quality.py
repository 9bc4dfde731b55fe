"""Data-quality checks. Every check yields rows (check_name, value, expected, passed)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions.numeric import count_if, round_half_up
from rosterlens.operators.joins import anti_join_orphans
from rosterlens.operators.reshape import stack_rows, union_all

# Columns of the flat extract.
FLAT_COLUMNS = (
    "Employee_ID", "Employee_Name", "Age", "Gender", "Department", "Job_Role", "Job_Level", "Manager_ID", "Location",
    "Work_Mode", "Years_At_Company", "Salary", "Bonus", "Recruitment_Source", "Performance_Rating",
    "Performance_Label", "Attendance_Pct", "Training_Hours", "Engagement_Score", "Satisfaction_Score", "Promotions",
    "Leave_Count", "Attrition", "Exit_Reason",
)


def range_rule(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Violation condition of an inclusive range; null is a violation."""
    value = F.col(column)
    bad = value.isNull()
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return bad


def domain_rule(column: str, allowed: Sequence) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(list(allowed))


def employee_domain_rules() -> dict[str, Column]:
    """Accepted ranges and domains of the employee table, as violation conditions."""
    # Fixed values.
    return {
        "age": range_rule("age", 16, 80),
        "gender": domain_rule("gender", ["Male", "Female", "Non-binary"]),
        "work_mode": domain_rule("work_mode", ["On-site", "Hybrid", "Remote"]),
        "job_level": domain_rule("job_level", [f"L{i}" for i in range(1, 9)]),
        "years_at_company": range_rule("years_at_company", 0),
        "salary": range_rule("salary", 30_000, 2_000_000),
        "bonus": range_rule("bonus", 0),
        "performance_rating": range_rule("performance_rating", 1, 5),
        "attendance_pct": range_rule("attendance_pct", 0, 100),
        "training_hours": range_rule("training_hours", 0),
        "engagement_score": range_rule("engagement_score", 0, 100),
        "satisfaction_score": range_rule("satisfaction_score", 0, 100),
        "promotions": range_rule("promotions", 0),
        "leave_count": range_rule("leave_count", 0, 365),
        "attrition": domain_rule("attrition", ["Yes", "No"]),
    }

def employee_completeness_rules() -> dict[str, Column]:
    return {
        "null_names": F.col("employee_name").isNull() | (F.col("employee_name") == ""),
        "bad_salaries": F.col("salary").isNull() | (F.col("salary") <= 0),
        "bad_attrition_flag": F.col("attrition").isNull() | ~F.col("attrition").isin("Yes", "No"),
        "attrited_missing_reason": (F.col("attrition") == "Yes") & F.col("exit_reason").isNull(),
        "active_with_reason": (F.col("attrition") == "No") & F.col("exit_reason").isNotNull(),
    }


def _zero_checks(df: DataFrame, violations: Mapping[str, Column]) -> DataFrame:
    """Violation counts of all rules in one scan; a rule passes with none."""
    wide = df.agg(*[count_if(cond).alias(name) for name, cond in violations.items()])
    return stack_rows(wide, [_row(name, F.col(name), "0", F.col(name) == 0) for name in violations])


def _row(name: str, value: Column, expected: str, passed: Column) -> dict[str, Column]:
    return {
        "check_name": F.lit(name), "value": value.cast("double"), "expected": F.lit(expected),
        "passed": F.coalesce(passed, F.lit(False)),
    }


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    frames = []
    for name, df in tables.items():
        wide = df.agg(F.count(F.lit(1)).alias("n"))
        frames.append(stack_rows(wide, [_row(name, F.col("n"), str(expected[name]), F.col("n") == expected[name])]))
    return union_all(frames)


def view_counts(views: Mapping[str, DataFrame], low: Mapping[str, int]) -> DataFrame:
    """Views resolve and return at least the given number of rows."""
    frames = []
    for name, df in views.items():
        wide = df.agg(F.count(F.lit(1)).alias("n"))
        frames.append(stack_rows(wide, [_row(name, F.col("n"), f">= {low[name]}", F.col("n") >= low[name])]))
    return union_all(frames)


def orphans(df: DataFrame, references: Mapping[str, tuple[str, DataFrame, str]], self_key: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose foreign key has no target; references: name -> (fk, dim, pk)."""
    frames = []
    for name, (fk, dim, pk) in references.items():
        missing = anti_join_orphans(df, dim, fk, pk).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        frames.append(stack_rows(missing, [_row(name, F.col("n"), "0", F.col("n") == 0)]))
    if self_key is not None:
        node, parent = self_key
        frames.append(_zero_checks(df, {"self_managing_employee": F.col(node) == F.col(parent)}))
    return union_all(frames)


def completeness(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    return _zero_checks(df, rules or employee_completeness_rules())


def domain_ranges(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    rules = rules or employee_domain_rules()
    return _zero_checks(df, {f"{name}_out_of_domain": cond for name, cond in rules.items()})


def unique_key(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Number of key values that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wide = repeated.agg(F.count(F.lit(1)).alias("n"))
    return stack_rows(wide, [_row(name or f"unique_{'_'.join(keys)}", F.col("n"), "0", F.col("n") == 0)])


def columns_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per expected column: present or not, with its number of filled rows."""
    have = set(df.columns)
    wide = df.agg(*[(F.count(c) if c in have else F.lit(0)).cast("bigint").alias(c) for c in columns])
    return stack_rows(wide, [
        {**_row(c, F.lit(1.0 if c in have else 0.0), "1", F.lit(c in have)), "filled_rows": F.col(c)} for c in columns
    ])


def sanity_bands(df: DataFrame, bands: Mapping[str, tuple[Column, float, float]], digits: int = 4) -> DataFrame:
    """Aggregates expected inside [low, high], all from one scan."""
    wide = df.agg(*[round_half_up(expr, digits).alias(name) for name, (expr, _, _) in bands.items()])
    return stack_rows(
        wide,
        [_row(name, F.col(name), f"{low}..{high}", F.col(name).between(low, high)) for name, (_, low, high) in bands.items()],
    )


def monotonic(groups: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Value must not fall along the order; the input is one row per group."""
    steps = groups.withColumn("__prev", F.lag(value).over(Window.orderBy(order)))
    wide = steps.agg(count_if(F.col(value) < F.col("__prev")).alias("n"))
    return stack_rows(wide, [_row(name, F.col("n"), "0", F.col("n") == 0)])


def partition_sums(df: DataFrame, parts: Mapping[str, Column], name: str) -> DataFrame:
    """The parts must cover every row exactly once."""
    counts = [count_if(cond) for cond in parts.values()]
    covered = counts[0]
    for one in counts[1:]:
        covered = covered + one
    wide = df.agg(covered.alias("covered"), F.count(F.lit(1)).alias("n"))
    return stack_rows(wide, [_row(name, F.col("covered") - F.col("n"), "0", F.col("covered") == F.col("n"))])


def score_consistency(scored: DataFrame, tiers: Sequence[str] = ("Low", "Medium", "High", "Critical"),
                      tolerance: float = 0.5) -> DataFrame:
    score, prob = F.col("risk_score"), F.col("model_probability")
    return _zero_checks(scored, {
        "score_outside_0_100": range_rule("risk_score", 0, 100),
        "probability_outside_0_1": range_rule("model_probability", 0, 1),
        "score_probability_mismatch": F.abs(score - prob * 100) >= tolerance,
        "missing_drivers": F.col("top_drivers").isNull() | (F.length("top_drivers") == 0),
        "unknown_tier": domain_rule("risk_tier", tiers),
    })


def cohort_contrast(df: DataFrame, cohort: Column, outcome: Column, group: str, min_std: float = 0.02) -> DataFrame:
    """Cohort rate above the overall rate, cohort subset of the total, and group rates that differ."""
    rate = F.avg(F.when(outcome, 1.0).otherwise(0.0))
    overall = df.agg(
        rate.alias("all"), F.avg(F.when(cohort, F.when(outcome, 1.0).otherwise(0.0))).alias("cohort"),
        count_if(cohort & outcome).alias("both"), count_if(outcome).alias("out"),
    )
    spread = df.groupBy(group).agg(rate.alias("r")).agg(F.stddev_samp("r").alias("s"))
    return union_all([
        stack_rows(overall, [
            _row("cohort_rate_minus_overall", round_half_up(F.col("cohort") - F.col("all"), 6), "> 0", F.col("cohort") > F.col("all")),
            _row("cohort_exits_minus_total_exits", F.col("both") - F.col("out"), "<= 0", F.col("both") <= F.col("out")),
        ]),
        stack_rows(spread, [_row("group_rate_stddev", round_half_up(F.col("s"), 6), f"> {min_std}", F.col("s") > min_std)]),
    ])
