"""Pre-aggregated summary tables and event-fact metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions import scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct, round_half_up, safe_divide
from rosterlens.operators.grouping import _FREQ, grouped_sums, one, quantiles_of_positions
from rosterlens.operators.hierarchy import rollup_counts
from rosterlens.operators.ranking import running_total, same_keys
from rosterlens.operators.sequence import next_row, previous_row
from rosterlens.plans.changes import scd2_from_history
from rosterlens.plans.rollups import ROWS, Rollup, partial_sums
from rosterlens.session import written_table

OVERALL = "Overall"


def headcount_rollup(by: Sequence[str]) -> Rollup:
    """Additive sums of headcount_monthly per month and segment."""
    known = lambda name: F.col(name).isNotNull().cast("int")
    scores_ = ("compa_ratio", "flight_risk_score", "engagement_score")
    return Rollup(("date_key", *by), {
        "n_active": F.col("is_active_flag").cast("int"), "fte": F.col("fte_value"), "tenure": F.col("tenure_months"), "n_tenure": known("tenure_months"),
        **{f"sum_{c}": F.col(c).cast("decimal(14,4)") for c in scores_}, **{f"n_{c}": known(c) for c in scores_},
    })


def headcount_from_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Head count, FTE and averages from the sums of headcount_rollup."""
    average = lambda c: safe_divide(F.col(f"sum_{c}"), F.col(f"n_{c}"))
    return sums.select(
        "date_key", *by, F.col(ROWS).alias("total_headcount"), F.col("n_active").alias("active_headcount"),
        round_half_up(F.col("fte").cast("double")).alias("fte_total"),
        round_half_up(safe_divide(F.col("tenure"), F.col("n_tenure"))).alias("avg_tenure_months"),
        round_half_up(average("compa_ratio"), 4).alias("avg_compa_ratio"),
        round_half_up(average("flight_risk_score")).alias("avg_flight_risk_score"),
        round_half_up(average("engagement_score")).alias("avg_engagement_score"),
    )


def headcount_spans(employees: DataFrame, by: Sequence[str]) -> DataFrame:
    """Employees of a segment with the same first and last month as one row, with the sums of headcount_rollup that no month changes.

    For employees of a monthly fact before their months multiply (`each` of employee_snapshot_fact). However many employees there are,
    the rows are at most segments x pairs of months. The dates become the first day of the hire month and the last of the exit month.
    """
    months = {"hire_date": F.trunc("hire_date", "MM"), "termination_date": F.last_day("termination_date")}
    sums = {n: x for n, x in headcount_rollup(by).sums.items() if n not in ("tenure", "n_tenure")}
    return partial_sums(employees.withColumns(months), Rollup((*by, *months, "employment_status_code"), sums))


def headcount_monthly(fact: DataFrame, by: Sequence[str]) -> DataFrame:
    """Head count, FTE and averages per month and segment (means of exact decimal sums).

    fact: one row per employee and month, or the months of headcount_spans.
    """
    rollup = headcount_rollup(by)
    if ROWS not in fact.columns:
        return headcount_from_sums(partial_sums(fact, rollup), by)
    # A span's tenure is that of each of its employees.
    fact = fact.withColumns({"tenure": F.col("tenure_months") * F.col(ROWS), "n_tenure": F.when(F.col("tenure_months").isNotNull(), F.col(ROWS))})
    sums = [F.sum(F.coalesce(F.col(n).cast(rollup.kind(n)), F.lit(0))).cast(rollup.kind(n)).alias(n) for n in (ROWS, *rollup.sums)]
    return headcount_from_sums(fact.groupBy(*rollup.keys).agg(*sums), by)


def attrition_rollup(by: Sequence[str], new_hire_days: int = 90) -> Rollup:
    """Additive counts of attrition_monthly per month and segment."""
    exits, voluntary = F.col("is_exit"), F.col("voluntary_exit_flag")
    kinds = {
        "total_separations": exits, "voluntary_separations": exits & voluntary, "involuntary_separations": exits & ~voluntary,
        "regrettable_separations": exits & (F.col("performance_rating") >= scores.HIGH_PERFORMER_RATING),
        "new_hire_90day_exits": exits & (F.datediff("termination_date", "hire_date") < new_hire_days),
        "opening": F.col("hire_date") < F.trunc("month_end", "MM"), "closing": ~exits,
    }
    return Rollup(("date_key", *by), {f"n_{name}": one(kind) for name, kind in kinds.items()})


def attrition_from_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Separations by kind and rates from the counts of attrition_rollup."""
    names = ("total_separations", "voluntary_separations", "involuntary_separations", "regrettable_separations", "new_hire_90day_exits")
    g = sums.select("date_key", *by, *[F.col(f"n_{c}").alias(c) for c in names], ((F.col("n_opening") + F.col("n_closing")) / 2.0).alias("avg_headcount_in_period"))
    rate = lambda name: F.coalesce(
        round_half_up(safe_divide(F.col(name), F.col("avg_headcount_in_period")), 6), F.lit(0.0))
    return g.withColumns({
        "voluntary_attrition_rate": rate("voluntary_separations"),
        "regrettable_attrition_rate": rate("regrettable_separations"),
    })


def attrition_monthly(fact: DataFrame, by: Sequence[str], new_hire_days: int = 90) -> DataFrame:
    """Separations by kind, early exits, mean of opening and closing head count, and rates per month and segment."""
    return attrition_from_sums(partial_sums(fact, attrition_rollup(by, new_hire_days)), by)


def source_quality_quarterly(hires: DataFrame, by: Sequence[str], weights: Sequence[float] = (0.35, 0.35, 0.30)) -> DataFrame:
    """Hires, days to fill, offer acceptance, 12-month retention and quality per quarter and channel.

    hires: hire_date, termination_date, days_to_fill, offer_accepted_flag, interview_score,
    performance_rating, engagement_score and the channel columns; with hire_cost also the cost per hire.
    """
    cost = {"hire_cost": round_half_up(mean(F.col("hire_cost").cast("decimal(18,2)"))).alias("cost_per_hire")} if "hire_cost" in hires.columns else {}
    kept = F.col("termination_date").isNull() | (F.col("termination_date") >= F.add_months("hire_date", 12))
    quarter = F.concat(F.year("hire_date").cast("string"), F.lit("-Q"), F.quarter("hire_date").cast("string"))
    perf_w, keep_w, eng_w = weights
    retention = safe_divide(count_if(kept), n_rows())
    return hires.groupBy(quarter.alias("quarter_key"), *by).agg(
        n_rows().alias("total_hires"),
        round_half_up(mean("days_to_fill")).alias("avg_days_to_fill"),
        round_half_up(safe_divide(count_if(F.col("offer_accepted_flag")), n_rows()), 4).alias("offer_acceptance_rate"),
        round_half_up(F.avg("interview_score")).alias("avg_interview_score"),
        round_half_up(retention, 4).alias("retention_12m_rate"),
        round_half_up(
            mean("performance_rating") / 5 * perf_w + retention * keep_w + mean("engagement_score") / 100 * eng_w, 4
        ).alias("quality_of_hire_score"),
        *cost.values(),
    )


# Two-sided 5% points of Student's t for 1 to 30 degrees of freedom.
T_POINTS = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def t_critical(df: Column, z: float = 1.959963984540054) -> Column:
    """Two-sided 5% point of Student's t: from the table up to 30 degrees of freedom (rounded down), beyond from the
    normal point (Cornish-Fisher expansion, exact to three digits there)."""
    few = F.element_at(F.array(*[F.lit(p) for p in T_POINTS]), F.greatest(F.floor(df), F.lit(1)).cast("int"))
    return F.when(df < len(T_POINTS) + 1, few).otherwise(
        F.lit(z)
        + F.lit((z**3 + z) / 4) / df
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (df * df)
    )


def comp_equity(employee: DataFrame, by: Sequence[str], gender: str = "gender", group: str = "ethnicity",
                salary: str = "salary", compa: str = "compa_ratio", baseline: str = "Male") -> DataFrame:
    """Pay statistics for every gender x group cell and their 'Overall' rows, against male pay of the same group.

    The four kinds of rows are made from (cell, salary) counts, so the exact medians of all levels come from
    one reduced table and one range pass. Significance is Welch's t at 5%.
    """
    counts = employee.groupBy(*by, gender, group, salary).agg(
        F.count(F.lit(1)).alias(_FREQ), F.sum(compa).alias("__compa")
    )
    cell = lambda g, e: F.struct(g.alias("gender_group"), e.alias("ethnicity_group"))
    whole = F.lit(OVERALL)
    cells = F.array(cell(F.col(gender), F.col(group)), cell(F.col(gender), whole), cell(whole, F.col(group)), cell(whole, whole))
    keys = [*by, "gender_group", "ethnicity_group"]
    counts = counts.select(*by, F.explode(cells).alias("__cell"), F.col(salary).alias("__pay"), _FREQ, "__compa").select(*by, "__cell.*", "__pay", _FREQ, "__compa")
    counts = counts.groupBy(*keys, "__pay").agg(F.sum(_FREQ).alias(_FREQ), F.sum("__compa").alias("__compa"))
    placed = running_total(counts.withColumn("ties", F.when(F.col("__pay").isNotNull(), F.col(_FREQ)).otherwise(0)), keys, "__pay", "ties")
    # Squares are taken around the overall mean, so that their sums do not cancel.
    pay, n = F.col("__pay").cast("double") - employee.select(F.avg(salary)).scalar(), F.col(_FREQ)
    cells = quantiles_of_positions(placed, keys, "__pay", {"median_base_salary": 0.5}, {
        "employee_count": F.sum(n), "__mean": safe_divide(F.sum(F.col("__pay") * n), F.sum(n)), "__squares": F.sum(pay * pay * n),
        "__shifted": F.sum(pay * n), "__compa_mean": safe_divide(F.sum("__compa"), F.sum(n)),
    })
    size = F.col("employee_count")
    cells = cells.withColumn(
        "__se2", F.try_divide((F.col("__squares") - F.col("__shifted") * F.col("__shifted") / size) / size, (size - 1).cast("double"))
    )
    male = cells.where(F.col("gender_group") == baseline).select(
        *by, "ethnicity_group", F.col("__mean").alias("__m"), F.col("__se2").alias("__mse2"), F.col("employee_count").alias("__mn")
    )
    joined = same_keys(cells, male, [*by, "ethnicity_group"], "left")
    gap = F.col("__m") - F.col("__mean")
    spread = F.col("__se2") + F.col("__mse2")
    t_value = F.abs(F.try_divide(gap, F.sqrt(spread)))
    freedom = F.try_divide(
        spread * spread,
        F.try_divide(F.col("__se2") * F.col("__se2"), (size - 1).cast("double"))
        + F.try_divide(F.col("__mse2") * F.col("__mse2"), (F.col("__mn") - 1).cast("double")),
    )
    return joined.select(
        *by, "gender_group", "ethnicity_group", "employee_count",
        round_half_up("__mean").alias("avg_base_salary"),
        "median_base_salary",
        round_half_up("__compa_mean", 4).alias("avg_compa_ratio"),
        round_half_up(F.lit(100.0) * safe_divide(gap, F.col("__m")), 4).alias("pay_gap_vs_male_pct"),
        round_half_up(gap).alias("pay_gap_amt"),
        F.coalesce(t_value > t_critical(freedom), F.lit(False)).alias("gap_is_significant_flag"),
    )


def controlled_pay_gap(employee: DataFrame, by: Sequence[str], strata: Sequence[str], salary: str = "salary") -> DataFrame:
    """Pay gap after controlling for the strata.

    Equals the gender coefficient of a least-squares fit with one fixed effect per stratum:
    stratum gaps weighted by n_male * n_female / (n_male + n_female).
    """
    male, female = F.col("gender") == "Male", F.col("gender") == "Female"
    cells = employee.groupBy(*by, *strata).agg(
        count_if(male).alias("m"), count_if(female).alias("f"),
        mean(salary, male).alias("mp"), mean(salary, female).alias("fp"),
    )
    weight = safe_divide(F.col("m") * F.col("f"), F.col("m") + F.col("f"), 0.0)
    weighted = cells.withColumn("w", weight).withColumn("g", F.coalesce((F.col("mp") - F.col("fp")) * weight, F.lit(0.0)))
    return weighted.groupBy(*by).agg(
        F.sum("m").alias("male_count"), F.sum("f").alias("female_count"),
        round_half_up(F.try_divide(F.sum("g"), F.sum("w"))).alias("controlled_gap_amt"),
    )


def adjusted_pay_gap(employee: DataFrame, by: Sequence[str], covariates: Mapping[str, Column], gender: str = "gender", salary: str = "salary",
                     baseline: str = "Male", other: str = "Female") -> DataFrame:
    """Pay gap of `other` against `baseline` with any number of numeric covariates held fixed, per group.

    Least squares with intercept from normal equations: all sums of products come from one aggregate, then intercept and covariates
    are swept out one by one in expressions over the group's row, which leaves the gender coefficient, its standard error and the residual
    degrees of freedom. A covariate that the others explain is left out. Rows with a null in any column of the fit take no part. Values are taken
    around their overall means, so that the sums do not cancel.
    """
    rows = employee.where(F.col(gender).isin(baseline, other)).select(
        *by, F.lit(1.0).alias("__v0"), (F.col(gender) == other).cast("double").alias("__v1"),
        *[c.cast("double").alias(f"__v{i + 2}") for i, c in enumerate(covariates.values())], F.col(salary).cast("double").alias("__vy"),
    ).dropna(subset=[f"__v{i + 2}" for i in range(len(covariates))] + ["__vy"])
    names = ["0", *[str(i + 2) for i in range(len(covariates))], "1", "y"]  # swept out in this order up to the last two
    centred = [n for n in names if n not in ("0", "1")]
    middle = rows.agg(*[F.coalesce(F.avg(f"__v{n}"), F.lit(0.0)).alias(n) for n in centred]).first()
    value = {n: F.col(f"__v{n}") - F.lit(middle[n]) if n in centred else F.col(f"__v{n}") for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    cell = lambda a, b: f"__{a}_{b}" if (a, b) in pairs else f"__{b}_{a}"
    sums = rows.groupBy(*by).agg(
        count_if(F.col("__v1") == 0).alias("male_count"), count_if(F.col("__v1") == 1).alias("female_count"),
        *[F.sum(value[a] * value[b]).alias(cell(a, b)) for a, b in pairs],
    ).withColumn("__rank", F.lit(1))
    for n in names[:-1]:
        sums = sums.withColumn(f"__whole_{n}", F.col(cell(n, n)))
    for k, pivot in enumerate(names[:-2]):
        left = names[k + 1 :]
        usable = F.col(cell(pivot, pivot)) > F.col(f"__whole_{pivot}") * 1e-9
        factor = {a: F.when(usable, F.col(cell(pivot, a)) / F.col(cell(pivot, pivot))).otherwise(F.lit(0.0)) for a in left}
        sums = sums.withColumns(
            {cell(a, b): F.col(cell(a, b)) - factor[a] * F.col(cell(pivot, b)) for i, a in enumerate(left) for b in left[i:]}
            | {"__rank": F.col("__rank") + usable.cast("int")}
        )
    told = F.col(cell("1", "1")) > F.col("__whole_1") * 1e-9
    slope = F.when(told, F.try_divide(F.col(cell("1", "y")), F.col(cell("1", "1"))))
    freedom = F.col("male_count") + F.col("female_count") - F.col("__rank")
    rest = F.greatest(F.col(cell("y", "y")) - slope * F.col(cell("1", "y")), F.lit(0.0))
    error = F.when(told & (freedom > 0), F.sqrt(F.try_divide(F.try_divide(rest, freedom.cast("double")), F.col(cell("1", "1")))))
    out = sums.select(*by, "male_count", "female_count", freedom.cast("bigint").alias("degrees_of_freedom"), slope.alias("__slope"), error.alias("__error"))
    return out.select(
        *by, "male_count", "female_count", "degrees_of_freedom", round_half_up(-F.col("__slope")).alias("adjusted_gap_amt"),
        round_half_up("__error").alias("std_error"),
        F.coalesce(F.abs(F.try_divide(F.col("__slope"), F.col("__error"))) > t_critical(F.col("degrees_of_freedom").cast("double")), F.lit(False)).alias("gap_is_significant_flag"),
    )


def training_rollup(by: Sequence[str], satisfaction: bool = False) -> Rollup:
    """Additive sums of training_compliance; the first of `by` is the month."""
    done, must = F.col("completion_flag"), F.col("is_mandatory_flag")
    flag = lambda c: one(c)
    return Rollup(tuple(by), {
        "n_done": flag(done), "n_done_must": flag(done & must), "n_must": flag(must), "n_overdue": flag(F.col("is_overdue_flag")),
        "score": F.when(done, F.col("assessment_score").cast("decimal(10,4)")), "n_score": flag(done & F.col("assessment_score").isNotNull()),
        "hours_done": F.when(done, F.col("hours").cast("decimal(18,2)")), "n_hours": flag(done & F.col("hours").isNotNull()),
        "cost_all": F.col("cost").cast("decimal(18,2)"), "n_cost": flag(F.col("cost").isNotNull()),
        **({"content": F.col("satisfaction_score").cast("decimal(10,4)"), "n_content": flag(F.col("satisfaction_score").isNotNull())} if satisfaction else {}),
    })


def training_from_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Enrolments, completions, compliance, scores, hours and cost from the sums of training_rollup."""
    some = lambda name, n: round_half_up(F.when(F.col(n) > 0, F.col(name)).cast("double"))
    return sums.select(
        *by, F.col(ROWS).alias("total_enrollments"), F.col("n_done").alias("completions"), F.col("n_done_must").alias("mandatory_completions"),
        F.col("n_must").alias("mandatory_total"), F.col("n_overdue").alias("overdue_count"),
        round_half_up(safe_divide(F.col("n_done_must"), F.col("n_must")), 4).alias("compliance_rate"),
        round_half_up(safe_divide(F.col("score"), F.col("n_score"))).alias("avg_assessment_score"),
        some("hours_done", "n_hours").alias("total_hours_completed"), some("cost_all", "n_cost").alias("total_cost"),
        *([round_half_up(safe_divide(F.col("content"), F.col("n_content"))).alias("avg_satisfaction_score")] if "content" in sums.columns else []),
    )


def training_compliance(training: DataFrame, by: Sequence[str]) -> DataFrame:
    """Enrolments, completions, mandatory compliance, overdue, scores, hours and cost.

    training: completion_flag, is_mandatory_flag, is_overdue_flag, assessment_score, hours, cost; with satisfaction_score also its mean.
    """
    return training_from_sums(partial_sums(training, training_rollup(by, "satisfaction_score" in training.columns)), by)


def funnel_metrics(stages: DataFrame, candidate: str, stage: str, entered: str, order: Sequence[str], first_stage: str) -> DataFrame:
    """Entries, candidates, mean hours in stage and conversion from the first stage.

    A stage lasts until the candidate's next entry; the newest entry is still open.
    """
    following = next_row(stages, [candidate], order, [entered], F.to_date(entered), "__next")
    seconds = F.unix_micros(F.col(f"__next.{entered}").cast("timestamp")) - F.unix_micros(F.col(entered).cast("timestamp"))
    per_candidate = following.groupBy(stage, candidate).agg(
        n_rows().alias("entries"), F.sum(seconds).alias("micros"), F.count("__next").alias("closed")
    )
    g = per_candidate.groupBy(stage).agg(
        F.sum("entries").alias("entries"), n_rows().alias("candidates"),
        round_half_up(safe_divide(F.sum("micros"), F.sum("closed")) / F.lit(3.6e9)).alias("avg_hours_in_stage"),
    )
    base = g.where(F.col(stage) == first_stage).select("candidates").scalar()
    return g.withColumn("conversion_pct", pct(F.col("candidates"), base))


def ordered_funnel(events: DataFrame, candidate: str, stage: str, entered: str, stages: Sequence[str]) -> DataFrame:
    """Candidates who went through the stages in order: a stage counts only after the stage before.

    A chain of conditional minima: a candidate reaches a stage with the first entry later than the one that reached the stage before.
    Each link is an aggregate that is combined before its shuffle, so a candidate with very many entries stays small.
    Null candidates, stages or times reach nothing.
    """
    known = events.where(F.col(candidate).isNotNull() & F.col(entered).isNotNull()).select(F.col(candidate).alias("__who"), F.col(stage).alias("__stage"), F.col(entered).alias("__at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    parts, reached = [], None
    for place, name in enumerate(stages, 1):
        here = known.where(F.col("__stage") == name)
        if reached is None:
            reached = here.groupBy("__who").agg(F.min("__at").alias("__reached"), F.lit(None).cast("bigint").alias("__waited"))
        else:
            before = reached.select("__who", F.col("__reached").alias("__before"))
            later = here.join(before, "__who").where("__at > __before").groupBy("__who", "__before").agg(F.min("__at").alias("__reached"))
            reached = later.select("__who", "__reached", (micros("__reached") - micros("__before")).alias("__waited"))
        reached = written_table(reached, "funnel")  # one row per candidate; the next stage and the report read it
        parts.append(reached.agg(n_rows().alias("candidates"), F.sum("__waited").alias("__micros")).select(F.lit(place).alias("position"), F.lit(name).alias("stage"), "candidates", "__micros"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    rows = report.collect()  # one row per stage
    counts = {0: rows[0]["candidates"], **{r["position"]: r["candidates"] for r in rows}}
    first, previous = F.lit(counts[1]), F.element_at(F.array(*[F.lit(counts[max(k - 1, 1)]) for k in range(1, len(stages) + 1)]), F.col("position"))
    hours = round_half_up(safe_divide(F.col("__micros"), F.col("candidates")) / F.lit(3.6e9))
    return report.select(
        "position", "stage", "candidates", pct(F.col("candidates"), first).alias("conversion_pct"),
        pct(F.col("candidates"), previous).alias("step_conversion_pct"), hours.alias("avg_hours_from_previous"),
    )


def attendance_metrics(attendance: DataFrame, by: Sequence[str], standard_hours: float = 8.0) -> DataFrame:
    """Hours, overtime, unplanned absence and lateness per group.

    attendance: hours_worked, unplanned_absence_flag, late_minutes.
    """
    hours = F.col("hours_worked").cast("decimal(18,2)")
    over = F.greatest(hours - F.lit(standard_hours).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return attendance.groupBy(*by).agg(
        n_rows().alias("records"),
        round_half_up(F.sum(hours).cast("double")).alias("hours_worked"),
        round_half_up(F.sum(over).cast("double")).alias("hours_overtime"),
        count_if(F.col("unplanned_absence_flag")).alias("unplanned_absences"),
        pct(count_if(F.col("unplanned_absence_flag")), n_rows()).alias("unplanned_absence_pct"),
        count_if(F.col("late_minutes") > 0).alias("late_arrivals"),
        F.sum("late_minutes").alias("late_minutes"),
    )


def compensation_changes(pay: DataFrame, key: str, order: Sequence[str], salary: str) -> DataFrame:
    """Previous and new salary, change, end date and current flag of every pay event.

    order[0] is the effective date; histories are cut into months, so one long history does
    not end up in one task.
    """
    month = F.trunc(F.col(order[0]), "MM")
    seen = previous_row(pay, [key], order, [salary], month, "__prev")
    seen = next_row(seen, [key], order, [order[0]], month, "__next")
    new, prev = F.col(salary).cast("double"), F.col(f"__prev.{salary}").cast("double")
    return seen.select(
        *pay.columns,
        prev.alias("previous_salary"),
        round_half_up(new - prev).alias("change_amt"),
        round_half_up(F.lit(100.0) * safe_divide(new - prev, prev), 4).alias("change_pct"),
        F.col(f"__next.{order[0]}").alias("end_date"),
        F.col("__next").isNull().alias("is_current"),
    )


def manager_dimension(employee: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Per manager: direct and total reports, span, effectiveness, rolling exit rate, team means, promotion rate.

    employee carries termination_date and voluntary_exit_flag; voluntary exits count when dated in the `months` before as_of.
    """
    day = F.lit(as_of).cast("date")
    recent = F.coalesce("voluntary_exit_flag", F.lit(False)) & (F.col("termination_date") > F.add_months(day, -months)) & (
        F.col("termination_date") <= day)
    sums = {
        "n": F.lit(1), "eng": F.col("engagement_score"), "perf": F.col("performance_rating"), "active": one(scores.is_active()),
        "high": one(scores.is_high_performer()), "promoted": one(F.col("promotions") >= 1), "exits": one(recent),
    }
    teams = grouped_sums(employee.where(F.col("manager_id").isNotNull()), ["manager_id"], sums)
    reach = rollup_counts(employee.select("employee_id", "manager_id")).withColumnRenamed("employee_id", "manager_id")
    n = F.col("n")
    share = lambda c: safe_divide(F.col(c), n)
    names = employee.select(
        F.col("employee_id").alias("manager_id"), F.col("employee_name").alias("full_name"),
        F.col("department"), F.col("job_level").alias("management_level"),
    )
    return teams.join(reach, "manager_id").join(names, "manager_id").select(
        "manager_id", "full_name", "department", "management_level", "direct_report_count", "total_org_size", "span_of_control_ratio",
        round_half_up(
            share("eng") * 0.40 + F.lit(100.0) * share("active") * 0.40 + F.lit(100.0) * share("high") * 0.20
        ).alias("manager_effectiveness_score"),
        round_half_up(share("exits"), 4).alias("team_exit_rate_rolling"),
        round_half_up(share("eng")).alias("team_engagement_avg"),
        round_half_up(share("perf")).alias("team_performance_avg"),
        round_half_up(share("promoted"), 4).alias("promotion_rate_of_team"),
    )


def manager_months(fact: DataFrame, months: int = 12) -> DataFrame:
    """Manager x month end: team, rolling voluntary exits and exit rate, team engagement, months as a manager.

    fact: the monthly snapshot with manager_id. Rows are summed per manager and month first (combined before the shuffle), a manager's gaps are
    filled up to its next month, and the sliding sums run over one row per manager and month; both on one dealing by manager. The rate relates the exits of the
    last `months` months to the mean team of these months.
    """
    number = F.year("month_end") * 12 + F.month("month_end")
    left = F.col("is_exit")
    cells = fact.where(F.col("manager_id").isNotNull()).groupBy("manager_id", number.alias("month")).agg(
        count_if(~left).alias("team"), count_if(left & F.col("voluntary_exit_flag")).alias("exits"),
        F.sum(F.col("engagement_score").cast("decimal(14,4)")).alias("score"), F.count("engagement_score").alias("scored"),
    )
    history = Window.partitionBy("manager_id").orderBy("month")
    until = F.coalesce(F.lead("month").over(history) - 1, "month")
    spine = cells.withColumns({"first": F.first("month").over(history), "last": until}).withColumn("at", F.explode(F.sequence("month", "last")))
    own = F.col("at") == F.col("month")  # the months after, up to the next of the manager's, have no team
    filled = spine.select(
        "manager_id", "first", F.col("at").alias("month"), *[F.when(own, F.col(c)).otherwise(0).alias(c) for c in ("team", "exits")],
        *[F.when(own, F.col(c)).alias(c) for c in ("score", "scored")],
    )
    recent = Window.partitionBy("manager_id").orderBy("month").rangeBetween(1 - months, 0)
    end = F.last_day(F.make_date(F.floor((F.col("month") - 1) / 12).cast("int"), (F.pmod(F.col("month") - 1, F.lit(12)) + 1).cast("int"), F.lit(1)))
    return filled.withColumns({"exits_rolling": F.sum("exits").over(recent), "team_sum": F.sum("team").over(recent), "n": F.count(F.lit(1)).over(recent)}).select(
        "manager_id", end.alias("month_end"), F.col("team").alias("team_size"), "exits_rolling",
        round_half_up(safe_divide(F.col("exits_rolling"), F.try_divide(F.col("team_sum").cast("double"), F.col("n")), None), 4).alias("exit_rate_rolling"),
        round_half_up(safe_divide(F.col("score"), F.col("scored"))).alias("team_engagement_avg"),
        (F.col("month") - F.col("first")).cast("bigint").alias("tenure_as_manager_months"),
    )


def manager_versions(monthly: DataFrame, columns: Sequence[str] = ("team_size", "exit_rate_rolling")) -> DataFrame:
    """Versions of a manager's figures: month ends on which all `columns` stay the same are one version."""
    # Several branches read them; the snapshot below is summed once.
    monthly = written_table(monthly.select("manager_id", "month_end", *columns), "monthly")
    out = scd2_from_history(monthly, "manager_id", ["month_end"], columns, F.year("month_end"))
    return out.withColumnsRenamed({"effective_start": "effective_start_date", "effective_end": "effective_end_date"})


def performance_metrics(reviews: DataFrame, cycle: str, rating: str, group: str, goals: tuple[str, str] | None = None) -> DataFrame:
    """Rating scaled to 0-1 within its cycle, distance from the cycle x group mean, and the improvement-plan flag.

    Cycle statistics are one row per cycle and group; null cycles and groups are groups. `goals` names the columns with the goals
    met and set, for goal_achievement_pct.
    """
    achieved = [] if goals is None else [pct(F.col(goals[0]), F.col(goals[1])).alias("goal_achievement_pct")]
    cells = reviews.groupBy(cycle, group).agg(
        mean(rating).alias("__mean"), F.min(rating).alias("__lo"), F.max(rating).alias("__hi")
    )
    span = cells.groupBy(cycle).agg(F.min("__lo").alias("__min"), F.max("__hi").alias("__max"))
    lookup = same_keys(cells, span, [cycle]).select(cycle, group, "__mean", "__min", "__max")
    joined = same_keys(reviews, lookup, [cycle, group])
    return joined.select(
        *reviews.columns,
        round_half_up(
            safe_divide(F.col(rating) - F.col("__min"), F.col("__max") - F.col("__min"), 0.0), 4
        ).alias("rating_normalized"),
        round_half_up(F.col(rating).cast("double") - F.col("__mean"), 4).alias("calibration_delta"),
        (F.col(rating) == 1).alias("pip_flag"),
        *achieved,
    )
