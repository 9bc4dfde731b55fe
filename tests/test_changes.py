"""Upsert, change log, versions, publishing and streaming loads."""

import datetime
import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rosterlens.plans import changes, facts, medallion, storing, summaries
from rosterlens.session import scratch_path
from rosterlens.sources import files, seeds
from rosterlens.streaming import incremental

SCHEMA = "id int, pay int, note string, name string"


def state(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_upsert_updates_listed_columns_inserts_and_counts(spark):
    old = state(spark, (1, 10, "a", "A"), (2, 20, None, "B"), (3, 30, "c", "C"))
    new = state(spark, (1, 10, "changed", "X"), (2, 20, "now set", "Y"), (4, 40, "d", "D"))
    out = changes.upsert(old, new, "id", compare=["pay"], update=["pay", "note"])
    assert as_set(out, "id", "pay", "note", "name", "action") == {
        (1, 10, "a", "A", "unchanged"), (2, 20, None, "B", "unchanged"), (3, 30, "c", "C", "unchanged"), (4, 40, "d", "D", "insert")}
    out = changes.upsert(old, new, "id", compare=["pay", "note"], update=["pay", "note"])
    assert (2, "now set", "B", "update") in as_set(out, "id", "note", "name", "action")
    assert changes.upsert_counts(out).first().asDict() == {"rows_inserted": 1, "rows_updated": 2, "rows_unchanged": 1}
    again = changes.upsert(out.drop("action"), new, "id", compare=["pay", "note"], update=["pay", "note"])
    assert changes.upsert_counts(again).first().rows_unchanged == 4


def test_change_log_sees_null_transitions(spark):
    old = state(spark, (1, 10, None, "A"), (2, 20, "b", "B"), (3, 1, "x", "C"))
    new = state(spark, (1, 11, "set", "A"), (2, 20, None, "B"), (9, 1, "x", "Z"))
    log = changes.change_log(old, new, "id", ["pay", "note"])
    assert as_set(log, "id", "changed_column", "old_value", "new_value") == {
        (1, "pay", "10", "11"), (1, "note", None, "set"), (2, "note", "b", None)}
    assert changes.change_log(new, new, "id", ["pay", "note"]).count() == 0


def test_scd2_opens_closes_deletes_and_returns(spark):
    check = ["pay", "note"]
    versions = lambda df: as_set(df, "id", "pay", "scd_version", "is_current_flag", "effective_end_date")
    d1, d2, d3 = "2024-01-01", "2024-02-01", "2024-03-01"
    day = lambda s: datetime.date.fromisoformat(s)
    dim = changes.scd2_initial(state(spark, (1, 10, "a", "A"), (2, 20, None, "B"), (3, 30, "c", "C")), d1)
    second = state(spark, (1, 10, "a", "renamed"), (2, 20, "set", "B"), (4, 40, "d", "D"))
    dim = changes.scd2_snapshot(dim, second, "id", check, d2)
    assert versions(dim) == {
        (1, 10, 1, True, None), (2, 20, 1, False, day(d2)), (2, 20, 2, True, None), (3, 30, 1, False, day(d2)), (4, 40, 1, True, None)}
    assert versions(changes.scd2_snapshot(dim, second, "id", check, d3)) == versions(dim)
    third = second.unionByName(state(spark, (3, 33, "c", "C")))
    back = changes.scd2_snapshot(dim, third, "id", check, d3)
    assert (3, 33, 2, True, None) in versions(back) and back.where("id = 3").count() == 2
    kept = changes.scd2_snapshot(changes.scd2_initial(second, d1), state(spark, (1, 10, "a", "A")), "id", check, d2, keep_deleted=True)
    assert kept.where("is_current_flag").count() == 3


def test_as_of_version_join_picks_the_valid_version(spark):
    versions = spark.createDataFrame(
        [("a", "2024-01-01", "2024-02-01", "v1"), ("a", "2024-02-01", None, "v2")], "k string, s string, e string, v string"
    ).select("k", F.col("s").cast("date").alias("effective_start_date"), F.col("e").cast("date").alias("effective_end_date"), "v")
    fact = spark.createDataFrame([("a", "2024-01-31"), ("a", "2024-02-01"), ("b", "2024-02-01")], "k string, d string").withColumn("d", F.to_date("d"))
    got = facts.as_of_version_join(fact, versions, "k", "d", ["v"])
    assert as_set(got, "k", "v") == {("a", "v1"), ("a", "v2"), ("b", None)}


def test_snapshot_fact_months(spark):
    day = datetime.date
    staff = spark.createDataFrame([
        (1, day(2023, 11, 30), None, "Active", 1.0),
        (2, day(2024, 2, 29), day(2024, 4, 1), "Terminated", None),
        (3, day(2024, 9, 1), None, "Active", 1.0),
    ], "employee_id int, hire_date date, termination_date date, employment_status_code string, fte_value double")
    fact = facts.employee_snapshot_fact(staff, "2024-01-01", "2024-05-31")
    got = as_set(fact, "employee_id", "date_key", "tenure_months", "is_exit")
    assert got == {(1, k, m, False) for k, m in ((20240131, 2), (20240229, 3), (20240331, 4), (20240430, 5), (20240531, 6))} | {
        (2, 20240229, 0, False), (2, 20240331, 1, False), (2, 20240430, 2, True)}
    late = facts.employee_snapshot_fact(staff, "2024-01-01", "2024-05-31", since="2024-03-31")
    assert {r.date_key for r in late.collect()} == {20240430, 20240531}


def test_attributes_are_joined_before_months_multiply(spark):
    """The view of the fact and the fact of the view are the same rows; the second joins one row per employee."""
    day = datetime.date
    staff = spark.createDataFrame([
        (1, "L2", None, day(2023, 11, 30), None, "Active", 1.0), (2, "L3", 1, day(2024, 2, 29), day(2024, 4, 1), "Terminated", None),
        (3, "L2", 1, day(2024, 4, 9), None, "Active", None), (4, "L9", 1, day(2024, 1, 1), None, "Active", 1.0), (5, "L3", 9, day(2024, 5, 1), None, None, 1.0),
        (6, "L3", 9, None, None, "Active", 1.0),
    ], "employee_id int, job_level string, manager_id int, hire_date date, termination_date date, employment_status_code string, fte_value double")
    levels = spark.createDataFrame([("L2", "Two"), ("L3", "Three")], "job_level string, level_name string")
    managers = spark.createDataFrame([(1, "Ann"), (1, "Anne")], "manager_id int, manager_name string")
    view = lambda df: facts.current_employees_view(df, {"job_level": levels}, managers)
    before = facts.employee_snapshot_fact(staff, "2024-01-01", "2024-05-31", each=view)
    columns = ["employee_id", "date_key", "tenure_months", "fte_value", "level_name", "manager_name"]
    want = view(facts.employee_snapshot_fact(staff, "2024-01-01", "2024-05-31")).select(columns)
    assert sorted(map(str, before.select(columns).collect())) == sorted(map(str, want.collect())) and want.count() == 14
    plan = before._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_headcount_of_spans_equals_headcount_of_months(spark):
    """Employees of a segment with the same months multiply once, and every figure is as if each had multiplied alone."""
    rng, day = random.Random(3), datetime.date
    people = []
    for i in range(400):
        hired = None if i % 50 == 0 else day(2023, 11, 1) + datetime.timedelta(rng.randrange(200))
        left = hired + datetime.timedelta(rng.randrange(-20, 120)) if hired and i % 3 == 0 else None
        people.append((i, "ab"[i % 2] if i % 7 else None, hired, left, None if i % 61 == 0 else "Terminated" if left else "Active", rng.choice([None, 0.5, 1.0]),
                       rng.choice([None, 0.07, 0.1]), rng.choice([None, 12.34567]), rng.choice([None, 55.5])))
    staff = spark.createDataFrame(people, "employee_id int, department string, hire_date date, termination_date date, employment_status_code string, fte_value double, "
                                  "compa_ratio double, flight_risk_score double, engagement_score double")
    staff = staff.unionByName(staff.where("employee_id < 20"))  # rows may repeat
    fact = lambda each=None: facts.employee_snapshot_fact(staff, "2024-01-01", "2024-08-31", each=each)
    spans = fact(lambda df: summaries.headcount_spans(df, ["department"]))
    want, got = (summaries.headcount_monthly(df, ["department"]) for df in (fact(), spans))
    assert got.dtypes == want.dtypes and want.count() == 24
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spans.count() < fact().count() / 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate"):]


def test_incremental_filter_with_empty_target(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "t int")
    assert medallion.incremental_filter(rows, rows.where("t < 0"), "t").count() == 3
    assert medallion.incremental_filter(rows, rows.where("t <= 2"), "t").count() == 1


def test_publish_switches_versions_and_clustered_write(spark):
    root = scratch_path(spark, "published")
    first, second = state(spark, (1, 1, "a", "A")), state(spark, (1, 2, "b", "A"))
    assert storing.current_version(spark, root) == 0
    assert (storing.publish(first, root), storing.publish(second, root)) == (1, 2)
    assert storing.read_current(spark, root).first().pay == 2
    path = scratch_path(spark, "clustered")
    storing.write_clustered(first.unionByName(second.withColumn("id", F.lit(2))), path, ["id"], ["pay"])
    storing.write_clustered(state(spark, (2, 9, "z", "Z")), path, ["id"], ["pay"])
    assert as_set(spark.read.parquet(path), "id", "pay") == {(1, 1), (2, 9)}


def test_csv_round_trip_corrupt_rows_and_missing_scores(spark):
    path = scratch_path(spark, "csv")
    header = "Employee_ID,Age,Exit_Reason"
    spark.createDataFrame([(header,), ("E1,30,",), ("E2,old,pay",)], "value string").coalesce(1).write.text(path)
    schema = "Employee_ID string, Age int, Exit_Reason string"
    loaded = files.read_hr_csv(spark, path, schema, keep_corrupt=True).cache()
    assert as_set(loaded, "Employee_ID", "Age", "Exit_Reason") == {("E1", 30, None), ("E2", None, "pay")}
    assert loaded.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        files.read_hr_csv(spark, path, schema).collect()
    absent = files.read_predictions(spark, scratch_path(spark, "nothing"))
    assert absent.count() == 0 and "Risk_Score" in absent.columns


def test_resolve_keys_and_rejects_partition_the_staging_rows(spark):
    staging = spark.createDataFrame(
        [(1, "Sales", "Austin, TX", "Indeed", "", "N/A"), (2, "Sailing", "Austin, TX", "Indeed", "E1", "pay"), (3, "Sales", "Austin, TX", "Fax", "E1", None)],
        "employee_id int, department string, location string, recruitment_source string, manager_id string, exit_reason string")
    dims = seeds.departments(spark), seeds.locations(spark), seeds.recruitment_sources(spark)
    kept = files.resolve_keys(staging, *dims).collect()
    assert [(r.employee_id, r.manager_id, r.exit_reason, r.department_id) for r in kept] == [(1, None, None, 3)]
    assert as_set(files.rejected_rows(staging, *dims), "employee_id", "rejected_for") == {(2, "department"), (3, "recruitment_source")}


def test_stream_applies_each_delivery_once(spark):
    folder, root, log, checkpoint = (scratch_path(spark, n) for n in ("in", "state", "log", "cp"))
    handler = incremental.apply_changes(root, "id", ["pay"], ["note"], log)
    schema = state(spark, (1, 1, "a", "A")).schema
    for rows in ([(1, 1, "a", "A"), (1, 2, "b", "A"), (2, 1, "x", "B")], [(1, 3, "c", "A"), (3, 1, "n", "C")]):
        state(spark, *rows).write.mode("append").parquet(folder)
        incremental.stream_changes(incremental.file_stream(spark, folder, schema), handler, checkpoint)
    incremental.stream_changes(incremental.file_stream(spark, folder, schema), handler, checkpoint)
    handler(state(spark, (1, 3, "c", "A"), (3, 1, "n", "C")), 1)  # a replay of the second batch
    assert as_set(storing.read_current(spark, root), "id", "note") == {(1, "c"), (2, "x"), (3, "n")}
    assert as_set(spark.read.parquet(log), "id", "old_value", "new_value") == {(1, "b", "c")}


def test_welch_flag_and_overall_rows(spark):
    rows = [("d", "Male", "x", 100 + i % 5) for i in range(60)] + [("d", "Female", "x", 80 + i % 5) for i in range(60)] + [("d", "Female", "y", 100)]
    df = spark.createDataFrame(rows, "department string, gender string, ethnicity string, salary int").withColumn("compa_ratio", F.lit(1.0))
    got = {(r.gender_group, r.ethnicity_group): r for r in summaries.comp_equity(df, ["department"]).collect()}
    assert got[("Female", "x")].gap_is_significant_flag and got[("Female", "x")].pay_gap_amt == 20.0
    assert got[("Overall", "Overall")].employee_count == 121 and not got[("Male", "x")].gap_is_significant_flag
    assert got[("Female", "y")].pay_gap_amt is None and not got[("Female", "y")].gap_is_significant_flag


def test_facts_without_a_version_on_their_day_are_kept(spark):
    fact = spark.createDataFrame([(1, "2020-01-05"), (1, "2019-01-01"), (2, "2020-01-05")], "k int, day string")
    versions = spark.createDataFrame([(1, "2020-01-01", None, "x")], "k int, effective_start_date string, effective_end_date string, v string")
    got = {(r.k, r.day): r.v for r in facts.as_of_version_join(fact, versions, "k", "day", ["v"]).collect()}
    assert got == {(1, "2020-01-05"): "x", (1, "2019-01-01"): None, (2, "2020-01-05"): None}


def test_an_older_event_in_a_later_batch_does_not_win(spark):
    root, log = scratch_path(spark, "late-state"), scratch_path(spark, "late-log")
    handler = incremental.apply_changes(root, "k", ["t"], ["v"], log)
    handler(spark.createDataFrame([("a", 10, "new"), ("b", 1, "x")], "k string, t int, v string"), 0)
    handler(spark.createDataFrame([("a", 5, "old"), ("b", 2, "y")], "k string, t int, v string"), 1)
    assert {r.k: (r.t, r.v) for r in storing.read_current(spark, root).collect()} == {"a": (10, "new"), "b": (2, "y")}
    assert [(r.k, r.new_value) for r in spark.read.parquet(log).collect()] == [("b", "y")]


def test_versions_are_carried_over_empty_buckets_and_hot_keys(spark):
    from rosterlens.operators.sequence import carried_forward

    draw = random.Random(2)
    facts_ = [(draw.choice([0, 0, 0, 1, 2, 3, None]), draw.choice([None, *range(1, 400)]), i) for i in range(900)]
    versions = [(draw.choice([0, 0, 1, 2, None]), draw.choice([None, *range(1, 400)]), draw.randrange(1000)) for _ in range(120)]
    got = carried_forward(spark.createDataFrame(facts_, "k int, day int, n int"), spark.createDataFrame(versions, "k int, start int, v int"),
                          ["k"], "day", "start", ["v"], lambda c: F.floor(c / 30), "found").collect()
    assert len(got) == 900
    for r in got:
        known = [(s, v) for k, s, v in versions if k is not None and s is not None and r.day is not None and k == r.k and s <= r.day]
        assert (r.found and tuple(r.found)) == (max(known) if known else None)


def test_a_hot_key_is_not_sorted_as_a_whole(spark):
    fact = spark.range(1000).selectExpr("1 AS k", "date_add(date'2020-01-01', cast(id AS int)) AS day")
    versions = spark.range(50).selectExpr("1 AS k", "date_add(date'2020-01-01', cast(id * 20 AS int)) AS effective_start_date", "date'2030-01-01' AS effective_end_date", "id AS v")
    got = facts.as_of_version_join(fact, versions, "k", "day", ["v"])
    assert got.where("v = floor(datediff(day, date'2020-01-01') / 20)").count() == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*?windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert windows and all("__bucket" in w for w in windows) and "BroadcastNestedLoopJoin" not in plan


def test_ordered_funnel_matches_a_walk(spark):
    draw = random.Random(9)
    base = datetime.datetime(2024, 1, 1)
    events = [(draw.choice([1, 1, 1, *range(2, 40), None]), draw.choice("abcd"), draw.choice([None, *[base + datetime.timedelta(hours=draw.randrange(60))] * 20])) for _ in range(400)]
    want = {}
    for who in {w for w, _, t in events if w is not None}:
        at = None
        for k, name in enumerate("abc"):
            later = [t for w, s, t in events if w == who and s == name and t is not None and (at is None or t > at)]
            if not later:
                break
            if k:
                want.setdefault(k, []).append((min(later) - at).total_seconds() / 3600)
            else:
                want.setdefault(k, []).append(None)
            at = min(later)
    got = summaries.ordered_funnel(spark.createDataFrame(events, "w int, s string, t timestamp"), "w", "s", "t", ["a", "b", "c"]).orderBy("position").collect()
    assert [r.candidates for r in got] == [len(want[k]) for k in range(3)] and got[0].avg_hours_from_previous is None
    assert all(abs(got[k].avg_hours_from_previous - sum(want[k]) / len(want[k])) < 0.01 for k in (1, 2))
    none = summaries.ordered_funnel(spark.createDataFrame([], "w int, s string, t timestamp"), "w", "s", "t", ["a", "b"]).collect()
    assert [(r.candidates, r.conversion_pct) for r in none] == [(0, None), (0, None)]


def test_adjusted_gap_is_the_least_squares_coefficient(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    rows = []
    for d in ("x", "y", None):
        for _ in range(200):
            g, a = ("Female" if draw.random() < 0.4 else "Male"), float(draw.normal(40, 9))
            t = a / 4 + float(draw.normal())
            rows.append((d, g, a, t, 2 * a, 1000.0 + 30 * a - 55 * (g == "Female") + 11 * t + float(draw.normal(0, 40))))
    rows += [("z", "Male", 30.0, 1.0, 60.0, 5.0), ("z", "Female", None, 1.0, 1.0, 7.0), ("x", "Other", 1.0, 1.0, 2.0, 1e6)]
    df = spark.createDataFrame(rows, "d string, gender string, age double, tenure double, twice double, salary double")
    # the third covariate is explained by the first and must change nothing
    got = {r.d: r for r in summaries.adjusted_pay_gap(df, ["d"], {"age": F.col("age"), "tenure": F.col("tenure"), "twice": F.col("twice")}).collect()}
    for d in ("x", "y", None):
        own = [r for r in rows if r[0] == d and r[1] != "Other"]
        m = np.array([[1.0, r[1] == "Female", r[2], r[3]] for r in own], float)
        y = np.array([r[5] for r in own])
        beta = np.linalg.lstsq(m, y, rcond=None)[0]
        rest = y - m @ beta
        error = math.sqrt(rest @ rest / (len(own) - 4) * np.linalg.inv(m.T @ m)[1, 1])
        assert abs(got[d].adjusted_gap_amt + beta[1]) < 0.01 and abs(got[d].std_error - error) < 0.01 and got[d].degrees_of_freedom == len(own) - 4
        assert got[d].gap_is_significant_flag == (abs(beta[1] / error) > 1.972)
    assert got["z"].adjusted_gap_amt is None and got["z"].std_error is None and not got["z"].gap_is_significant_flag


def test_manager_months_fill_gaps_and_slide(spark):
    day = datetime.date
    rows = [(1, day(2023, 1, 31), False, None, 50.0), (1, day(2023, 1, 31), True, True, None), (1, day(2023, 3, 31), True, True, 40.0), (1, day(2024, 2, 29), False, None, 60.0), (None, day(2024, 2, 29), False, None, 1.0)]
    got = {r.month_end: r for r in summaries.manager_months(spark.createDataFrame(rows, "manager_id int, month_end date, is_exit boolean, voluntary_exit_flag boolean, engagement_score double")).collect()}
    assert len(got) == 14 and got[day(2023, 2, 28)].team_size == 0 and got[day(2024, 2, 29)].tenure_as_manager_months == 13
    assert [got[d].exits_rolling for d in (day(2023, 1, 31), day(2023, 3, 31), day(2023, 12, 31), day(2024, 1, 31), day(2024, 2, 29))] == [1, 2, 2, 1, 1]
    assert got[day(2023, 3, 31)].exit_rate_rolling == round(2 / (1 / 3), 4)
    versions = summaries.manager_versions(summaries.manager_months(spark.createDataFrame(rows, "manager_id int, month_end date, is_exit boolean, voluntary_exit_flag boolean, engagement_score double")))
    ends = {r.effective_start_date: (r.effective_end_date, r.is_current_flag) for r in versions.collect()}
    assert ends[day(2024, 2, 29)] == (None, True) and all((e is None) == c for e, c in ends.values())


def test_null_cycles_and_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("c", "g", 1), (None, "g", 3), (None, None, 5)], "cycle string, g string, rating int")
    got = {(r.cycle, r.g): (r.rating_normalized, r.calibration_delta) for r in summaries.performance_metrics(df, "cycle", "rating", "g").collect()}
    assert got == {("c", "g"): (0.0, 0.0), (None, "g"): (0.0, 0.0), (None, None): (1.0, 0.0)}
    pay = spark.createDataFrame([(None, "Male", "x", 100), (None, "Female", "x", 90)], "department string, gender string, ethnicity string, salary int").withColumn("compa_ratio", F.lit(1.0))
    assert {r.gender_group: r.pay_gap_amt for r in summaries.comp_equity(pay, ["department"]).where("ethnicity_group = 'x'").collect()}["Female"] == 10.0


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in pathlib.Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_upsert_by_key_leaves_other_files_alone(spark):
    path = scratch_path(spark, "by-key")
    storing.write_by_key(state(spark, *((i, i, "n", "N") for i in range(1000))), path, "id", 16)
    before = files_of(path)
    batch = state(spark, (3, 33, "new", "N"), (4, 4, "n", "N"), (2000, 1, "x", "X"))
    changed = changes.upsert_by_key(spark, path, batch, "id", 16, ["pay"], ["pay", "note"])
    parts = {r[0] for r in batch.where("id <> 4").select(storing.key_part("id", 16)).collect()}
    assert set(changed) == parts and changes.upsert_by_key(spark, path, batch, "id", 16, ["pay"], ["pay", "note"]) == []
    after = files_of(path)
    same = {f for f in before if f"{storing.PART}=" + f.split("=")[1].split("/")[0] not in {f"{storing.PART}={p}" for p in parts}}
    assert same and all(after.get(f) == before[f] for f in same) and not (set(before) - same) & set(after)
    assert as_set(spark.read.parquet(path).where("id IN (3, 4, 2000) OR id = 999"), "id", "pay", "note") == {(3, 33, "new"), (4, 4, "n"), (2000, 1, "x"), (999, 999, "n")}
    assert spark.read.parquet(path).count() == 1001


def test_scd2_load_equals_the_plain_form_and_keeps_files(spark):
    draw, check = random.Random(1), ["pay", "note"]
    root = scratch_path(spark, "scd2")
    image = {i: (i, draw.randrange(5), "n", "N") for i in range(300)}
    plain = changes.scd2_initial(state(spark, *image.values()), "2024-01-01")
    changes.scd2_create(state(spark, *image.values()), root, "id", "2024-01-01", 8)
    gone = []
    for k, day in enumerate(("2024-02-01", "2024-03-01", "2024-04-01")):
        for i in (1, 2, 300 + k):
            image[i] = (i, draw.randrange(100, 200), "n", "N")
        back, gone = gone, [image.pop(7 + k)]
        image |= {r[0]: r for r in back}
        snapshot = state(spark, *image.values())
        plain = changes.scd2_snapshot(plain, snapshot, "id", check, day)
        before = files_of(f"{root}/latest")
        changed = changes.scd2_load(spark, root, snapshot, "id", check, day, 8)
        after = files_of(f"{root}/latest")
        assert 0 < len(changed) < 8 and all(after.get(f) == at for f, at in before.items() if int(f.split("=")[1].split("/")[0]) not in changed)
        assert changes.scd2_load(spark, root, snapshot, "id", check, day, 8) in ([], changed)
        columns = ("id", "pay", "scd_version", "effective_start_date", "effective_end_date", "is_current_flag")
        assert as_set(changes.scd2_read(spark, root), *columns) == as_set(plain, *columns)
        assert changes.scd2_read(spark, root).count() == plain.count()


def test_a_late_snapshot_splits_versions(spark):
    day = datetime.date
    dim = changes.scd2_initial(state(spark, (1, 10, "a", "A"), (2, 20, "b", "B"), (3, 30, "c", "C")), "2024-01-01")
    dim = changes.scd2_snapshot(dim, state(spark, (1, 10, "a", "A"), (2, 21, "b", "B"), (4, 40, "d", "D")), "id", ["pay"], "2024-03-01")
    late = state(spark, (1, 15, "a", "A"), (2, 25, "b", "B"), (3, 30, "c", "C"), (4, 45, "d", "D"), (5, 50, "e", "E"))
    got = as_set(changes.scd2_late_snapshot(dim, late, "id", ["pay"], "2024-02-01", "2024-03-01"), "id", "pay", "scd_version", "effective_start_date", "effective_end_date", "is_current_flag")
    jan, feb, mar = day(2024, 1, 1), day(2024, 2, 1), day(2024, 3, 1)
    assert got == {(1, 10, 1, jan, feb, False), (1, 15, 2, feb, mar, False), (1, 10, 3, mar, None, True), (2, 20, 1, jan, feb, False), (2, 25, 2, feb, mar, False), (2, 21, 3, mar, None, True),
                   (3, 30, 1, jan, mar, False), (4, 45, 1, feb, mar, False), (4, 40, 2, mar, None, True), (5, 50, 1, feb, mar, False)}


def test_rollup_rewrites_touched_months_once(spark):
    from rosterlens.plans import rollups

    path = scratch_path(spark, "rollup")
    schema = "month int, seg string, pay double, sign int"
    rollup = rollups.Rollup(("month", "seg"), {"pay": F.col("pay"), "n_pay": F.col("pay").isNotNull().cast("int")})
    first = spark.createDataFrame([(1, "a", 1.5, 1), (1, "b", 2.0, 1), (2, "a", None, 1), (3, None, 4.0, 1)], schema)
    assert rollups.add_load(spark, path, rollup, first, 1, "sign") == [1, 2, 3]
    before = files_of(path)
    delta = spark.createDataFrame([(1, "b", 2.0, -1), (1, "a", 0.25, 1), (3, None, 1.0, 1), (4, "c", 9.0, 1)], schema)
    assert rollups.add_load(spark, path, rollup, delta, 2, "sign") == [1, 3, 4]
    assert rollups.add_load(spark, path, rollup, delta, 2, "sign") == []
    after = files_of(path)
    assert [f for f in before if f in after] == [f for f in before if f.startswith("month=2/")] and all(after[f] == before[f] for f in before if f in after)
    got = {(r.month, r.seg): (r.row_count, float(r.pay), r.n_pay) for r in rollups.read_rollup(spark, path, rollup, first).collect()}
    assert got == {(1, "a"): (2, 1.75, 2), (2, "a"): (1, 0.0, 0), (3, None): (2, 5.0, 2), (4, "c"): (1, 9.0, 1)}


def test_keyed_change_log_out_of_order_and_in_proportion(spark):
    folder, log, checkpoint = (scratch_path(spark, n) for n in ("in", "log", "cp"))
    schema = "k int, at long, n long, note string, pay int"

    def deliver(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        stream = incremental.file_stream(spark, folder, schema)
        incremental.load_available(incremental.keyed_change_log(stream, "k", ["at", "n"], ["note", "pay"]), log, checkpoint)
        states = pathlib.Path(checkpoint.removeprefix("file:")).joinpath("state").rglob("*.delta")
        return sum(f.stat().st_size for f in states), as_set(spark.read.schema("k int, changed_column string, old_value string, new_value string").parquet(log), "k", "changed_column", "old_value", "new_value")

    first, logged = deliver([(k, 10, k, "a" * 40, 1) for k in range(4000)])
    assert logged == set()
    second, logged = deliver([(1, 9, 1, "late", 9), (2, 11, 0, "b", 1), (2, 12, 0, "c", None), (3, 10, 3, "tie", 5), (4, 10, 5, "a" * 40, 2), (9000, 1, 1, "x", 1)])
    assert logged == {(2, "note", "a" * 40, "c"), (2, "pay", "1", None), (4, "pay", "1", "2")}
    assert second - first < 0.2 * first
    third, again = deliver([(2, 11, 5, "older", 3), (2, 13, 0, "c", 7)])
    assert again - logged == {(2, "pay", None, "7")}


def test_late_rows_reach_the_side_table_and_their_windows(spark):
    out = scratch_path(spark, "late")
    handler = incremental.counts_with_late_rows(out, "ts", ["g"])
    stamp = lambda *days: spark.createDataFrame([(f"2024-01-{d:02} 12:00:00", "a") for d in days], "ts string, g string").withColumn("ts", F.col("ts").cast("timestamp"))
    handler(stamp(1, 1, 2), 0)
    handler(stamp(1, 5), 1)  # half a day behind the mark of 1 January 12:00 is not late
    handler(stamp(1, 3, 6), 2)
    handler(stamp(1, 3, 6), 2)  # a replay
    got = {(r.start.day, r.n, r.n_late) for r in incremental.read_counts(spark, out, ["g"]).collect()}
    assert got == {(1, 4, 1), (2, 1, 0), (3, 1, 1), (5, 1, 0), (6, 1, 0)}
    assert sorted(r.ts.day for r in spark.read.parquet(f"{out}/late").collect()) == [1, 3]


def test_carried_forward_shuffles_the_facts_once(spark):
    """No join behind the window; versions reach facts of later buckets, and facts without key or day get none."""
    from datetime import date

    from rosterlens.operators.sequence import carried_forward

    rows = [(1, date(2020, m, 28), f"wide{m}") for m in range(1, 13)] + [(1, date(2022, 1, 1), "late"), (2, date(2020, 5, 1), "none"), (None, date(2020, 5, 1), "nokey"), (1, None, "noday")]
    fact = spark.createDataFrame(rows, "k int, d date, wide string")
    versions = spark.createDataFrame([(1, date(2020, 3, 1), 5), (1, date(2020, 3, 1), 7), (1, date(2021, 6, 1), 9), (3, date(2020, 1, 1), 1), (None, date(2020, 1, 1), 2)], "k int, s date, v int")
    for unit in ("MM", "YYYY"):
        got = carried_forward(fact, versions, ["k"], "d", "s", ["v"], lambda day: F.trunc(day, unit))
        values = {r.wide: r.carried and r.carried.v for r in got.collect()}
        assert values == {"wide1": None, "wide2": None, **{f"wide{m}": 7 for m in range(3, 13)}, "late": 9, "none": None, "nokey": None, "noday": None}
        assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()  # facts meet what earlier buckets bring in the one window


def test_manager_months_fill_gaps_without_a_join(spark):
    """Months without rows get an empty team inside a manager's span; the figures move once by manager and month, once by manager."""
    day = datetime.date
    rows = [(1, day(2020, 1, 31), False, None, 80.0), (1, day(2020, 1, 31), True, True, None), (1, day(2020, 4, 30), False, None, 60.0), (2, day(2021, 12, 31), True, False, 50.0), (None, day(2020, 1, 31), False, None, 1.0)]
    fact = spark.createDataFrame(rows, "manager_id int, month_end date, is_exit boolean, voluntary_exit_flag boolean, engagement_score double")
    months = summaries.manager_months(fact)
    got = sorted(tuple(r) for r in months.collect())
    assert [(r[0], r[1], r[2], r[3], r[5], r[6]) for r in got] == [
        (1, day(2020, 1, 31), 1, 1, 80.0, 0), (1, day(2020, 2, 29), 0, 1, None, 1), (1, day(2020, 3, 31), 0, 1, None, 2), (1, day(2020, 4, 30), 1, 1, 60.0, 3),
        (2, day(2021, 12, 31), 0, 0, 50.0, 0),
    ]
    assert [r[4] for r in got] == [1.0, 2.0, 3.0, 2.0, None]
    assert "Join" not in months._jdf.queryExecution().sparkPlan().toString()


def test_loads_write_only_the_columns_their_sums_need(spark, monkeypatch):
    from rosterlens.catalog import loads

    wide = "date_key int, department string, location string, job_level string, is_exit boolean, is_active_flag boolean, fte_value double, tenure_months int, employee_name string"
    monkeypatch.setattr(loads, "snapshot_fact", lambda t: spark.createDataFrame([(20010831, "d", "l", "L3", True, False, 1.0, 3, "n"), (20011031, "d", "l", "L3", False, True, 1.0, 5, "n")], wide))
    first, second, wrong = loads.loads_of_fact(None, ["tenure_months"])
    assert first.columns == second.columns == wrong.columns == ["date_key", *loads.SEGMENT, "is_exit", "is_active_flag", "fte_value", "tenure_months"]
    assert (first.count(), second.count(), [(r.fte_value, r.is_active_flag) for r in wrong.collect()]) == (1, 1, [(7.0, True)])
