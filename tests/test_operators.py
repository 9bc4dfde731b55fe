"""Hierarchy, scopes, checks, filters and model invariants."""

import re

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from rosterlens.functions import masking, scores
from rosterlens.models import risk
from rosterlens.operators import filters, hierarchy, quality, reshape, search, security, talent, workforce


def tree(spark, *pairs):
    return spark.createDataFrame([(n, p, f"N{n}") for n, p in pairs], "id int, boss int, name string")


def test_hierarchy_chains_and_guard(spark):
    df = tree(spark, (1, None), (2, 1), (3, 2), (4, 4), (5, 6), (6, 5), (7, 99), (8, 7))
    got = {r.id: (r.org_depth, r.reporting_chain) for r in hierarchy.org_hierarchy(df, "id", "boss", "name").collect()}
    assert got == {1: (0, "N1"), 2: (1, "N1 → N2"), 3: (2, "N1 → N2 → N3"), 4: (0, "N4")}
    reach = hierarchy.org_reachability(df, "id", "boss").first()
    assert (reach.max_org_depth, reach.employees_reached, reach.employees_unreached) == (2, 4, 4)


def test_hierarchy_of_a_long_line_stops_at_the_guard(spark):
    df = tree(spark, (0, None), *[(i, i - 1) for i in range(1, 30)])
    depths = [r.org_depth for r in hierarchy.org_hierarchy(df, "id", "boss", "name", max_depth=10).collect()]
    assert sorted(depths) == list(range(11))
    roll = {r.id: (r.direct_report_count, r.total_org_size) for r in hierarchy.rollup_counts(tree(spark, (0, None), (1, 0), (2, 0), (3, 1)), "id", "boss").collect()}
    assert roll == {0: (2, 3), 1: (1, 1)}


def test_scopes_are_disjoint_and_deny_by_default(spark):
    df = spark.createDataFrame([(1, "Org/Tech/Platform"), (2, "Org/Technology"), (3, "Org/Sales")], "employee_id int, path string")
    units = spark.createDataFrame([("u", "Org/Tech"), ("v", "Org/Sales"), ("w", "Org/%")], "hrbp_employee_id string, business_unit_path string")
    seen = lambda user, role: {r.employee_id for r in security.scope_by_path(df, units, user, role).collect()}
    assert seen("u", masking.HRBP) == {1, 2} and seen("v", masking.HRBP) == {3} and seen("w", masking.HRBP) == set()
    assert seen("nobody", masking.HRBP) == set() and seen("u", masking.ANALYST) == set() and seen("x", masking.EXEC) == {1, 2, 3}
    both = reshape.disjoint(security.scope_by_path(df, units, "u", masking.HRBP), security.scope_by_path(df, units, "v", masking.HRBP), "employee_id")
    assert both.first().is_disjoint


def test_name_search_is_literal(spark):
    df = spark.createDataFrame([("Ann (x)",), ("ann",), (None,)], "n string")
    assert filters.name_search(df, "n", "N (X").count() == 1
    assert filters.name_search(df, "n", "a.n").count() == 0
    assert filters.name_search(df, "n", "").count() == 3


def test_optional_filters_add_only_set_predicates(tables):
    assert filters.optional_filters(tables.employee) is tables.employee
    assert filters.multi_select(tables.employee, department=[]) is tables.employee


def test_sampling_is_repeatable_and_bounded(tables):
    ids = lambda: {r.employee_id for r in reshape.sample_rows(tables.employee.select("employee_id"), 100, "employee_id").collect()}
    first = ids()
    assert len(first) == 100 and first == ids()


def test_checks_catch_bad_rows(spark):
    df = spark.createDataFrame(
        [("", 100, "Maybe", None, 17), ("A", 50000, "Yes", None, 99), ("B", 50000, "No", "pay", 30)],
        "employee_name string, salary int, attrition string, exit_reason string, age int")
    got = {r.check_name: (r.value, r.passed) for r in quality.completeness(df).collect()}
    assert got["null_names"] == (1.0, False) and got["bad_salaries"] == (0.0, True) and got["bad_attrition_flag"] == (1.0, False)
    assert got["attrited_missing_reason"] == (1.0, False) and got["active_with_reason"] == (1.0, False)
    ages = quality.domain_ranges(df, {"age": quality.range_rule("age", 16, 80)}).first()
    assert (ages.value, ages.passed) == (1.0, False)
    levels = spark.createDataFrame([(1, 10.0), (2, 9.0), (3, 11.0)], "o int, v double")
    assert quality.monotonic(levels, "o", "v", "m").first().value == 1.0


def test_reference_invariants_on_the_bound_tables(tables):
    e = tables.employee
    card = workforce.executive_scorecard(e).first()
    assert card.active_employees + card.total_attrited == card.total_employees == e.count()
    assert card.regrettable_attrition_pct <= card.attrition_rate_pct
    assert -100 <= talent.enps(e).first().enps <= 100
    shares = talent.representation_by_level(e).groupBy("job_level").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 0.05 for r in shares)
    for check in (quality.completeness(e).where("check_name <> 'attrited_missing_reason'"), quality.domain_ranges(e), quality.unique_key(e, ["employee_id"])):
        assert all(r.passed for r in check.collect())


def test_a_level_without_women_has_no_gap(spark, tables):
    rows = tables.employee.where("job_level <> 'L2' or gender <> 'Female'")
    gap = {r.job_level: r.pay_gap_pct for r in workforce.gender_by_level(rows, tables.job_levels).collect()}
    assert gap["L2"] is None and gap["L3"] is not None


@pytest.fixture(scope="module")
def scored(tables):
    labelled = risk.with_label(tables.employee)
    model = risk.logistic(labelled, max_iter=20)
    return model, risk.risk_tiers(risk.score_batch(model, labelled)).cache()


def test_model_output_contract(tables, scored):
    model, frame = scored
    out = risk.top_drivers(model, frame)
    assert out.count() == tables.employee.count()
    assert all(r.passed for r in quality.score_consistency(out).collect())
    critical = frame.where("risk_tier = 'Critical'").count() / frame.count()
    assert 0 < critical <= 0.10
    drivers = out.select("top_drivers").first()[0].split(" | ")
    assert len(set(drivers)) == 3 and set(drivers) <= set(risk.feature_names())


def test_importance_is_non_negative_and_complete(scored):
    model, frame = scored
    rows = risk.feature_importance(model, frame).collect()
    assert {r.feature for r in rows} == set(risk.feature_names()) and all(r.mean_abs_contribution >= 0 for r in rows)


def test_lift_of_a_perfect_score(spark):
    df = spark.createDataFrame([(i, float(i), i >= 90) for i in range(100)], "employee_id int, s double, hit boolean")
    got = risk.lift_at_k(df, "s", F.col("hit")).first()
    assert (got.precision_at_k, got.base_rate, got.lift) == (1.0, 0.1, 10.0)


def test_what_if_masks_only_high_tiers(spark):
    df = spark.createDataFrame([(30.0,), (50.0,), (75.0,)], "risk_score double").withColumn("risk_tier", scores.rule_risk_tier("risk_score"))
    masked = {r.risk_tier: (r.before, r.after) for r in risk.what_if_retier(df, 20).collect()}
    assert masked == {"Low": (0, 0), "Medium": (1, 2), "High": (1, 1), "Critical": (1, 0)}
    everyone = {r.risk_tier: r.after for r in risk.what_if_retier(df, 20, masked=False).collect()}
    assert everyone == {"Low": 1, "Medium": 1, "High": 1, "Critical": 0}


def test_counts_reach_any_depth_and_leave_cycles_out(spark):
    rows = [(0, None), *((i, i - 1) for i in range(1, 31)), (50, 51), (51, 50), (52, 51), (60, 99)]
    roll = {r.id: (r.direct_report_count, r.total_org_size) for r in hierarchy.rollup_counts(tree(spark, *rows), "id", "boss").collect()}
    assert roll[0] == (1, 30) and roll[29] == (1, 1) and set(roll) == set(range(30))


def plain_ends(parents):
    """kind and top by walking every line."""
    out = {}
    for start in parents:
        seen, at = [], start
        while True:
            up = parents[at]
            if up is None or up == at:
                out[start] = ("root" if at == start else "reached", at)
                break
            if up not in parents:
                out[start] = ("orphan" if at == start else "below an orphan", up)
                break
            seen.append(at)
            if up in seen:
                cycle = seen[seen.index(up):]
                out[start] = ("on a cycle" if start in cycle else "below a cycle", min(cycle))
                break
            at = up
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_ends_and_counts_of_random_lines(spark, seed):
    import random

    draw = random.Random(seed)
    parents = {i: draw.choice([None, i, *[draw.randrange(400)] * 30, 1000]) for i in draw.sample(range(400), 300)}
    parents |= {2000 + i: 2000 + (i + 1) % 37 for i in range(37)} | {3000 + i: 3001 + i for i in range(70)} | {3070: 2005}
    df = spark.createDataFrame(list(parents.items()), "id int, boss int")
    want = plain_ends(parents)
    assert {r.id: (r.kind, r.top) for r in hierarchy.line_ends(df, "id", "boss").collect()} == want
    total, direct = {}, {}
    for i, (kind, _) in want.items():
        if kind == "reached":
            direct[parents[i]] = direct.get(parents[i], 0) + 1
            at = i
            while want[at][0] != "root":
                at = parents[at]
                total[at] = total.get(at, 0) + 1
    assert {r.id: (r.direct_report_count, r.total_org_size) for r in hierarchy.rollup_counts(df, "id", "boss").collect()} == {i: (direct[i], n) for i, n in total.items()}


def test_counts_of_a_chain_of_a_hundred_thousand(spark):
    df = spark.range(100_000).selectExpr("id", "IF(id = 0, NULL, id - 1) AS boss")
    roll = hierarchy.rollup_counts(df, "id", "boss")
    assert roll.where("total_org_size = 99999 - id AND direct_report_count = 1").count() == roll.count() == 99_999
    hot = spark.range(50_000).selectExpr("id", "IF(id = 0, NULL, IF(id < 40000, 0, 1)) AS boss")
    assert {tuple(r)[:3] for r in hierarchy.rollup_counts(hot, "id", "boss").collect()} == {(0, 39_999, 49_999), (1, 10_000, 10_000)}


def test_lines_of_an_empty_table_and_of_one_node(spark):
    none = spark.createDataFrame([], "id int, boss int")
    assert hierarchy.line_ends(none, "id", "boss").count() == hierarchy.rollup_counts(none, "id", "boss").count() == 0
    assert [tuple(r) for r in hierarchy.line_ends(spark.createDataFrame([(1, None)], "id int, boss int"), "id", "boss").collect()] == [(1, "root", 1)]


def test_nodes_that_many_point_to_are_joined_by_broadcast(spark, monkeypatch):
    """Doubled pointers meet in one node near the top; the rows below it do not go to one task, and every path comes out."""
    from rosterlens.operators import hierarchy

    monkeypatch.setattr(hierarchy, "HEAVY", 3)
    edges = [(0, None), (1, 0), (2, 1), (3, 2)] + [(10 + i, 3) for i in range(20)] + [(50, 51), (51, 50), (60, 99)]
    df = spark.createDataFrame(edges, "id int, up int")
    got = {r.id: list(r.ids) for r in hierarchy.ancestor_paths(df, "id", "up", "id").collect()}
    assert got == {0: [0], 1: [0, 1], 2: [0, 1, 2], 3: [0, 1, 2, 3], **{10 + i: [0, 1, 2, 3, 10 + i] for i in range(20)}}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        open_nodes = spark.createDataFrame([(i, 3) for i in range(20)] + [(90, 7)], "id int, up int")
        joined = hierarchy._join_above(open_nodes, spark.createDataFrame([(3, "a"), (7, "b"), (8, "c")], "up int, path string"))
        assert sorted((r.id, r.path) for r in joined.collect()) == [(i, "a") for i in range(20)] + [(90, "b")]
        assert joined._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fixed_lists_are_broadcast(spark, tmp_path):
    """Lists of a few rows never make the employees move by a key of a few values."""
    from rosterlens.operators import joins
    from rosterlens.sources.bindings import Tables

    t = Tables(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "L3", 2, 4)], "employee_id int, job_level string, recruitment_source_id int, performance_rating int")
    joined = joins.star_join(df, {"job_level": t.job_levels, "recruitment_source_id": t.recruitment_sources, "performance_rating": t.ratings})
    assert joined.count() == 1
    assert joined._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 3


def test_permutation_importance_multiplies_and_joins_no_rows(spark):
    """All versions of a row are scored beside each other; shares and log losses as by hand."""
    import math

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(i, float(i % 2), Vectors.dense(float(i % 2) + (i % 3) / 3, 5.0)) for i in range(24)], ["employee_id", "label", "features"])
    model = LogisticRegression(regParam=0.01).fit(rows)
    out = risk.permutation_importance(model, rows, ["tells", "constant"])
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
    got = {r.feature: (r.mean_abs_change, r.log_loss_rise) for r in out.collect()}
    order = [r.employee_id for r in rows.orderBy(F.xxhash64(F.lit("order"), "employee_id"), "employee_id").collect()]
    features = {r.employee_id: (r.label, r.features[0]) for r in rows.collect()}
    p = lambda x: 1 / (1 + math.exp(-(model.coefficients[0] * x + model.coefficients[1] * 5 + model.intercept)))
    loss = lambda label, q: -math.log(q if label == 1 else 1 - q)
    change = rise = 0
    for i, k in enumerate(order):
        (label, x), (_, y) = features[k], features[order[(i + 1) % len(order)]]
        change, rise = change + abs(p(y) - p(x)) / 24, rise + (loss(label, p(y)) - loss(label, p(x))) / 24
    assert got["constant"] == (0, 0) and got["tells"] == pytest.approx((change, rise), abs=2e-6)


def test_name_index_has_more_files_and_tasks_on_larger_tables(spark, tmp_path, monkeypatch):
    """Without a number of files, neither a file nor a task of the search grows with the table; the rows are those of the scan."""
    monkeypatch.setattr(search, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(search, "HITS_PER_TASK", 20)
    rows = [(i, None if i % 9 == 0 else f"Emp {i % 50}") for i in range(600)] + [(None, "emp 12"), (700, "E")]
    people = spark.createDataFrame(rows, "id int, name string")
    path = str(tmp_path / "index")
    search.build_name_index(people, "id", "name", path)
    postings = spark.read.parquet(f"{path}/postings")
    n = postings.count()
    sizes = [r[1] for r in postings.groupBy(F.input_file_name()).count().collect()]
    assert n > 1000 and len(sizes) >= n // 150 and max(sizes) <= 300
    assert len(spark.read.parquet(f"{path}/names").inputFiles()) >= 4
    for text in ("P 1", "emp", "e", "zz9", ""):
        found = search.indexed_name_search(spark, path, "id", "name", text)
        want = {tuple(r) for r in filters.name_search(people.where("name is not null and id is not null"), "name", text).collect()}
        assert {tuple(r) for r in found.where("id is not null").collect()} == want
    plan = search.indexed_name_search(spark, path, "id", "name", "P 1")._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"RepartitionByExpression \[id#\d+L?\], (\d+)", plan)[1]) > 5


def test_models_score_their_test_rows_once(spark, monkeypatch):
    """Curve and lift read the written scores; the models are not applied again for each pass."""
    seen, lift = [], risk.lift_at_k
    monkeypatch.setattr(risk, "lift_at_k", lambda scored, *rest: seen.append(scored) or lift(scored, *rest))
    monkeypatch.setattr(risk, "GBTClassifier", lambda **given: GBTClassifier(**{**given, "maxIter": 1}))
    numbers = {c: F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(50)).cast("double") for c in risk.NUMERIC_FEATURES}
    rows = spark.range(600).withColumns(numbers).withColumns({c: F.concat(F.lit("v"), F.col("id") % 3) for c in risk.CATEGORICAL_FEATURES})
    rows = rows.withColumns({"employee_id": F.col("id") - F.col("id") % 2, risk.LABEL: (F.col("age") + F.col("id") % 7 > 30).cast("double")})
    out = risk.train_compare(*risk.split_by_key(rows)).collect()
    assert len(out) == 4 and all(r.auc > 0.7 and r.lift > 1 for r in out)
    assert len(seen) == 4 and all(s.inputFiles() for s in seen)
