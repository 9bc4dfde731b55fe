"""Distributed ranks, tiles, quantiles and neighbours against plain windows, including skew and ties."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterlens.operators import grouping, ranking, sequence


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows: one group holds two thirds, one value a third of all rows."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 else rng.choice("abc")
        value = 50.0 if i % 3 == 1 else round(rng.uniform(-20, 300), 2)
        rows.append((i * 7 % 900, group, value))
    return spark.createDataFrame(rows, "id bigint, g string, v double").cache()


def both(df, got, want, column):
    a = {r.id: r[column] for r in got.collect()}
    b = {r.id: r[column] for r in want.collect()}
    assert len(a) == df.count() and a == b


def test_ranks_match_windows(skewed):
    window = Window.partitionBy("g").orderBy("v")
    placed = ranking.position_lookup(skewed, ["g"], "v", {"up": ranking.rank_asc(), "down": ranking.rank_desc(), "pr": ranking.percent_rank()})
    got = skewed.join(placed, ["g", "v"])
    both(skewed, got, skewed.withColumn("up", F.rank().over(window)), "up")
    both(skewed, got, skewed.withColumn("down", F.rank().over(Window.partitionBy("g").orderBy(F.desc("v")))), "down")
    both(skewed, got, skewed.withColumn("pr", F.percent_rank().over(window)), "pr")


@pytest.mark.parametrize("n", [1, 4, 7, 10, 1000])
def test_ntile_matches_window_with_key_tiebreak(skewed, n):
    got = ranking.global_ntile(skewed, "v", {"t": n}, "id")
    want = skewed.withColumn("t", F.ntile(n).over(Window.orderBy("v", "id")))
    both(skewed, got, want, "t")


def test_top_fraction_is_exact_inside_a_tied_value(skewed):
    top = ranking.top_fraction(skewed, "v", 0.6, "id")
    assert top.where("in_top").count() == 540
    want = skewed.withColumn("in_top", F.row_number().over(Window.orderBy(F.desc("v"), F.desc("id"))) <= 540)
    both(skewed, top, want, "in_top")


@pytest.mark.parametrize("kind", ["double", "string", "date"])
def test_nulls_texts_dates_and_an_outlier_keep_their_rows(spark, kind):
    rows = [(f"E{i:03}", [None, "a", "b"][i % 3], None if i % 5 == 0 else i % 17) for i in range(120)] + [("E900", "a", 10**9 % 20_000)]
    df = spark.createDataFrame(rows, "id string, g string, x int")
    value = {"double": F.col("x").cast("double"), "string": F.concat(F.lit("v"), F.col("x")), "date": F.date_add(F.lit("2020-01-01"), F.col("x"))}[kind]
    df = df.select("id", "g", value.alias("v")).cache()
    window = Window.partitionBy("g").orderBy(F.asc_nulls_last("v"))
    both(df, ranking.with_ranks(df, ["g"], "v", {"r": ranking.rank_asc()}), df.withColumn("r", F.rank().over(window)), "r")
    order = Window.orderBy(F.asc_nulls_last("v"), "id")
    both(df, ranking.global_ntile(df, "v", {"t": 7}, "id"), df.withColumn("t", F.ntile(7).over(order)), "t")


def test_neighbours_keep_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", None), ("b", 5)], "k string, t int")
    assert sequence.previous_row(df, ["k"], ["t"], ["t"], F.floor(F.col("t") / 2)).count() == 5


def test_single_row_group_has_percent_rank_zero(spark):
    df = spark.createDataFrame([(1, "x", 3.0)], "id bigint, g string, v double")
    got = ranking.with_ranks(df, ["g"], "v", {"pr": ranking.percent_rank()}).first()
    assert got.pr == 0.0


@pytest.mark.parametrize("distributed", [False, True])
def test_quantiles_match_builtin(skewed, distributed):
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {r.g: r for r in grouping.exact_quantiles(skewed, ["g"], "v", probs, distributed).collect()}
    want = skewed.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()]).collect()
    for row in want:
        for name in probs:
            assert got[row.g][name] == pytest.approx(row[name])
    overall = grouping.exact_quantiles(skewed, [], "v", {"m": 0.5}, distributed).first().m
    assert overall == pytest.approx(skewed.agg(F.percentile("v", F.lit(0.5))).first()[0])


def test_median_of_an_even_group(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (20,)], "v int")
    assert grouping.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 6.0


@pytest.mark.parametrize("direction,step", [("previous", F.lag), ("next", F.lead)])
def test_neighbours_across_buckets(spark, direction, step):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.randrange(1000), i, None if i % 7 == 0 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    bucket = F.floor(F.col("t") / 100)
    got = sequence.neighbour_row(df, ["k"], ["t", "id"], ["v", "id"], bucket, "n", direction)
    want = df.withColumn("n", step(F.struct("v", "id")).over(Window.partitionBy("k").orderBy("t", "id")))
    assert {r.id: r.n for r in got.collect()} == {r.id: r.n for r in want.collect()}


def test_latest_per_key_breaks_ties_on_later_order_columns(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", 1, 1, None)], "k string, t int, s int, v string")
    assert {r.k: r.v for r in ranking.latest_per_key(df, ["k"], ["t", "s"]).collect()} == {"a": "z", "b": None}


def test_value_counts_fills_missing_categories_in_order(spark):
    df = spark.createDataFrame([("b",), ("b",), ("z",)], "c string")
    got = grouping.value_counts(df, "c", ["a", "b"]).orderBy("sort_index").collect()
    assert [(r.c, r.n) for r in got] == [("a", 0), ("b", 2)]


def test_stacked_views_and_tiles_match_sorting(spark):
    import random

    draw = random.Random(6)
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), draw.choice([None, *range(40)]), draw.choice([None, 0.5, 1.25, *[float(k) for k in range(30)]])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, n int, x double")
    positions = ranking.stacked_positions(df, {"one": (["g"], "n"), "all": ([], "x")})
    got = ranking.view_lookup(ranking.view_lookup(df, positions, "one", ["g"], "n", {"r": ranking.rank_asc()}), positions, "all", [], "x", {"s": ranking.rank_asc()})
    rank = lambda values, v: 1 + sum((w is not None and (v is None or w < v)) for w in values)
    for r in got.collect():
        assert r.r == rank([n for _, g, n, _ in rows if g == r.g], r.n) and r.s == rank([x for *_, x in rows], r.x)
    tiled = {r.id: (r.a, r.b) for r in ranking.ordered_tiles(df, {"a": ("n", 7), "b": ("x", 3)}, "id").collect()}
    for place, (column, tiles) in enumerate(((2, 7), (3, 3))):
        order = sorted(rows, key=lambda r: (r[column] is None, r[column] if r[column] is not None else 0, r[0]))
        base, extra = divmod(500, tiles)
        want = [k + 1 for k in range(tiles) for _ in range(base + (k < extra))]
        assert [tiled[r[0]][place] for r in order] == want


def test_quantiles_of_a_group_are_not_held_in_one_buffer(spark):
    from rosterlens.operators import compensation, grouping

    df = spark.range(2000).selectExpr("1 AS g", "cast(id AS int) AS v", "IF(id % 7 = 0, NULL, cast(id AS int)) AS w")
    plan = grouping.exact_quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    assert compensation.box_plot(df, ["g"], "v").first().p50 == 999.5
    got = grouping.grouped_sums(df, ["g"], {"s": F.col("v")}, "w", {"m": 0.5}).first()
    known = sorted(i for i in range(2000) if i % 7)
    assert (got.s, got.m) == (sum(range(2000)), (known[len(known) // 2 - 1] + known[len(known) // 2]) / 2)
