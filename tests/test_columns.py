"""Band edges, nulls and empty denominators of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import bands, cleaning, dates, display, masking, scores
from rosterlens.functions.numeric import count_if, mean, n_rows, pct, round_half_up


def apply(spark, values, schema, expr):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize("fn,values,expected", [
    (lambda: bands.age_band("v"), [24.0, 25.0, 64.0, 65.0, None], ["Under 25", "25-34", "55-64", "65+", None]),
    (lambda: bands.age_band("v", "right"), [0.0, 25.0, 26.0, 100.0, 101.0], [None, "<25", "25-34", "65+", None]),
    (lambda: bands.tenure_band("v"), [0.0, 0.99, 1.0, 12.0], ["< 1 Year", "< 1 Year", "1-2 Years", "12+ Years"]),
    (lambda: bands.tenure_band("v", "right"), [0.0, 1.0, 1.01, 12.0], [None, "<1yr", "1-2yr", "8-12yr"]),
    (lambda: bands.tenure_band_index("v"), [0.5, 1.0, 40.0], [1, 2, 7]),
    (lambda: bands.tenure_band_months("v"), [5.0, 6.0, 119.0, 120.0], ["<6m", "6-12m", "5-10y", "10y+"]),
    (lambda: bands.salary_band("v"), [79999.0, 80000.0, 350000.0], ["< $80K", "$80K-$120K", "$350K+"]),
    (lambda: bands.engagement_tier("v"), [39.99, 40.0, 60.0, 75.0], ["High Risk", "Medium Risk", "Low Risk", "Engaged"]),
    (lambda: bands.engagement_tier("v", closed="right"), [40.0, 0.0, 75.0], ["High Risk", None, "Low Risk"]),
    (lambda: bands.engagement_segment("v"), [49.9, 50.0, 75.0], ["Low Engagement", "Moderate Engagement", "High Engagement"]),
    (lambda: bands.compa_band_index("v"), [0.69, 0.70, 1.10, 1.20], [1, 2, 5, 6]),
    (lambda: bands.risk_tier("v"), [25.0, 25.1, 45.0, 70.0, 70.1], ["Low", "Medium", "Medium", "High", "Critical"]),
    (lambda: bands.attrition_rag("v"), [17.9, 18.0, 25.0], ["Green", "Amber", "Red"]),
    (lambda: bands.engagement_rag("v"), [59.9, 60.0, 75.0], ["Red", "Amber", "Green"]),
    (lambda: bands.rag("v", 2, 5, strict=True), [2.0, 2.1, 5.0, 5.1], ["Green", "Amber", "Amber", "Red"]),
])
def test_bands(spark, fn, values, expected):
    assert apply(spark, values, "v double", fn()) == expected


def test_every_sortable_tenure_label_sorts_in_band_order(spark):
    got = apply(spark, [0.1, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0], "v double", bands.tenure_band_sortable("v"))
    assert got == sorted(got) and len(set(got)) == 7


@pytest.mark.parametrize("value,digits,expected", [(0.125, 2, 0.13), (2.5, 0, 3.0), (-2.5, 0, -3.0), (1.005, 1, 1.0), (None, 2, None)])
def test_round_half_up(spark, value, digits, expected):
    assert apply(spark, [value], "v double", round_half_up("v", digits)) == [expected]


def test_rates_of_an_empty_group_are_null_or_default(spark):
    df = spark.createDataFrame([("a", 1)], "g string, v int").where("v > 5")
    row = df.agg(pct(count_if(F.col("v") > 0), n_rows()).alias("a"), pct(count_if(F.col("v") > 0), n_rows(), default=0.0).alias("b"),
                 mean("v").alias("c")).first()
    assert (row.a, row.b, row.c) == (None, 0.0, None)


def test_scores(spark):
    df = spark.createDataFrame([(30.0, 20.0, 80.0, 0.5, 5, 4), (90.0, 90.0, 99.0, 9.0, 1, 0)],
                               "e double, s double, a double, y double, r int, p int")
    first, last = df.select(
        scores.flight_risk_composite("e", "s", "a", "y").alias("f"), scores.rule_risk_score("e", "s", "a", "y").alias("x"),
        scores.retention_score("e", "y", "r", "p").alias("k"),
    ).collect()
    assert first.f == pytest.approx(17.5 + 15 + 5 / 85 * 20 + 20)
    assert first.x == round(17.5 + 35 / 55 * 25 + 8 / 88 * 15 + 25, 1)
    assert first.k == pytest.approx(70 - 37.3 * 0.3 - 8 + 6 + 6)
    assert (last.f, last.x) == (0.0, 0.0)


def test_promotion_and_quadrant_labels(spark):
    df = spark.createDataFrame([(3.0, 4), (3.0, 3), (2.0, 2), (0.9, 5)], "g double, r int")
    got = [r[0] for r in df.select(bands.promotion_status("g", "r")).collect()]
    assert got == [bands.PROMOTION_STATUSES[i] for i in (0, 1, 2, 3)]
    box = spark.createDataFrame([("High Engagement", "High Performance"), ("Moderate Engagement", "Low Performance")], "e string, p string")
    assert [r[0] for r in box.select(bands.quadrant_label("e", "p")).collect()] == [
        bands.QUADRANT_LABELS[("High Engagement", "High Performance")], bands.QUADRANT_DEFAULT]


def test_voluntary_needs_a_stated_reason(spark):
    df = spark.createDataFrame([("Yes", "pay"), ("Yes", "N/A"), ("Yes", ""), ("Yes", None), ("No", "pay")], "attrition string, exit_reason string")
    assert [r[0] for r in df.select(scores.is_voluntary()).collect()] == [True, False, False, False, False]


def test_cleaning(spark):
    assert apply(spark, ["  ", " ab ", None], "v string", cleaning.clean_string("v")) == [None, "ab", None]
    assert apply(spark, [" ft", "PT", "x", None], "v string", cleaning.employee_type("v")) == ["Full-Time", "Part-Time", "Full-Time", "Full-Time"]
    assert apply(spark, ["leave", "??", None], "v string", cleaning.employment_status("v")) == ["LOA", "Unknown", "Unknown"]
    assert apply(spark, ["nb ", "", "F"], "v string", cleaning.gender("v")) == ["Non-binary", "Prefer-not-to-say", "Female"]
    assert apply(spark, [("a", None)], "a string, b string", cleaning.full_name("a", "b")) == [None]


def test_surrogate_key_separates_null_from_value(spark):
    keys = apply(spark, [("a", None), ("a", ""), ("a", None)], "a string, b string", cleaning.surrogate_key("a", "b"))
    assert keys[0] == keys[2] != keys[1]


def test_dates(spark):
    assert apply(spark, ["2020-02-30", "2020-02-29", "x", None], "v string", dates.safe_date("v")) == [None, datetime.date(2020, 2, 29), None, None]
    pair = [(datetime.date(2020, 12, 31), datetime.date(2021, 1, 1))]
    for unit, expected in (("year", 1), ("quarter", 1), ("month", 1), ("day", 1)):
        assert apply(spark, pair, "a date, b date", dates.date_diff_calendar(unit, "a", "b")) == [expected]
    assert apply(spark, pair, "a date, b date", dates.age_years("a", "b", exact=True)) == [0]
    march, april = datetime.date(2024, 3, 31), datetime.date(2024, 4, 1)
    assert apply(spark, [march, april], "v date", dates.fiscal_columns("v")["fiscal_period_label"]) == ["FY24-P12", "FY25-P01"]


def test_display(spark):
    assert apply(spark, [169953.0], "v double", display.money_k("v")) == ["$170.0K"]
    assert apply(spark, [(0.238, 2380)], "a double, b int", display.percent_with_count("a", "b")) == ["23.8% (2,380 employees)"]
    assert apply(spark, [5.84, -0.96, 0.0], "v double", display.signed_points("v")) == ["+5.8pp", "-1.0pp", "+0.0pp"]


@pytest.mark.parametrize("role,expected", [
    (masking.EXEC, 123456.0), (masking.COMP_ADMIN, 123456.0), (masking.HRBP, 120000.0), (masking.TALENT, None), (masking.COMPLIANCE, None),
])
def test_salary_mask(spark, role, expected):
    assert apply(spark, [123456], "v int", masking.mask_salary("v", role)) == [expected]
