"""Risk scoring, tiers, drivers and validation."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rosterlens.catalog.columns import RULE, TIER
from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import LEFT, STAYED, cnt, emp, pct
from rosterlens.functions import scores
from rosterlens.functions.numeric import round_half_up
from rosterlens.models import risk
from rosterlens.operators import talent
from rosterlens.session import written_table

SCORED = f"""scored AS (SELECT *, {TIER} AS risk_tier, round(risk_score / 100, 6) AS model_probability FROM (SELECT *, {RULE} AS risk_score FROM employee))"""
ORDER = "CASE risk_tier WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS tier_order"


@query("m08_rule_based_fallback", emp("SELECT employee_id, risk_score, risk_tier, model_probability FROM scored", SCORED))
def rule_based(t):
    return risk.rule_based_fallback(t.employee).select("employee_id", "risk_score", "risk_tier", "model_probability")


@query("a39_risk_tiers_by_department", emp(f"""
SELECT department, risk_tier, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY department), 2) AS pct
FROM scored WHERE {STAYED} GROUP BY 1, 2""", SCORED))
def tiers_by_department(t):
    return talent.risk_tiers_by_department(risk.rule_based_fallback(t.employee.where(scores.is_active())))


@query("a48_tier_validation", emp(f"""
SELECT risk_tier, count(*) AS employee_count, round(100e0 * avg(model_probability), 1) AS avg_predicted_prob_pct,
 {pct(cnt(LEFT), digits=1)} AS actual_attrition_rate_pct, {ORDER} FROM scored GROUP BY risk_tier""", SCORED))
def tier_validation(t):
    scored = risk.rule_based_fallback(t.employee).select("employee_id", "risk_tier", "model_probability")
    return talent.tier_validation(scored, t.employee)


TIERED = """edges AS (SELECT quantile_cont(risk_score, 0.50) AS e0, quantile_cont(risk_score, 0.85) AS e1, quantile_cont(risk_score, 0.975) AS e2 FROM scored),
tiered AS (SELECT s.* EXCLUDE (risk_tier), CASE WHEN risk_score > e2 THEN 'Critical' WHEN risk_score > e1 THEN 'High' WHEN risk_score > e0 THEN 'Medium' ELSE 'Low' END AS risk_tier
 FROM scored s, edges)"""


@query("m04_risk_tiers", emp("SELECT employee_id, risk_score, risk_tier FROM tiered", SCORED, TIERED))
def risk_tiers(t):
    scored = risk.rule_based_fallback(t.employee).select("employee_id", "risk_score")
    return risk.risk_tiers(scored)


@query("m04_tier_counts", emp(f"SELECT risk_tier, count(*) AS n, {ORDER} FROM tiered GROUP BY risk_tier", SCORED, TIERED))
def tier_counts(t):
    return risk.tier_counts(risk.risk_tiers(risk.rule_based_fallback(t.employee).select("employee_id", "risk_score")))


def _what_if_sql(score: str) -> str:
    return emp(f"""SELECT t.risk_tier, count(*) FILTER (WHERE s.risk_tier = t.risk_tier) AS before, count(*) FILTER (WHERE s.after_tier = t.risk_tier) AS after,
 count(*) FILTER (WHERE s.after_tier = t.risk_tier) - count(*) FILTER (WHERE s.risk_tier = t.risk_tier) AS change
 FROM (SELECT old_tier AS risk_tier, {TIER} AS after_tier FROM (SELECT risk_tier AS old_tier, {score} AS risk_score FROM scored WHERE {STAYED})) s,
 (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) t(risk_tier) GROUP BY 1""", SCORED)


REDUCED = "least(greatest(risk_score - 10, 0), 100)"


@query("m07_what_if_retier", _what_if_sql(f"CASE WHEN risk_tier IN ('High', 'Critical') THEN {REDUCED} ELSE risk_score END"))
def what_if(t):
    return risk.what_if_retier(risk.rule_based_fallback(t.employee.where(scores.is_active())), 20)


@query("m07_what_if_retier_everyone", _what_if_sql(REDUCED))
def what_if_everyone(t):
    return risk.what_if_retier(risk.rule_based_fallback(t.employee.where(scores.is_active())), 20, masked=False)


@query("m09_lift_at_k", emp(f"""
SELECT round(p, 6) AS precision_at_k, round(b, 6) AS base_rate, round(p / b, 4) AS lift FROM (
 SELECT CAST({cnt(f'pos <= floor(n * 0.1) AND {LEFT}')} AS DOUBLE) / {cnt('pos <= floor(n * 0.1)')} AS p, CAST({cnt(LEFT)} AS DOUBLE) / count(*) AS b
 FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, employee_id DESC) AS pos, count(*) OVER () AS n FROM scored))""", SCORED))
def lift(t):
    scored = risk.rule_based_fallback(t.employee).select("employee_id", "risk_score", "attrition")
    return risk.lift_at_k(scored, "risk_score", scores.is_attrited())


CHECKED_FEATURES = ("age", "salary", "engagement_score", "years_at_company")


@query("m01_features", emp("SELECT employee_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_samp(CAST({c} AS DOUBLE)) OVER (), 4) AS {c}" for c in CHECKED_FEATURES
) + " FROM employee"))
def features(t):
    labelled = risk.with_label(t.employee)
    scaled = risk.features().fit(labelled).transform(labelled).withColumn("v", vector_to_array("features"))
    names = risk.feature_names()
    return scaled.select("employee_id", *[round_half_up(F.col("v")[names.index(c)], 4).alias(c) for c in CHECKED_FEATURES])


def trained(t):
    labelled = risk.with_label(t.employee)
    train, _ = risk.split_by_key(labelled)
    model = risk.logistic(train)
    return model, risk.risk_tiers(risk.score_batch(model, labelled))


def model_rows(labelled):
    """Key, label and inputs, written once: indexer, scaler and classifiers read the rows several times."""
    return written_table(labelled.select("employee_id", risk.LABEL, *risk.NUMERIC_FEATURES, *risk.CATEGORICAL_FEATURES), "model_rows")


@query("m02_train_compare")
def train_compare(t):
    train, test = risk.split_by_key(model_rows(risk.with_label(t.employee)))
    return risk.train_compare(train, test)


@query("m03_score_batch")
def score_batch(t):
    _, scored = trained(t)
    return scored.select("employee_id", "attrition", "model_probability", "risk_score", "risk_tier")


@query("m05_top_drivers")
def top_drivers(t):
    model, scored = trained(t)
    return risk.top_drivers(model, scored).select("employee_id", "risk_score", "risk_tier", "top_drivers", "recommended_action")


@query("m06_feature_importance")
def feature_importance(t):
    model, scored = trained(t)
    return risk.feature_importance(model, scored)


@query("m03_scores_in_range", emp("SELECT count(*) AS n, 0 AS outside, 4 AS tiers FROM employee"))
def scores_in_range(t):
    """Every employee is scored within bounds and falls into one of the four tiers."""
    _, scored = trained(t)
    ok = F.col("model_probability").between(0, 1) & F.col("risk_score").between(0, 100) & F.col("risk_tier").isNotNull()
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).cast("int").alias("outside"),
        F.count_distinct("risk_tier").cast("int").alias("tiers"),
    )


@query("m05_drivers_per_employee", emp("SELECT employee_id, 3 AS drivers, true AS has_action FROM employee"))
def drivers_per_employee(t):
    model, scored = trained(t)
    return risk.top_drivers(model, scored).select(
        "employee_id", F.size(F.split("top_drivers", r" \| ")).alias("drivers"), F.col("recommended_action").isNotNull().alias("has_action")
    )


@query("m06_importance_per_feature", "SELECT feature, true AS not_negative FROM (VALUES "
       + ", ".join(f"('{n}')" for n in risk.feature_names()) + ") f(feature)")
def importance_per_feature(t):
    model, scored = trained(t)
    return risk.feature_importance(model, scored).select("feature", (F.col("mean_abs_contribution") >= 0).alias("not_negative"))


def telling(t):
    """Employees whose exit depends on engagement and level, but for a part that no feature tells."""
    chance = F.pmod(F.xxhash64(F.lit("exit"), "employee_id"), F.lit(100))
    leaves = F.col("engagement_score") + F.when(F.col("job_level") == "L2", 0).otherwise(10) + chance / 3 < 62
    return risk.with_label(t.employee.withColumn("attrition", F.when(leaves, "Yes").otherwise("No")))


@query("m02_models_find_a_signal", """SELECT model, true AS better_than_chance, true AS lifts, true AS agrees FROM (VALUES ('Logistic Regression'), ('Random Forest'),
 ('Gradient Boosting (default)'), ('Gradient Boosting (tuned)')) m(model)""")
def models_find_a_signal(t):
    """Where exits depend on the features, every model beats chance and its top tenth the base rate; lift is precision over base rate."""
    train, test = risk.split_by_key(model_rows(telling(t)))
    agrees = F.abs(F.col("lift") - F.col("precision_at_k") / F.col("base_rate")) < 0.001
    return risk.train_compare(train, test).select("model", (F.col("auc") > 0.5).alias("better_than_chance"), (F.col("lift") > 1).alias("lifts"), agrees.alias("agrees"))


def forest_importance(t):
    train, test = risk.split_by_key(model_rows(telling(t)))
    prepared = risk.features().fit(train)
    columns = ["employee_id", risk.LABEL, "features"]
    forest = RandomForestClassifier(labelCol=risk.LABEL, numTrees=20, maxDepth=5, seed=7).fit(prepared.transform(train).select(*columns))
    return forest, prepared.transform(test).select(*columns)


@query("m06_permutation_importance", "SELECT feature, true AS not_negative, feature = 'engagement_score' AS leads, true AS same_again FROM (VALUES "
       + ", ".join(f"('{n}')" for n in risk.feature_names()) + ") f(feature)")
def permutation_importance(t):
    """Importance of the features of a forest: never negative, engagement first, the same on another dealing of the rows."""
    forest, rows = forest_importance(t)
    one = risk.permutation_importance(forest, rows, risk.feature_names())
    again = risk.permutation_importance(forest, rows.repartition(5), risk.feature_names()).select("feature", F.col("mean_abs_change").alias("other"))
    top = one.agg(F.max_by("feature", "mean_abs_change")).first()[0]
    return one.join(again, "feature").select("feature", (F.col("mean_abs_change") >= 0).alias("not_negative"), (F.col("feature") == top).alias("leads"),
                                             (F.abs(F.col("mean_abs_change") - F.col("other")) < 2e-6).alias("same_again"))
