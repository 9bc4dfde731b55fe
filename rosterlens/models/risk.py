"""Flight-risk models on pyspark.ml: features, comparison, scoring, tiers, drivers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions import bands, scores
from rosterlens.functions.numeric import count_if, n_rows, round_half_up, safe_divide
from rosterlens.operators.grouping import exact_quantiles
from rosterlens.operators.ranking import top_fraction
from rosterlens.operators.reshape import domain_index, stack_rows, union_all
from rosterlens.session import cut_lineage, written_table

NUMERIC_FEATURES = (
    "age", "years_at_company", "salary", "bonus", "performance_rating", "attendance_pct", "training_hours",
    "engagement_score", "satisfaction_score", "promotions", "leave_count", "level_rank",
)
CATEGORICAL_FEATURES = ("gender", "department", "work_mode")
LABEL = "label"

# Share of the scored population below each tier's upper edge.
TIER_QUANTILES = (0.50, 0.85, 0.975)

# Suggested step per leading driver.
ACTIONS = {
    "engagement_score": "Schedule a stay interview",
    "satisfaction_score": "Review role and workload",
    "salary": "Review pay position",
    "bonus": "Review pay position",
    "promotions": "Discuss career path",
    "years_at_company": "Strengthen onboarding support",
    "training_hours": "Offer development plan",
    "attendance_pct": "Offer wellbeing support",
    "leave_count": "Offer wellbeing support",
}
DEFAULT_ACTION = "Manager check-in"


def with_label(employee: DataFrame) -> DataFrame:
    """Numeric inputs as doubles, level as an ordinal, outcome as the label."""
    ranked = employee.withColumn("level_rank", F.substring("job_level", 2, 1).cast("double"))
    doubles = {c: F.col(c).cast("double") for c in NUMERIC_FEATURES}
    return ranked.withColumns({**doubles, LABEL: scores.attrition_flag().cast("double")})


def features(numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES) -> Pipeline:
    """Ordinal encoding of categories, assembly, standard scaling."""
    indexed = [f"{c}_index" for c in categorical]
    stages = [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[*numeric, *indexed], outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]
    return Pipeline(stages=stages)


def feature_names(numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES) -> list[str]:
    return [*numeric, *categorical]


def split_by_key(df: DataFrame, key: str = "employee_id", train_tenths: int = 8) -> tuple[DataFrame, DataFrame]:
    """Repeatable split on a hash of the key; a recomputed partition lands on the same side."""
    slot = F.pmod(F.xxhash64(key), F.lit(10))
    return df.where(slot < train_tenths), df.where(slot >= train_tenths)


def logistic(train: DataFrame, max_iter: int = 50) -> PipelineModel:
    pipeline = Pipeline(stages=[*features().getStages(), LogisticRegression(labelCol=LABEL, maxIter=max_iter, regParam=0.01)])
    return pipeline.fit(train)


def train_compare(train: DataFrame, test: DataFrame, fraction: float = 0.1, key: str = "employee_id") -> DataFrame:
    """AUC, precision in the top fraction and lift of four classifiers, one row each.

    Both tables are read several times: hand over written ones.
    """
    prepared = features().fit(train)
    columns = [key, LABEL, "features"]
    train_x = cut_lineage(prepared.transform(train).select(*columns))
    test_x = cut_lineage(prepared.transform(test).select(*columns))
    boosted = GBTClassifier(labelCol=LABEL, maxIter=10, seed=7)
    grid = ParamGridBuilder().addGrid(boosted.maxDepth, [2, 3]).addGrid(boosted.stepSize, [0.05, 0.1]).build()
    evaluator = BinaryClassificationEvaluator(labelCol=LABEL)
    candidates = {
        "Logistic Regression": LogisticRegression(labelCol=LABEL, maxIter=50, regParam=0.01),
        "Random Forest": RandomForestClassifier(labelCol=LABEL, numTrees=20, maxDepth=5, seed=7),
        "Gradient Boosting (default)": boosted,
        "Gradient Boosting (tuned)": TrainValidationSplit(
            estimator=boosted, estimatorParamMaps=grid, evaluator=evaluator, trainRatio=0.8, seed=7
        ),
    }
    rows = []
    for name, estimator in candidates.items():
        # The area under the curve and the positions of the top fraction read the scores several times.
        scored = written_table(estimator.fit(train_x).transform(test_x).select(
            key, LABEL, vector_to_array("rawPrediction")[1].alias("rawPrediction"), round_half_up(vector_to_array("probability")[1], 6).alias("probability"),
        ), "scored")
        auc = evaluator.evaluate(scored)
        rows.append(lift_at_k(scored.drop("rawPrediction"), "probability", F.col(LABEL) == 1, fraction, key).withColumns(
            {"model": F.lit(name), "auc": F.lit(float(auc))}
        ))
    return union_all(rows).select("model", "auc", "precision_at_k", "base_rate", "lift")


def lift_at_k(scored: DataFrame, score: str, outcome: Column, fraction: float = 0.1, key: str = "employee_id") -> DataFrame:
    """Precision among the highest-scored fraction over the base rate."""
    flagged = top_fraction(scored.withColumn("__hit", outcome), score, fraction, key)
    g = flagged.agg(
        count_if(F.col("in_top") & F.col("__hit")).alias("hits"), count_if(F.col("in_top")).alias("k"),
        count_if(F.col("__hit")).alias("positives"), n_rows().alias("n"),
    )
    precision, base = safe_divide(F.col("hits"), F.col("k")), safe_divide(F.col("positives"), F.col("n"))
    return g.select(
        round_half_up(precision, 6).alias("precision_at_k"), round_half_up(base, 6).alias("base_rate"),
        round_half_up(safe_divide(precision, base), 4).alias("lift"),
    )


def score_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probability and 0-100 score (two decimals) for every row."""
    scored = model.transform(df).withColumn("model_probability", round_half_up(vector_to_array("probability")[1], 6))
    return scored.withColumn("risk_score", round_half_up(F.col("model_probability") * 100, 2)).drop(
        "probability", "rawPrediction", "prediction"
    )


def risk_tiers(scored: DataFrame, quantiles: Sequence[float] = TIER_QUANTILES, score: str = "risk_score") -> DataFrame:
    """Low to Critical by population percentiles of the score.

    Scores have two decimals, so the quantiles run over at most 10,001 distinct values; the
    three thresholds enter as one-row subqueries.
    """
    edges = exact_quantiles(scored, [], score, {f"e{i}": q for i, q in enumerate(quantiles)}, distributed=False)
    low, medium, high, critical = bands.RISK_TIERS
    e0, e1, e2 = (edges.select(f"e{i}").scalar() for i in range(3))
    value = F.col(score)
    return scored.withColumn(
        "risk_tier", F.when(value > e2, critical).when(value > e1, high).when(value > e0, medium).otherwise(low)
    )


def tier_counts(scored: DataFrame, tier: str = "risk_tier") -> DataFrame:
    return scored.groupBy(tier).agg(n_rows().alias("n")).withColumn("tier_order", domain_index(tier, bands.RISK_TIERS))


def contributions(model: PipelineModel) -> Column:
    """Per-feature contribution to the log-odds: coefficient times the standardised value.

    Exact for a linear model; the vector stays in the JVM as an array column.
    """
    coefficients = [float(c) for c in model.stages[-1].coefficients]
    weights = F.array(*[F.lit(c) for c in coefficients])
    return F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)


def top_drivers(model: PipelineModel, scored: DataFrame, k: int = 3) -> DataFrame:
    """The k features pushing each employee's risk up most, 'a | b | c', and a suggested action."""
    names = F.array(*[F.lit(n) for n in feature_names()])
    pairs = F.arrays_zip(contributions(model).alias("weight"), names.alias("name"))
    ranked = F.slice(F.reverse(F.array_sort(pairs)), 1, k)
    with_names = scored.withColumn("__ranked", F.transform(ranked, lambda r: r["name"]))
    lead = F.col("__ranked")[0]
    action = reduce(lambda acc, item: acc.when(lead == item[0], item[1]), list(ACTIONS.items())[1:],
                    F.when(lead == next(iter(ACTIONS)), next(iter(ACTIONS.values())))).otherwise(DEFAULT_ACTION)
    return with_names.withColumns(
        {"top_drivers": F.array_join("__ranked", " | "), "recommended_action": action}
    ).drop("__ranked")


def feature_importance(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature from one aggregate."""
    names = feature_names()
    arrays = scored.select(contributions(model).alias("c"))
    wide = arrays.agg(*[F.avg(F.abs(F.col("c")[i])).alias(f"f{i}") for i in range(len(names))])
    return stack_rows(
        wide, [{"feature": F.lit(n), "mean_abs_contribution": round_half_up(F.col(f"f{i}"), 6)} for i, n in enumerate(names)]
    )


def permutation_importance(classifier, prepared: DataFrame, names: Sequence[str], key: str = "employee_id", bucket: int = 8192) -> DataFrame:
    """What a feature's value is worth to any fitted classifier, trees included, when other rows' values take its place.

    Rows are dealt to buckets and ordered by hashes of the key; each takes the value of the next row of its bucket (the last one of the
    first), one feature at a time. Per feature: the mean absolute change of the predicted probability and the rise of the mean
    log loss. The order is a hash of the key, so reruns agree; no bucket grows with the table. `prepared` has key, label and features.
    """
    count = prepared.count()
    buckets = max(1, count // bucket)
    place = prepared.select(key, LABEL, vector_to_array("features").alias("__x"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__b"), F.xxhash64(F.lit("order"), key).alias("__o"))
    ordered = Window.partitionBy("__b").orderBy("__o", key)
    first = F.first("__x").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    paired = place.withColumn("__y", F.coalesce(F.lead("__x").over(ordered), first))
    swapped = lambda j: F.transform("__x", lambda x, i: F.when(i == F.lit(j), F.element_at("__y", j + 1)).otherwise(x))
    # All versions of a row are scored beside each other, so that rows are neither multiplied nor joined.
    scored = paired
    for j in range(len(names) + 1):
        only = classifier.copy({classifier.featuresCol: "__v", classifier.probabilityCol: "__p", classifier.rawPredictionCol: "", classifier.predictionCol: ""})
        version = array_to_vector(F.col("__x") if j == 0 else swapped(j - 1))
        scored = only.transform(scored.withColumn("__v", version)).withColumn(f"p{j}", vector_to_array("__p")[1]).drop("__v", "__p")
    loss = lambda p: -F.ln(F.greatest(F.when(F.col(LABEL) == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(1e-9)))
    wide = scored.agg(
        n_rows().alias("n"),
        *[F.avg(F.abs(F.col(f"p{j}") - F.col("p0"))).alias(f"change{j}") for j in range(1, len(names) + 1)],
        *[F.avg(loss(f"p{j}") - loss("p0")).alias(f"rise{j}") for j in range(1, len(names) + 1)],
    )
    return stack_rows(wide.where("n > 0"), [
        {"feature": F.lit(n), "mean_abs_change": round_half_up(F.col(f"change{j}"), 6), "log_loss_rise": round_half_up(F.col(f"rise{j}"), 6)}
        for j, n in enumerate(names, 1)
    ])


def rule_based_fallback(employee: DataFrame) -> DataFrame:
    """Rule score and tier for every employee when no model output exists."""
    scored = employee.withColumn("risk_score", scores.rule_risk_score())
    return scored.withColumns({
        "risk_tier": scores.rule_risk_tier("risk_score"),
        "model_probability": round_half_up(F.col("risk_score") / 100, 6),
    })


def what_if_retier(scored: DataFrame, boost: float, masked: bool = True) -> DataFrame:
    """Tier counts before and after an engagement boost worth half a score point each.

    masked=True lowers only High and Critical rows; False lowers every row.
    """
    at_risk = F.col("risk_tier").isin("High", "Critical")
    reduced = F.least(F.greatest(F.col("risk_score") - F.lit(boost * 0.5), F.lit(0.0)), F.lit(100.0))
    score = F.when(at_risk, reduced).otherwise(F.col("risk_score")) if masked else reduced
    tier_after = scores.rule_risk_tier(score)
    wide = scored.agg(
        *[count_if(F.col("risk_tier") == t).alias(f"b{i}") for i, t in enumerate(bands.RISK_TIERS)],
        *[count_if(tier_after == t).alias(f"a{i}") for i, t in enumerate(bands.RISK_TIERS)],
    )
    return stack_rows(
        wide,
        [
            {"risk_tier": F.lit(t), "before": F.col(f"b{i}"), "after": F.col(f"a{i}"), "change": F.col(f"a{i}") - F.col(f"b{i}")}
            for i, t in enumerate(bands.RISK_TIERS)
        ],
    )
