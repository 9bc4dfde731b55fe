"""The calculated columns of the measure model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions import bands, scores


def calculated_columns() -> dict[str, Column]:
    """Row-level columns; level_median_salary must be present for the compa-ratio."""
    return {
        "tenure_band": bands.tenure_band("years_at_company"),
        "age_band": bands.age_band("age"),
        "salary_band": bands.salary_band("salary"),
        "engagement_tier": bands.engagement_tier("engagement_score"),
        "attrition_binary": scores.attrition_flag(),
        "compa_ratio": F.coalesce(
            F.try_divide(F.col("salary").cast("double"), F.col("level_median_salary")), F.lit(1.0)
        ),
        "promotion_gap": scores.promotion_gap("years_at_company", "promotions", digits=1),
        "flight_risk_category": bands.flight_risk_category("engagement_score"),
        "is_regrettable_exit": F.when(scores.is_regrettable() == 1, "Yes").otherwise("No"),
        "performance_group": bands.performance_group("performance_rating"),
    }
