"""Pay, promotion, cost and risk expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.bands import risk_tier
from rosterlens.functions.numeric import col, round_half_up

# Years per promotion, replacement cost multiple, high-performer rating, benchmarks.
PROMOTION_PACE_YEARS = 2.8
REPLACEMENT_FACTOR = 1.5
HIGH_PERFORMER_RATING = 4
ATTRITION_BENCHMARK = 0.18
ENGAGEMENT_BENCHMARK = 65


def band_midpoint(band_min: Column | str, band_max: Column | str) -> Column:
    """Whole-dollar middle of a pay band (the half range is truncated)."""
    low, high = col(band_min), col(band_max)
    return (low + F.floor((high - low) / F.lit(2.0)).cast("int")).cast("int")


def compa_ratio_band_mid(salary: Column | str, band_min: Column | str, band_max: Column | str) -> Column:
    """Salary over band midpoint, null for a zero midpoint."""
    return F.try_divide(col(salary).cast("double"), band_midpoint(band_min, band_max).cast("double"))


def expected_promotions(years: Column | str, pace: float = PROMOTION_PACE_YEARS, digits: int = 2) -> Column:
    return round_half_up(col(years).cast("double") / F.lit(pace), digits)


def promotion_gap_raw(years: Column | str, promotions: Column | str, pace: float = PROMOTION_PACE_YEARS) -> Column:
    return col(years).cast("double") / F.lit(pace) - col(promotions)


def promotion_gap(years: Column | str, promotions: Column | str, pace: float = PROMOTION_PACE_YEARS,
                  digits: int = 2) -> Column:
    return round_half_up(promotion_gap_raw(years, promotions, pace), digits)


def total_comp(salary: Column | str, bonus: Column | str) -> Column:
    return col(salary) + col(bonus)


def is_attrited(attrition: Column | str = "attrition") -> Column:
    return col(attrition) == "Yes"


def is_active(attrition: Column | str = "attrition") -> Column:
    return col(attrition) == "No"


def is_high_performer(rating: Column | str = "performance_rating", minimum: int = HIGH_PERFORMER_RATING) -> Column:
    return col(rating) >= minimum


def is_disengaged(score: Column | str = "engagement_score", below: float = 40) -> Column:
    return col(score) < below


def attrition_flag(attrition: Column | str = "attrition") -> Column:
    return F.when(is_attrited(attrition), 1).otherwise(0)


def is_regrettable(attrition: Column | str = "attrition", rating: Column | str = "performance_rating",
                   minimum: int = HIGH_PERFORMER_RATING) -> Column:
    """1 for an exit of a high performer, else 0."""
    return F.when(is_attrited(attrition) & (col(rating) >= minimum), 1).otherwise(0)


def is_voluntary(attrition: Column | str = "attrition", reason: Column | str = "exit_reason") -> Column:
    """An exit with a stated reason; null, blank and 'N/A' count as not stated."""
    reason = col(reason)
    return is_attrited(attrition) & reason.isNotNull() & ~reason.isin("N/A", "")


def replacement_cost(salary: Column | str, factor: float = REPLACEMENT_FACTOR) -> Column:
    return F.floor(col(salary) * F.lit(factor)).cast("bigint")


def _shortfall(value: Column | str, target: float) -> Column:
    """Relative distance below a target, clipped to [0, 1]."""
    gap = (F.lit(float(target)) - col(value).cast("double")) / F.lit(float(target))
    return F.least(F.greatest(gap, F.lit(0.0)), F.lit(1.0))


def _early_tenure(years: Column | str, first: float, second: float) -> Column:
    years = col(years)
    return F.when(years < 1, F.lit(float(first))).when(years < 2, F.lit(float(second))).otherwise(F.lit(0.0))


def flight_risk_composite(engagement: Column | str = "engagement_score", satisfaction: Column | str = "satisfaction_score",
                          attendance: Column | str = "attendance_pct", years: Column | str = "years_at_company") -> Column:
    """35/25/20/20 blend of shortfalls below 60/50/85 and short tenure."""
    return (
        _shortfall(engagement, 60) * 35
        + _shortfall(satisfaction, 50) * 25
        + _shortfall(attendance, 85) * 20
        + _early_tenure(years, 20, 12)
    )


def rule_risk_score(engagement: Column | str = "engagement_score", satisfaction: Column | str = "satisfaction_score",
                    attendance: Column | str = "attendance_pct", years: Column | str = "years_at_company") -> Column:
    """35/25/15/25 blend of shortfalls below 60/55/88 and short tenure, one decimal."""
    return round_half_up(
        _shortfall(engagement, 60) * 35
        + _shortfall(satisfaction, 55) * 25
        + _shortfall(attendance, 88) * 15
        + _early_tenure(years, 25, 15),
        1,
    )


def rule_risk_tier(score: Column | str) -> Column:
    return risk_tier(score)


def retention_score(engagement: Column | str = "engagement_score", years: Column | str = "years_at_company",
                    rating: Column | str = "performance_rating", promotions: Column | str = "promotions") -> Column:
    """Base 70, adjusted by engagement, tenure, rating and promotions, kept within 0..100."""
    raw = (
        F.lit(70.0)
        + (col(engagement).cast("double") - F.lit(67.3)) * F.lit(0.3)
        + F.when(col(years) > 2, F.lit(10.0)).otherwise(F.lit(-8.0))
        + (col(rating) - F.lit(3)) * F.lit(3)
        + F.least(col(promotions), F.lit(3)) * F.lit(2)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
