"""Banding, tiering and labelling expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.numeric import col

# Band edges and labels of the workforce reports.
AGE_EDGES = (25, 35, 45, 55, 65)
AGE_LABELS = ("Under 25", "25-34", "35-44", "45-54", "55-64", "65+")
AGE_LABELS_SHORT = ("<25", "25-34", "35-44", "45-54", "55-64", "65+")
TENURE_EDGES = (1, 2, 3, 5, 8, 12)
TENURE_LABELS = ("< 1 Year", "1-2 Years", "2-3 Years", "3-5 Years", "5-8 Years", "8-12 Years", "12+ Years")
TENURE_LABELS_SHORT = ("<1yr", "1-2yr", "2-3yr", "3-5yr", "5-8yr", "8-12yr", "12yr+")
TENURE_MONTH_EDGES = (6, 12, 24, 60, 120)
TENURE_MONTH_LABELS = ("<6m", "6-12m", "1-2y", "2-5y", "5-10y", "10y+")
SALARY_EDGES = (80_000, 120_000, 160_000, 200_000, 250_000, 350_000)
SALARY_LABELS = ("< $80K", "$80K-$120K", "$120K-$160K", "$160K-$200K", "$200K-$250K", "$250K-$350K", "$350K+")
ENGAGEMENT_EDGES = (40, 60, 75)
ENGAGEMENT_TIERS = ("High Risk", "Medium Risk", "Low Risk", "Engaged")
FLIGHT_RISK_BADGES = ("🔴 High Risk", "🟡 Medium Risk", "🟢 Low Risk", "✅ Engaged")
ENGAGEMENT_SEGMENTS = ("Low Engagement", "Moderate Engagement", "High Engagement")
COMPA_EDGES = (0.70, 0.80, 0.90, 1.10, 1.20)
COMPA_LABELS = (
    "< 0.70 — Severely Underpaid",
    "0.70-0.80 — At Risk",
    "0.80-0.90 — Below Midpoint",
    "0.90-1.10 — Market Range",
    "1.10-1.20 — Above Midpoint",
    "> 1.20 — Top of Band",
)
RISK_EDGES = (25, 45, 70)
RISK_TIERS = ("Low", "Medium", "High", "Critical")
PROMOTION_STATUSES = ("Critical — High Performer Overdue", "At Risk — Review Recommended", "Monitor", "On Track")
QUADRANT_LABELS = {
    ("High Engagement", "High Performance"): "⭐ Stars — Retain & Develop",
    ("High Engagement", "Core Performance"): "🔼 Potential — Coach Up",
    ("Low Engagement", "High Performance"): "⚠️ Flight Risk HiPo — Urgent Action",
    ("Low Engagement", "Low Performance"): "🔴 Exit Risk — Manage Out",
}
QUADRANT_DEFAULT = "📋 Core Workforce"


def cut(value: Column | str, edges: Sequence[float], labels: Sequence, closed: str = "left",
        bounds: tuple[float, float] | None = None) -> Column:
    """Map a number to one of len(edges)+1 labels.

    closed='left' puts an edge value in the upper band; closed='right' in the lower one and,
    with bounds=(lo, hi], returns null outside.
    """
    value = col(value)
    inside = (lambda edge: value < F.lit(edge)) if closed == "left" else (lambda edge: value <= F.lit(edge))
    result = F.when(value.isNull(), F.lit(None))
    if bounds is not None:
        result = result.when((value <= F.lit(bounds[0])) | (value > F.lit(bounds[1])), F.lit(None))
    for edge, label in zip(edges, labels):
        result = result.when(inside(edge), F.lit(label))
    return result.otherwise(F.lit(labels[-1]))


def band_index(value: Column | str, edges: Sequence[float], closed: str = "left",
               bounds: tuple[float, float] | None = None) -> Column:
    """1-based position of the band, for sorting."""
    return cut(value, edges, list(range(1, len(edges) + 2)), closed, bounds)


def age_band(age: Column | str, closed: str = "left") -> Column:
    if closed == "right":
        return cut(age, AGE_EDGES, AGE_LABELS_SHORT, "right", (0, 100))
    return cut(age, AGE_EDGES, AGE_LABELS)


def tenure_band(years: Column | str, closed: str = "left") -> Column:
    if closed == "right":
        return cut(years, TENURE_EDGES, TENURE_LABELS_SHORT, "right", (0, 100))
    return cut(years, TENURE_EDGES, TENURE_LABELS)


def tenure_band_index(years: Column | str, closed: str = "left") -> Column:
    return band_index(years, TENURE_EDGES, closed, (0, 100) if closed == "right" else None)


def tenure_band_sortable(years: Column | str) -> Column:
    """Band label prefixed with its position, e.g. '01. <1yr'."""
    labels = [f"{i:02d}. {label}" for i, label in enumerate(TENURE_LABELS_SHORT, 1)]
    return cut(years, TENURE_EDGES, labels)


def tenure_band_months(months: Column | str) -> Column:
    return cut(months, TENURE_MONTH_EDGES, TENURE_MONTH_LABELS)


def salary_band(salary: Column | str) -> Column:
    return cut(salary, SALARY_EDGES, SALARY_LABELS)


def engagement_tier(score: Column | str, cuts: Sequence[float] = ENGAGEMENT_EDGES, closed: str = "left",
                    labels: Sequence[str] = ENGAGEMENT_TIERS) -> Column:
    return cut(score, cuts, labels, closed, (0, 100) if closed == "right" else None)


def flight_risk_category(score: Column | str) -> Column:
    return engagement_tier(score, labels=FLIGHT_RISK_BADGES)


def engagement_segment(score: Column | str, cuts: Sequence[float] = (50, 75)) -> Column:
    return cut(score, cuts, ENGAGEMENT_SEGMENTS)


def performance_segment(rating: Column | str) -> Column:
    return cut(rating, (3, 4), ("Low Performance", "Core Performance", "High Performance"))


def performance_group(rating: Column | str) -> Column:
    return cut(rating, (3, 4), ("Low Performer", "Core Performer", "High Performer"))


def compa_band(compa: Column | str) -> Column:
    return cut(compa, COMPA_EDGES, COMPA_LABELS)


def compa_band_index(compa: Column | str) -> Column:
    return band_index(compa, COMPA_EDGES)


def risk_tier(score: Column | str, cuts: Sequence[float] = RISK_EDGES) -> Column:
    """Low/Medium/High/Critical; the upper edge belongs to the lower tier."""
    return cut(score, cuts, RISK_TIERS, "right")


def promotion_status(gap: Column | str, rating: Column | str) -> Column:
    gap, rating = col(gap), col(rating)
    critical, at_risk, monitor, on_track = PROMOTION_STATUSES
    return (
        F.when((gap >= 3) & (rating >= 4), critical)
        .when((gap >= 2) & (rating >= 3), at_risk)
        .when(gap >= 1, monitor)
        .otherwise(on_track)
    )


def quadrant_label(engagement: Column | str, performance: Column | str) -> Column:
    """Strategic label of an engagement x performance cell."""
    engagement, performance = col(engagement), col(performance)
    result = None
    for (eng, perf), label in QUADRANT_LABELS.items():
        hit = (engagement == eng) & (performance == perf)
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise(QUADRANT_DEFAULT)


def rag(value: Column | str, middle_from: float, top_from: float, high_is_bad: bool = True,
        labels: Sequence[str] = ("Red", "Amber", "Green"), strict: bool = False) -> Column:
    """Traffic light from two thresholds.

    Values from `top_from` up are red when high is bad and green otherwise; values from
    `middle_from` up are amber. strict=True excludes the threshold itself.
    """
    value = col(value)
    bad, middle, good = labels
    reached = (lambda t: value > F.lit(t)) if strict else (lambda t: value >= F.lit(t))
    top, bottom = (bad, good) if high_is_bad else (good, bad)
    return F.when(reached(top_from), top).when(reached(middle_from), middle).otherwise(bottom)


def attrition_rag(rate_pct: Column | str, amber: float = 18, red: float = 25, **kw) -> Column:
    return rag(rate_pct, amber, red, True, **kw)


def engagement_rag(score: Column | str, amber: float = 60, green: float = 75, **kw) -> Column:
    return rag(score, amber, green, False, **kw)


def attendance_rag(value: Column | str, amber: float = 88, green: float = 95, **kw) -> Column:
    return rag(value, amber, green, False, **kw)
