"""Row-level expressions (P01-P32), each over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import LEVELS, case_bands, day, emp
from rosterlens.functions import bands, cleaning, dates, display, masking, scores
from rosterlens.functions.numeric import round_half_up
from rosterlens.operators.compensation import with_band_compa


def closed_right(x: str, edges, labels, low: float = 0, high: float = 100) -> str:
    return f"CASE WHEN {x} <= {low} OR {x} > {high} THEN NULL ELSE {case_bands(x, edges, labels, '<=')} END"


def per_employee(name: str, sql_columns: str, columns, source=None, ctes=()):
    """Register one query that adds expressions to every employee."""

    def build(t):
        df = t.employee if source is None else source(t)
        return df.select("employee_id", *[c.alias(n) for n, c in columns().items()])

    query(name, emp(f"SELECT employee_id, {sql_columns} FROM employee" if not ctes else
                    f"SELECT employee_id, {sql_columns} FROM base", *ctes))(build)


D = "CAST({} AS DOUBLE)".format
YEARS, ENG, SAT, ATT = D("years_at_company"), D("engagement_score"), D("satisfaction_score"), D("attendance_pct")

per_employee(
    "p01_age_band",
    f"{case_bands('age', bands.AGE_EDGES, bands.AGE_LABELS)} AS age_band, "
    f"{closed_right('age', bands.AGE_EDGES, bands.AGE_LABELS_SHORT)} AS age_band_right",
    lambda: {"age_band": bands.age_band("age"), "age_band_right": bands.age_band("age", "right")},
)
per_employee(
    "p02_tenure_band",
    f"{case_bands('years_at_company', bands.TENURE_EDGES, bands.TENURE_LABELS)} AS tenure_band, "
    f"{case_bands('years_at_company', bands.TENURE_EDGES, range(1, 8))} AS band_index, "
    f"{closed_right('years_at_company', bands.TENURE_EDGES, bands.TENURE_LABELS_SHORT)} AS tenure_band_right",
    lambda: {
        "tenure_band": bands.tenure_band("years_at_company"), "band_index": bands.tenure_band_index("years_at_company"),
        "tenure_band_right": bands.tenure_band("years_at_company", "right"),
    },
)
MONTHS = "((2001 - year(hire_date)) * 12 + 12 - month(hire_date))"
per_employee(
    "p03_tenure_band_months",
    f"{MONTHS} AS tenure_months, {case_bands(MONTHS, bands.TENURE_MONTH_EDGES, bands.TENURE_MONTH_LABELS)} AS tenure_band_code",
    lambda: {
        "tenure_months": dates.date_diff_calendar("month", "hire_date", F.lit("2001-12-31").cast("date")).cast("bigint"),
        "tenure_band_code": bands.tenure_band_months(
            dates.date_diff_calendar("month", "hire_date", F.lit("2001-12-31").cast("date"))
        ),
    },
)
per_employee(
    "p04_salary_band", f"{case_bands('salary', bands.SALARY_EDGES, bands.SALARY_LABELS)} AS salary_band",
    lambda: {"salary_band": bands.salary_band("salary")},
)
per_employee(
    "p05_engagement_tier",
    f"{case_bands('engagement_score', bands.ENGAGEMENT_EDGES, bands.ENGAGEMENT_TIERS)} AS engagement_tier, "
    f"{closed_right('engagement_score', bands.ENGAGEMENT_EDGES, bands.ENGAGEMENT_TIERS)} AS engagement_tier_right, "
    f"{case_bands('engagement_score', bands.ENGAGEMENT_EDGES, bands.FLIGHT_RISK_BADGES)} AS flight_risk_category",
    lambda: {
        "engagement_tier": bands.engagement_tier("engagement_score"),
        "engagement_tier_right": bands.engagement_tier("engagement_score", closed="right"),
        "flight_risk_category": bands.flight_risk_category("engagement_score"),
    },
)
MID = "(band_min + floor((band_max - band_min) / 2))"
LEVEL_BASE = "base AS (SELECT * FROM employee JOIN levels USING (job_level))"
per_employee(
    "p06_compa_ratio_band_mid",
    f"CAST({MID} AS INT) AS band_midpoint, round(CAST(salary AS DOUBLE) / {MID}, 4) AS compa_ratio",
    lambda: {
        "band_midpoint": scores.band_midpoint("band_min", "band_max"), "compa_ratio": round_half_up("compa_ratio", 4),
    },
    lambda t: with_band_compa(t.employee, t.job_levels), (LEVELS, LEVEL_BASE),
)
EXPECTED = f"{YEARS} / 2.8::DOUBLE"
per_employee(
    "p08_promotion_gap",
    f"round({EXPECTED}, 2) AS expected_promotions, round({EXPECTED} - promotions, 2) AS promotion_gap, "
    f"round({EXPECTED} - promotions, 1) AS promotion_gap_1dp",
    lambda: {
        "expected_promotions": scores.expected_promotions("years_at_company"),
        "promotion_gap": scores.promotion_gap("years_at_company", "promotions"),
        "promotion_gap_1dp": scores.promotion_gap("years_at_company", "promotions", digits=1),
    },
)
per_employee("p09_total_comp", "salary + bonus AS total_comp", lambda: {"total_comp": scores.total_comp("salary", "bonus")})
per_employee(
    "p10_attrition_flag", "CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END AS attrition_flag",
    lambda: {"attrition_flag": scores.attrition_flag()},
)
per_employee(
    "p11_is_regrettable", "CASE WHEN attrition = 'Yes' AND performance_rating >= 4 THEN 1 ELSE 0 END AS is_regrettable_exit",
    lambda: {"is_regrettable_exit": scores.is_regrettable()},
)
per_employee(
    "p12_performance_group",
    "CASE performance_rating WHEN 5 THEN 'High Performer' WHEN 4 THEN 'High Performer' WHEN 3 THEN 'Core Performer' "
    "ELSE 'Low Performer' END AS performance_group",
    lambda: {"performance_group": bands.performance_group("performance_rating")},
)
per_employee(
    "p13_engagement_segment",
    "CASE WHEN engagement_score >= 75 THEN 'High Engagement' WHEN engagement_score >= 50 THEN 'Moderate Engagement' "
    "ELSE 'Low Engagement' END AS engagement_segment",
    lambda: {"engagement_segment": bands.engagement_segment("engagement_score")},
)
RATIO = f"(CAST(salary AS DOUBLE) / {MID})"
per_employee(
    "p14_compa_band",
    f"{case_bands(RATIO, bands.COMPA_EDGES, bands.COMPA_LABELS)} AS compa_ratio_band, "
    f"{case_bands(RATIO, bands.COMPA_EDGES, range(1, 7))} AS band_index",
    lambda: {"compa_ratio_band": bands.compa_band("compa_ratio"), "band_index": bands.compa_band_index("compa_ratio")},
    lambda t: with_band_compa(t.employee, t.job_levels), (LEVELS, LEVEL_BASE),
)
GAP2 = f"round({EXPECTED} - promotions, 2)"
per_employee(
    "p15_promotion_status",
    f"CASE WHEN {GAP2} >= 3 AND performance_rating >= 4 THEN '{bands.PROMOTION_STATUSES[0]}' "
    f"WHEN {GAP2} >= 2 AND performance_rating >= 3 THEN '{bands.PROMOTION_STATUSES[1]}' "
    f"WHEN {GAP2} >= 1 THEN '{bands.PROMOTION_STATUSES[2]}' ELSE '{bands.PROMOTION_STATUSES[3]}' END AS promotion_status",
    lambda: {
        "promotion_status": bands.promotion_status(
            scores.promotion_gap("years_at_company", "promotions"), "performance_rating")
    },
)
SEG_E = case_bands("engagement_score", (50, 75), bands.ENGAGEMENT_SEGMENTS)
SEG_P = case_bands("performance_rating", (3, 4), ("Low Performance", "Core Performance", "High Performance"))
per_employee(
    "p16_quadrant_label",
    "CASE " + " ".join(f"WHEN {SEG_E} = '{e}' AND {SEG_P} = '{p}' THEN '{x}'" for (e, p), x in bands.QUADRANT_LABELS.items())
    + f" ELSE '{bands.QUADRANT_DEFAULT}' END AS quadrant_label",
    lambda: {
        "quadrant_label": bands.quadrant_label(
            bands.engagement_segment("engagement_score"), bands.performance_segment("performance_rating"))
    },
)
per_employee(
    "p17_rag",
    "CASE WHEN leave_count >= 25 THEN 'Red' WHEN leave_count >= 18 THEN 'Amber' ELSE 'Green' END AS leave_rag, "
    "CASE WHEN engagement_score >= 75 THEN 'Green' WHEN engagement_score >= 60 THEN 'Amber' ELSE 'Red' END AS engagement_rag, "
    "CASE WHEN attendance_pct >= 95 THEN 'Green' WHEN attendance_pct >= 88 THEN 'Amber' ELSE 'Red' END AS attendance_rag",
    lambda: {
        "leave_rag": bands.attrition_rag("leave_count"), "engagement_rag": bands.engagement_rag("engagement_score"),
        "attendance_rag": bands.attendance_rag("attendance_pct"),
    },
)
per_employee(
    "p18_replacement_cost", "CAST(floor(salary * 1.5) AS BIGINT) AS replacement_cost",
    lambda: {"replacement_cost": scores.replacement_cost("salary")},
)


def shortfall(x: str, target: float) -> str:
    return f"least(greatest(({target}::DOUBLE - {x}) / {target}::DOUBLE, 0e0), 1e0)"


def early(first: float, second: float) -> str:
    return f"CASE WHEN years_at_company < 1 THEN {first}e0 WHEN years_at_company < 2 THEN {second}e0 ELSE 0e0 END"


COMPOSITE = f"({shortfall(ENG, 60)} * 35 + {shortfall(SAT, 50)} * 25 + {shortfall(ATT, 85)} * 20 + {early(20, 12)})"
RULE = f"round({shortfall(ENG, 60)} * 35 + {shortfall(SAT, 55)} * 25 + {shortfall(ATT, 88)} * 15 + {early(25, 15)}, 1)"
RETENTION = (
    f"greatest(0e0, least(100e0, 70e0 + ({ENG} - 67.3::DOUBLE) * 0.3::DOUBLE + CASE WHEN years_at_company > 2 THEN 10e0 ELSE -8e0 END"
    " + (performance_rating - 3) * 3 + least(promotions, 3) * 2))"
)
per_employee(
    "p19_flight_risk_composite", f"round({COMPOSITE}, 4) AS flight_risk",
    lambda: {"flight_risk": round_half_up(scores.flight_risk_composite(), 4)},
)
TIER = case_bands("risk_score", bands.RISK_EDGES, bands.RISK_TIERS, "<=")
per_employee(
    "p20_rule_risk_score", f"risk_score, {TIER} AS risk_tier",
    lambda: {"risk_score": scores.rule_risk_score(), "risk_tier": scores.rule_risk_tier(scores.rule_risk_score())},
    None, (f"base AS (SELECT employee_id, {RULE} AS risk_score FROM employee)",),
)
per_employee(
    "p21_retention_score", f"round({RETENTION}, 4) AS retention_score",
    lambda: {"retention_score": round_half_up(scores.retention_score(), 4)},
)

# Raw code spellings derived from the orders table, as a messy source would deliver them.
RAW_SQL = """raw AS (SELECT o_orderkey AS id,
 CASE o_orderstatus WHEN 'F' THEN ' terminated ' WHEN 'O' THEN 'Active' ELSE lower(o_orderpriority) END AS status_raw,
 CASE o_orderkey % 6 WHEN 0 THEN 'ft' WHEN 1 THEN ' Part Time' WHEN 2 THEN 'CONTRACTOR' WHEN 3 THEN 'intern ' WHEN 4 THEN '???' END AS type_raw,
 CASE o_orderkey % 5 WHEN 0 THEN ' m' WHEN 1 THEN 'Female' WHEN 2 THEN 'x ' WHEN 3 THEN '' END AS gender_raw,
 CASE WHEN o_orderkey % 7 = 0 THEN '   ' ELSE concat('  ', o_orderpriority, ' ') END AS text_raw,
 CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_raw FROM orders)"""


def raw_codes(t):
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("id"),
        F.when(F.col("o_orderstatus") == "F", " terminated ").when(F.col("o_orderstatus") == "O", "Active")
        .otherwise(F.lower("o_orderpriority")).alias("status_raw"),
        F.when(key % 6 == 0, "ft").when(key % 6 == 1, " Part Time").when(key % 6 == 2, "CONTRACTOR")
        .when(key % 6 == 3, "intern ").when(key % 6 == 4, "???").alias("type_raw"),
        F.when(key % 5 == 0, " m").when(key % 5 == 1, "Female").when(key % 5 == 2, "x ").when(key % 5 == 3, "").alias("gender_raw"),
        F.when(key % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))).alias("text_raw"),
        F.when(key % 9 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_raw"),
    )


def codes_sql(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE upper(trim({x})) {whens} ELSE '{default}' END"


CODES_SQL = (
    f"{codes_sql('status_raw', cleaning.STATUS_CODES, 'Unknown')} AS employment_status_code, "
    f"{codes_sql('type_raw', cleaning.EMPLOYEE_TYPE_CODES, 'Full-Time')} AS employee_type_code, "
    f"{codes_sql('gender_raw', cleaning.GENDER_CODES, 'Prefer-not-to-say')} AS gender_code"
)


@query("p22_normalize_codes", f"WITH {RAW_SQL} SELECT id, {CODES_SQL} FROM raw")
def normalize_codes(t):
    return raw_codes(t).select(
        "id", cleaning.employment_status("status_raw").alias("employment_status_code"),
        cleaning.employee_type("type_raw").alias("employee_type_code"), cleaning.gender("gender_raw").alias("gender_code"),
    )


@query("p23_clean_string", f"""WITH {RAW_SQL} SELECT id, nullif(trim(text_raw), '') AS cleaned,
 substr(nullif(trim(text_raw), ''), 1, 5) AS shortened FROM raw""")
def clean_string(t):
    return raw_codes(t).select(
        "id", cleaning.clean_string("text_raw").alias("cleaned"), cleaning.clean_string("text_raw", 5).alias("shortened")
    )


@query("p24_safe_date", f"""WITH {RAW_SQL} SELECT id, strftime(try_strptime(date_raw, '%Y-%m-%d'), '%Y-%m-%d') AS parsed FROM raw""")
def safe_date(t):
    return raw_codes(t).select("id", F.date_format(dates.safe_date("date_raw"), "yyyy-MM-dd").alias("parsed"))


@query("p25_full_name", """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name || ' ' || c_mktsegment END AS full_name FROM customer""")
def full_name(t):
    last = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", cleaning.full_name("c_name", last).alias("full_name"))


per_employee(
    "p26_date_diff_calendar",
    "date_diff('year', hire_date, DATE '2001-12-31') AS years, date_diff('quarter', hire_date, DATE '2001-12-31') AS quarters, "
    "date_diff('month', hire_date, DATE '2001-12-31') AS months, date_diff('day', hire_date, DATE '2001-12-31') AS days",
    lambda: {
        f"{unit}s": dates.date_diff_calendar(unit, "hire_date", F.lit("2001-12-31").cast("date")).cast("bigint")
        for unit in ("year", "quarter", "month", "day")
    },
)
per_employee(
    "p27_month_trunc", f"{day('date_trunc(' + chr(39) + 'month' + chr(39) + ', hire_date)')} AS month_start",
    lambda: {"month_start": F.date_format(dates.month_trunc("hire_date"), "yyyy-MM-dd")},
)
per_employee(
    "p28_null_default", "coalesce(manager_id, -1) AS manager_id, coalesce(exit_reason, 'N/A') AS exit_reason",
    lambda: {"manager_id": cleaning.null_default("manager_id", -1), "exit_reason": cleaning.null_default("exit_reason", "N/A")},
)
per_employee(
    "p29_surrogate_key",
    "md5(concat_ws('-', coalesce(CAST(employee_id AS VARCHAR), '_null_'), coalesce(exit_reason, '_null_'))) AS surrogate_key",
    lambda: {"surrogate_key": cleaning.surrogate_key("employee_id", "exit_reason")},
)
per_employee(
    "p30_mask_by_role",
    "gender AS gender_exec, '***' AS gender_analyst, CAST(salary AS DOUBLE) AS salary_exec, "
    "floor(salary / 10000e0 + 0.5::DOUBLE) * 10000 AS salary_analyst, CAST(NULL AS DOUBLE) AS salary_recruiter",
    lambda: {
        "gender_exec": masking.mask_text("gender", masking.EXEC), "gender_analyst": masking.mask_text("gender", masking.ANALYST),
        "salary_exec": masking.mask_salary("salary", masking.EXEC),
        "salary_analyst": masking.mask_salary("salary", masking.ANALYST),
        "salary_recruiter": masking.mask_salary("salary", masking.TALENT),
    },
)
per_employee(
    "p31_display_format",
    "'$' || printf('%.1f', round(salary / 1000e0, 1)) || 'K' AS salary_text, "
    f"printf('%.1f', round({ENG}, 1)) || '/100' AS engagement_text, format('{{:,}}', salary) AS salary_grouped, "
    f"CASE WHEN round({ENG} - 65, 1) < 0 THEN '' ELSE '+' END || printf('%.1f', round({ENG} - 65, 1)) || 'pp' AS points_text, "
    "printf('%.1f', round(attendance_pct / 100e0 * 100e0, 1)) || '%' AS attendance_text",
    lambda: {
        "salary_text": display.display_format("salary", "money_k"),
        "engagement_text": display.display_format("engagement_score", "score"),
        "salary_grouped": display.display_format("salary", "integer"),
        "points_text": display.signed_points(F.col("engagement_score").cast("double") - 65),
        "attendance_text": display.display_format(F.col("attendance_pct").cast("double") / 100, "percent"),
    },
)
SHIFTED = "CAST(hire_date - INTERVAL 3 MONTH AS DATE)"
per_employee(
    "p32_fiscal_columns",
    f"CAST(year({SHIFTED}) + 1 AS INT) AS fiscal_year, CAST(quarter({SHIFTED}) AS INT) AS fiscal_quarter_num, "
    f"'FY' || lpad(CAST((year({SHIFTED}) + 1) % 100 AS VARCHAR), 2, '0') || '-Q' || quarter({SHIFTED}) AS fiscal_quarter_label, "
    f"CAST(month({SHIFTED}) AS INT) AS fiscal_month_num, "
    f"'FY' || lpad(CAST((year({SHIFTED}) + 1) % 100 AS VARCHAR), 2, '0') || '-P' || lpad(CAST(month({SHIFTED}) AS VARCHAR), 2, '0') AS fiscal_period_label",
    lambda: dates.fiscal_columns("hire_date"),
)
