"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from rosterlens.sources import seeds

EMPLOYEE = """employee AS (
SELECT CAST(o.o_orderkey AS BIGINT) AS employee_id,
 concat('Emp ', CAST(o.o_orderkey AS VARCHAR)) AS employee_name,
 CAST(18 + (o.o_orderkey * 7) % 50 AS INT) AS age,
 CASE WHEN o.o_orderkey % 20 < 10 THEN 'Male' WHEN o.o_orderkey % 20 < 19 THEN 'Female' ELSE 'Non-binary' END AS gender,
 c.c_mktsegment AS department,
 concat('L', CAST(7 - CAST(substr(o.o_orderpriority,1,1) AS INT) AS VARCHAR)) AS job_level,
 CASE WHEN o.o_orderkey = 0 THEN NULL ELSE CAST(floor(o.o_orderkey / 8.0) AS BIGINT) END AS manager_id,
 n.n_name AS location, r.r_name AS region,
 CASE o.o_orderkey % 3 WHEN 0 THEN 'On-site' WHEN 1 THEN 'Hybrid' ELSE 'Remote' END AS work_mode,
 CAST(o.o_orderdate AS DATE) AS hire_date,
 CAST((DATE '2001-12-31' - CAST(o.o_orderdate AS DATE)) / 365.25 AS DECIMAL(5,2)) AS years_at_company,
 CAST(30000 + floor(o.o_totalprice) AS INT) AS salary,
 CAST(floor(o.o_totalprice * ((o.o_orderkey % 4) / 20.0)) AS INT) AS bonus,
 CAST(o.o_custkey % 8 AS INT) AS recruitment_source_id,
 CASE WHEN (o.o_orderkey * 37) % 100 < 3 THEN 1 WHEN (o.o_orderkey * 37) % 100 < 15 THEN 2
      WHEN (o.o_orderkey * 37) % 100 < 68 THEN 3 WHEN (o.o_orderkey * 37) % 100 < 94 THEN 4 ELSE 5 END AS performance_rating,
 CAST((7000 + (o.o_orderkey * 13) % 3001) / 100.0 AS DECIMAL(5,2)) AS attendance_pct,
 CAST((o.o_orderkey * 17) % 1201 / 10.0 AS DECIMAL(6,2)) AS training_hours,
 CAST((2000 + (o.o_orderkey * 101) % 8001) / 100.0 AS DECIMAL(6,2)) AS engagement_score,
 CAST((1000 + (o.o_orderkey * 211) % 9001) / 100.0 AS DECIMAL(6,2)) AS satisfaction_score,
 CAST((o.o_orderkey * 3) % 5 AS INT) AS promotions,
 CAST((o.o_orderkey * 5) % 31 AS INT) AS leave_count,
 CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS attrition,
 CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 11 <> 0 THEN concat('Reason ', CAST(o.o_orderkey % 6 AS VARCHAR)) END AS exit_reason
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


LEVELS = values("levels", "job_level, level_name, band_min, band_max, career_track, sort_order", seeds.JOB_LEVELS)
SOURCES = values(
    "sources", "recruitment_source_id, recruitment_source, source_type",
    [(i, *row) for i, row in enumerate(seeds.RECRUITMENT_SOURCES)],
)
RATINGS = values("ratings", "performance_rating, performance_label, is_high_performer, target_pct", seeds.RATINGS)
COMPA = """level_medians AS (SELECT job_level, quantile_cont(salary, 0.5) AS level_median_salary FROM employee GROUP BY job_level),
compa AS (SELECT e.*, m.level_median_salary, e.salary / m.level_median_salary AS compa_ratio_raw,
 round(e.salary / m.level_median_salary, 4) AS compa_ratio FROM employee e JOIN level_medians m USING (job_level))"""
EMPLOYEE_SOURCE = "es AS (SELECT * FROM employee JOIN sources USING (recruitment_source_id))"


def with_(*ctes: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + then


def emp(then: str, *ctes: str) -> str:
    """Statement over the employee table plus further CTEs."""
    return with_(EMPLOYEE, *ctes, then=then)


def cnt(cond: str = "true") -> str:
    return f"count(*) FILTER (WHERE {cond})"


def avg(x: str, cond: str | None = None, digits: int | None = 2) -> str:
    expr = f"CAST(sum({x}) AS DOUBLE) / count({x})" if cond is None else (
        f"CAST(sum({x}) FILTER (WHERE {cond}) AS DOUBLE) / nullif(count({x}) FILTER (WHERE {cond}), 0)"
    )
    return f"({expr})" if digits is None else f"round({expr}, {digits})"


def pct(num: str, den: str = "count(*)", digits: int | None = 2) -> str:
    expr = f"100e0 * ({num}) / nullif({den}, 0)"
    return f"({expr})" if digits is None else f"round({expr}, {digits})"


def ratio(num: str, den: str = "count(*)", default: str | None = "0") -> str:
    expr = f"CAST({num} AS DOUBLE) / nullif({den}, 0)"
    return f"({expr})" if default is None else f"coalesce({expr}, {default})"


def q(x: str, p: float, digits: int = 2) -> str:
    return f"round(quantile_cont(CAST({x} AS DOUBLE), {p}), {digits})"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


MALE, FEMALE = "gender = 'Male'", "gender = 'Female'"
LEFT, STAYED = "attrition = 'Yes'", "attrition = 'No'"
HIGH = "performance_rating >= 4"
MEAN_M, MEAN_F = avg("salary", MALE, None), avg("salary", FEMALE, None)
GAP = f"(100e0 * ({MEAN_M} - {MEAN_F}) / {MEAN_M})"


def case_bands(x: str, edges, labels, op: str = "<") -> str:
    whens = " ".join(f"WHEN {x} {op} {e} THEN {_literal(l)}" for e, l in zip(edges, labels))
    return f"CASE {whens} ELSE {_literal(labels[-1])} END"
