"""Scoping and masking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.catalog.registry import query
from rosterlens.catalog.sql import emp
from rosterlens.functions import masking
from rosterlens.operators import security


@query("r01_scope_by_department", emp("SELECT employee_id, department, salary FROM employee WHERE department = 'HOUSEHOLD'"))
def scope_by_department(t):
    return security.scope_by_department(t.employee, "HOUSEHOLD").select("employee_id", "department", "salary")


@query("r01_scope_unrestricted", emp("SELECT employee_id, department, salary FROM employee"))
def scope_unrestricted(t):
    return security.scope_by_department(t.employee).select("employee_id", "department", "salary")


MASKED = {
    "exec": (masking.EXEC, "gender", "strftime(hire_date, '%Y-%m-%d')", "CAST(salary AS DOUBLE)"),
    "comp_admin": (masking.COMP_ADMIN, "gender", "CAST(NULL AS VARCHAR)", "CAST(salary AS DOUBLE)"),
    "compliance": (masking.COMPLIANCE, "gender", "strftime(hire_date, '%Y-%m-%d')", "CAST(NULL AS DOUBLE)"),
    "hrbp": (masking.HRBP, "'***'", "CAST(NULL AS VARCHAR)", "round(salary / 10000e0) * 10000"),
    "talent": (masking.TALENT, "'***'", "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"),
}
for _label, (_role, _gender, _birth, _salary) in MASKED.items():
    @query(f"r02_mask_columns_{_label}", emp(f"SELECT employee_id, {_gender} AS gender, {_birth} AS birth_date, {_salary} AS salary FROM employee"))
    def mask(t, role=_role):
        # The hire date stands in for a birth date.
        df = t.employee.select("employee_id", "gender", F.col("hire_date").alias("birth_date"), "salary")
        return security.mask_columns(df, role).withColumn("birth_date", F.date_format("birth_date", "yyyy-MM-dd"))


def scoped(t, user, role):
    df = t.employee.select("employee_id", F.concat_ws("/", "region", "location", "department").alias("path"))
    assignments = t.nation.where("n_nationkey % 3 = 0").join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("hrbp"), (F.col("n_nationkey") % 2).cast("string")).alias("hrbp_employee_id"),
        F.concat_ws("/", "r_name", "n_name").alias("business_unit_path"),
    )
    return security.scope_by_path(df, assignments, user, role)


ASSIGNED = """assigned AS (SELECT 'hrbp' || (n_nationkey % 2) AS u, r_name || '/' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)"""
PATHS = "paths AS (SELECT employee_id, region || '/' || location || '/' || department AS path FROM employee)"


@query("r03_scope_by_path_hrbp", emp("SELECT employee_id, path FROM paths WHERE EXISTS (SELECT 1 FROM assigned WHERE u = 'hrbp0' AND path LIKE p || '%')", ASSIGNED, PATHS))
def scope_hrbp(t):
    return scoped(t, "hrbp0", masking.HRBP)


@query("r03_scope_by_path_default_deny", emp("SELECT employee_id, path FROM paths WHERE false", PATHS))
def scope_deny(t):
    return scoped(t, "hrbp0", masking.ANALYST)


@query("r03_scope_by_path_privileged", emp("SELECT employee_id, path FROM paths", PATHS))
def scope_privileged(t):
    return scoped(t, "hrbp0", masking.EXEC)
