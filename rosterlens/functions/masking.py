"""Column masking by role, as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.numeric import col

# Roles and what each may see.
EXEC, HR_DIRECTOR, HRBP = "EXEC", "HR_DIRECTOR", "HRBP"
TALENT, ANALYST = "TA", "ANALYST"
COMP_ADMIN, COMPLIANCE = "COMP_ADMIN", "COMPLIANCE"
ALL_ROLES = (EXEC, HR_DIRECTOR, HRBP, TALENT, ANALYST, COMP_ADMIN, COMPLIANCE)
DEMOGRAPHIC_ROLES = (EXEC, HR_DIRECTOR, COMP_ADMIN, COMPLIANCE)
BIRTH_DATE_ROLES = (EXEC, HR_DIRECTOR, COMPLIANCE)
EXACT_PAY_ROLES = (EXEC, COMP_ADMIN, HR_DIRECTOR)
BANDED_PAY_ROLES = (HRBP, ANALYST)
PAY_STEP = 10_000


def mask_text(value: Column | str, role: str, allowed=DEMOGRAPHIC_ROLES) -> Column:
    return col(value) if role in allowed else F.lit("***")


def mask_birth_date(value: Column | str, role: str) -> Column:
    value = col(value)
    return value if role in BIRTH_DATE_ROLES else F.lit(None).cast("date")


def mask_salary(value: Column | str, role: str, step: int = PAY_STEP) -> Column:
    """Exact, nearest 10K, or nothing."""
    value = col(value).cast("double")
    if role in EXACT_PAY_ROLES:
        return value
    if role in BANDED_PAY_ROLES:
        return F.floor(value / F.lit(float(step)) + F.lit(0.5)) * F.lit(float(step))
    return F.lit(None).cast("double")


# Default policy: column name -> masking expression.
DEFAULT_POLICY = {
    "gender": mask_text,
    "ethnicity": mask_text,
    "birth_date": mask_birth_date,
    "salary": mask_salary,
    "total_comp": mask_salary,
}
