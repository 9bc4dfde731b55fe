"""Row scoping and column masking."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import masking


def scope_by_department(df: DataFrame, department: str | None = None) -> DataFrame:
    """A department user sees only own rows; None sees all."""
    return df if department is None else df.where(F.col("department") == department)


def mask_columns(df: DataFrame, role: str,
                 policy: Mapping[str, Callable[[str, str], Column]] = masking.DEFAULT_POLICY) -> DataFrame:
    """Apply the masking policy to the columns that exist."""
    masked = {name: rule(name, role) for name, rule in policy.items() if name in df.columns}
    return df.withColumns(masked) if masked else df


def assigned_paths(paths: DataFrame, assignments: DataFrame, user: str, path: str = "path",
                   prefix: str = "business_unit_path", user_col: str = "hrbp_employee_id") -> DataFrame:
    """Paths starting with a prefix assigned to the user.

    Each distinct path (one per department) is expanded to its own text prefixes, so the match
    is an equality join rather than a pairwise comparison.
    """
    mine = assignments.where(F.col(user_col) == user).select(F.col(prefix).alias("__prefix")).distinct()
    lengths = F.sequence(F.lit(0), F.length(path))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col(path), F.lit(1), n))
    expanded = paths.select(path).distinct().select(path, F.explode(prefixes).alias("__prefix"))
    return expanded.join(mine, "__prefix", "left_semi").select(path).distinct()


def scope_by_path(df: DataFrame, assignments: DataFrame, user: str, role: str, path: str = "path") -> DataFrame:
    """Privileged roles see everything, a business partner the assigned units, anyone else nothing."""
    if role in masking.DEMOGRAPHIC_ROLES:
        return df
    if role != masking.HRBP:
        return df.where(F.lit(False))
    allowed = assigned_paths(df.select(path).distinct(), assignments, user, path)
    return df.join(allowed, path, "left_semi")
