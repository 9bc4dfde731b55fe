"""Conforming raw text: trimming, code mapping, defaults, keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.numeric import col

# Accepted spellings of the raw codes.
STATUS_CODES = {
    "ACTIVE": "Active", "TERMINATED": "Terminated", "LEAVE": "LOA", "LOA": "LOA", "INACTIVE": "Inactive",
}
EMPLOYEE_TYPE_CODES = {
    "FULL TIME": "Full-Time", "FULL-TIME": "Full-Time", "FT": "Full-Time",
    "PART TIME": "Part-Time", "PART-TIME": "Part-Time", "PT": "Part-Time",
    "CONTRACTOR": "Contract", "CONTRACT": "Contract", "INTERN": "Intern",
}
GENDER_CODES = {
    "M": "Male", "MALE": "Male", "F": "Female", "FEMALE": "Female",
    "NB": "Non-binary", "NON-BINARY": "Non-binary", "X": "Non-binary",
}


def clean_string(raw: Column | str, length: int | None = None) -> Column:
    """Trimmed text, null when blank, optionally cut to a column width."""
    text = F.trim(col(raw))
    text = F.when(text != "", text)
    return text if length is None else F.substring(text, 1, length)


def normalize_codes(raw: Column | str, mapping: Mapping[str, str], default: str) -> Column:
    """Canonical code for any accepted spelling; the default for everything else, null included."""
    key = F.upper(F.trim(col(raw)))
    spellings: dict[str, list[str]] = {}
    for spelling, code in mapping.items():
        spellings.setdefault(code, []).append(spelling)
    result = None
    for code, names in spellings.items():
        result = F.when(key.isin(names), code) if result is None else result.when(key.isin(names), code)
    return result.otherwise(default)


def employment_status(raw: Column | str) -> Column:
    return normalize_codes(raw, STATUS_CODES, "Unknown")


def employee_type(raw: Column | str) -> Column:
    return normalize_codes(raw, EMPLOYEE_TYPE_CODES, "Full-Time")


def gender(raw: Column | str) -> Column:
    return normalize_codes(raw, GENDER_CODES, "Prefer-not-to-say")


def full_name(first: Column | str, last: Column | str) -> Column:
    """First and last name; null when either is missing."""
    return F.concat(col(first), F.lit(" "), col(last))


def null_default(value: Column | str, default) -> Column:
    return F.coalesce(col(value), F.lit(default))


def null_if(value: Column | str, *markers: str) -> Column:
    """Null for any of the marker values."""
    value = col(value)
    return F.when(~value.isin(*markers), value)


def surrogate_key(*columns: Column | str) -> Column:
    """Stable text key from the natural key; a missing part hashes as its own marker."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("_null_")) for c in columns]
    return F.md5(F.concat_ws("-", *parts))
