"""Named queries bound to the data tables, each with its equivalent SQL."""

from __future__ import annotations

from importlib import import_module

from rosterlens.catalog.registry import REGISTRY, Query

MODULES = (
    "columns", "filters", "joins", "reports", "dashboards", "windows", "measures", "reshape", "hierarchy",
    "loads", "checks", "security", "risk", "sources", "streams",
)


def load() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"rosterlens.catalog.{module}")
    return REGISTRY
