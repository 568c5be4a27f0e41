"""Every registered query and the SQL it is checked against."""
from __future__ import annotations

import importlib

_MODULES = ["ledger", "vendors", "statements", "tables", "documents", "streams"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        part = getattr(importlib.import_module(f"{__name__}.{name}"), attribute)
        twice = out.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict[str, str]:
    return _collect("ORACLE")
