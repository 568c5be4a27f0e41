"""Column and table names that are safe as SQL identifiers."""
from __future__ import annotations

import re
from collections.abc import Iterable


def safe_name(name: str | None, fallback: str = "table") -> str:
    base = re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z_]", "_", (name or "").strip())).strip("_")
    if not base:
        return fallback
    return f"t_{base}" if base[0].isdigit() else base


def unique_names(names: Iterable[str | None]) -> list[str]:
    """Safe names; repeats get ``_1``, ``_2``."""
    out, seen = [], {}
    for i, raw in enumerate(names, 1):
        name = safe_name("" if raw is None else str(raw), f"col{i}")
        repeat = seen.get(name, -1) + 1
        seen[name] = repeat
        out.append(f"{name}_{repeat}" if repeat else name)
    return out
