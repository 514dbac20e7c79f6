"""All registered queries."""

from __future__ import annotations

import importlib

from .prelude import body
from .registry import QUERIES, SQL

MODULES = ["q_prepare", "q_features", "q_results", "q_profile", "q_model", "q_streaming"]
for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")


def full_sql() -> dict[str, str]:
    """Complete SQL text per query."""
    return {name: body(sql) for name, sql in SQL.items()}


__all__ = ["QUERIES", "SQL", "full_sql"]
