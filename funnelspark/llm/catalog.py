"""All queries of this subpackage."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = ["q_native", "q_tokens", "q_dedup", "q_models", "q_audit"]
for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["QUERIES", "SQL"]
