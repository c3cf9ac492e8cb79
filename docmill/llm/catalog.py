"""All queries and SQL of this subpackage."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _n in range(1, 9):
    try:
        _m = importlib.import_module(f"docmill.llm.queries_{_n}")
    except ModuleNotFoundError as e:
        if e.name != f"docmill.llm.queries_{_n}":
            raise
        continue
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
