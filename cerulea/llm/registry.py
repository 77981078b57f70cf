"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: A module adds its functions named op*, and the SQL in its ORACLE_SQL where SQL can express them.
_MODULES = ("mixing", "licenses", "topk", "pii", "quality", "neardup", "langid", "decontam", "linededup", "sharding", "whitening", "resampling", "substrings")


def queries() -> dict:
    found = {}
    for name in _MODULES:
        module = importlib.import_module(f"cerulea.llm.{name}")
        found |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in _MODULES:
        found |= getattr(importlib.import_module(f"cerulea.llm.{name}"), "ORACLE_SQL", {})
    return found
