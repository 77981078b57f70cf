"""The library's queries and the SQL that checks them, by name."""

from __future__ import annotations

from cerulea import oracle
from cerulea.queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
