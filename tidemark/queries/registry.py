"""All registered queries: name -> callable, and name -> SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.queries import ledger, problems, relational, retrieval, temporal

MODULES = (problems, temporal, retrieval, ledger, relational)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
