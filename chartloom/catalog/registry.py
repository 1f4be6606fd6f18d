"""Registry of named queries and the oracle SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from chartloom.sources.clinic import oracle

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-01-15 12:00:00"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` may use the chart views by name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
