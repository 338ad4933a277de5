"""Registry of queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "rt14_hybrid_search"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its DuckDB twin."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add
