"""All queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(fn):
        fn.sql = sql
        if fn.__name__.startswith("q_"):
            QUERIES[fn.__name__] = fn
            if sql:
                ORACLE_SQL[fn.__name__] = sql
        return fn

    return add
