"""Registers a module's queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registered() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator); the decorator takes the SQL, or nothing where there is none."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
