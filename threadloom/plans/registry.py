"""All core queries and their SQL."""

from __future__ import annotations

from threadloom.plans import core_queries, hierarchy_queries, join_queries, ledger_queries, message_queries, more_queries, scalar_queries, search_queries, window_queries

_MODULES = (core_queries, hierarchy_queries, more_queries, scalar_queries, ledger_queries, search_queries, window_queries, message_queries, join_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
