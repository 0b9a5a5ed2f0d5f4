"""Queries of the problems tagged llm."""

from __future__ import annotations

import importlib

_MODULES = [importlib.import_module(f"threadloom.llm.{m}") for m in ("conversation_queries", "personal_queries", "neighbour_queries", "splitting_queries", "packing_queries", "mixing_queries", "abuse_queries")]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
