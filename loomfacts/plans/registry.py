"""All queries of the core, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import core_problems, derived_queries, fact_queries, graph_queries, report_queries, source_queries

_MODULES = (core_problems, source_queries, fact_queries, report_queries, graph_queries, derived_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
