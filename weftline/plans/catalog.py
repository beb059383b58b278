"""The registered queries of the core engine and their SQL."""

from __future__ import annotations

from . import classify_queries, entity_queries, panel_queries, record_queries

_ALL = entity_queries.QUERIES | classify_queries.QUERIES | panel_queries.QUERIES | record_queries.QUERIES


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
