"""Named query plans over the tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations


def _load() -> None:
    from . import evaluation_queries, graph_queries, join_queries, more_queries, other_queries, style_queries, text_queries  # noqa: F401


def queries() -> dict:
    """All queries by name."""
    _load()
    from .registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by name of query."""
    _load()
    from .registry import SQL

    return dict(SQL)
