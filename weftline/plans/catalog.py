"""Queries of the library by name, and SQL for the same results."""

from __future__ import annotations

from . import record_queries, row_queries, text_queries, url_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(SQL)
