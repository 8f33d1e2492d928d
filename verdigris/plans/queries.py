"""Registered queries of the retrieval operators and their SQL."""

from __future__ import annotations

from verdigris.plans import batch_queries, harness_queries, rank_queries, search_queries, text_queries  # noqa: F401
from verdigris.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
