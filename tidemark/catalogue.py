"""All queries of the library and their SQL."""

from __future__ import annotations

from tidemark.plans import catalog_queries, record_queries  # noqa: F401  (they register their queries)
from tidemark.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
