"""All queries of the engine itself."""

from __future__ import annotations

from termloom.plans import q_ontology, q_retrieval, q_routing, q_text, service  # noqa: F401 - they register
from termloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
