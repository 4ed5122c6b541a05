"""All queries of the core and their SQL."""

from __future__ import annotations

from kelpline.operators import audit_queries, catalog_queries, entity_queries, file_queries, graph_queries, page_queries, ranking_queries, reference_queries, retrieval_queries, store_queries, structure_queries

_MODULES = [reference_queries, entity_queries, file_queries, retrieval_queries, ranking_queries, graph_queries, catalog_queries, structure_queries, audit_queries, store_queries, page_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
