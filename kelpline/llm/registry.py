"""The queries of this package and their SQL."""

from __future__ import annotations

from kelpline.llm import file_queries, name_queries, text_queries, vector_queries

_MODULES = [vector_queries, file_queries, name_queries, text_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
