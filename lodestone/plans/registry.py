"""Queries of the library and their SQL, by name."""

from __future__ import annotations

from lodestone.plans import corpus_queries, retrieval_queries, service_queries, session_queries, source_queries, store_queries, table_queries, text_queries

MODULES = [text_queries, retrieval_queries, table_queries, source_queries, corpus_queries, session_queries, store_queries, service_queries]
QUERIES: dict = {}
SQL: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    SQL |= module.SQL
