"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from tidemark.plans import corpus_queries, evaluation_queries, publishing_queries, retrieval_queries, understanding_queries

MODULES = (retrieval_queries, corpus_queries, evaluation_queries, understanding_queries, publishing_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
