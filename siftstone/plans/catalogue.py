"""The queries of the core, gathered from the plan modules."""

from __future__ import annotations

from siftstone.plans import audit_queries, corpus_queries, skewed_keys, training_queries

MODULES = (audit_queries, corpus_queries, training_queries, skewed_keys)
FLAGSHIP = "risk_score"


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
