"""The queries of the training-data operators and the SQL of those that SQL can state."""

from __future__ import annotations

from siftstone.llm import checked, forms, language, leakage, mixing, near, oracle, packing, sampling, splitting

MODULES = (sampling, forms, near, splitting, leakage, packing, mixing, language, checked)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return dict(oracle.ORACLE)
