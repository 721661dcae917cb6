"""The query catalogue: one entry per operator of the engine."""

from __future__ import annotations

from quillspark.plans import decision_queries, document_queries, domain_queries, guide_queries, letter_queries, registry, relational_queries, release_queries, resolution_queries, selection_queries, source_queries, text_queries  # noqa: F401

flagship = source_queries.flagship


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict:
    return registry.ORACLES
