"""Registered queries: operators applied to tables, each with its SQL twin where SQL can express it."""

from evigraph.plans import (  # noqa: F401  they fill the registry
    code_queries,
    corpus_queries,
    evidence_queries,
    experiment_queries,
    gate_queries,
    graph_queries,
    inventory_queries,
    lane_queries,
    oracle_queries,
    relational_queries,
    rule_queries,
    scalar_queries,
    service_queries,
    session_queries,
    stats_queries,
    stream_queries,
    structure_queries,
)
from evigraph.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
