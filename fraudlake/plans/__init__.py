"""Registered queries; importing the modules fills the registry."""

from fraudlake.plans import (  # noqa: F401
    base_queries, case_queries, decision_queries, evidence_queries, graph_queries, pit_queries, retrieval_queries, stream_queries,
)
from fraudlake.plans.registry import ORACLES, QUERIES  # noqa: F401
