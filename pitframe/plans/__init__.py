"""All registered queries of the library."""

from . import bars_queries, evidence_queries, info_queries, metric_queries, model_queries, pit_queries, policy_queries, portfolio_queries, score_queries, signal_queries, source_queries, stream_queries, whole_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
