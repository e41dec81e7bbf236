"""All registered queries of the flow engine and their SQL."""

from __future__ import annotations

from flowloom.plans import flow_queries, metric_queries, score_queries, source_queries, stream_queries  # noqa: F401
from flowloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
