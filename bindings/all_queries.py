"""Importing this module registers every bound query."""

from __future__ import annotations

from bindings import (  # noqa: F401
    benchmark_queries,
    cost_queries,
    health_queries,
    inventory_queries,
    log_queries,
    policy_queries,
    pricing_queries,
    quality_queries,
    queue_queries,
    source_queries,
    stream_queries,
)
from bindings.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
