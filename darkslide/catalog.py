"""All registered queries of the library and their SQL."""

from __future__ import annotations

from darkslide.plans import aggregate_queries, cull_queries, identity_queries, score_queries, sink_queries, source_queries, stream_queries, vector_queries
from darkslide.plans.registry import ORACLE_SQL, QUERIES

MODULES = (score_queries, cull_queries, aggregate_queries, vector_queries, identity_queries, source_queries, sink_queries, stream_queries)
FLAGSHIP = "w05_verdicts"

__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
