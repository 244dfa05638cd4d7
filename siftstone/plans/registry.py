"""Queries of the engine's own operators, and the SQL that must give the same rows."""

from __future__ import annotations

from siftstone.plans import chunk_queries, fact_queries, graph_queries, merge_queries, mode_queries, parse_queries, rank_queries, stream_queries, text_queries, vector_queries, wiki_queries
from siftstone.plans.base import ORACLES, QUERIES

MODULES = (text_queries, vector_queries, rank_queries, chunk_queries, graph_queries, parse_queries, merge_queries, mode_queries, stream_queries, wiki_queries, fact_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
