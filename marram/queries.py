"""All queries of the library, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from marram.plans import domain_queries, graph_queries, review_queries, search_queries, text_queries  # noqa: F401
from marram.plans.registry import ORACLES, QUERIES

ORACLES["worker_stream"] = review_queries.ORACLE_STREAM
FLAGSHIP = graph_queries.graph_search_ranked

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
