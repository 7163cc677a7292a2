"""The queries that bind operators to the fixed tables, and their SQL for another engine."""

from __future__ import annotations

from quarrylens.plans import catalog_queries, graph_queries, io_queries, java_queries, usage_queries

_MODULES = (graph_queries, catalog_queries, usage_queries, java_queries, io_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
