"""All queries of the core, by name."""

from __future__ import annotations

from loomgraph.plans import graph_problems, graph_queries, record_queries, stream_queries

MODULES = [graph_problems, graph_queries, record_queries, stream_queries]

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
