"""All registered queries of the library proper."""

from __future__ import annotations

from skeinlake.plans import graph_queries, retrieval_queries, text_queries

_MODULES = [retrieval_queries, text_queries, graph_queries]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
