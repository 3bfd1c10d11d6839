"""All queries of the core, by name, and the SQL each is compared with."""

from __future__ import annotations

from . import corpus_queries, noise_queries, parse_queries, result_queries

_MODULES = (noise_queries, corpus_queries, result_queries, parse_queries)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
