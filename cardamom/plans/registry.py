"""All queries of the library by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import audit_queries, catalog_queries, content_queries, document_queries, release_queries, review_queries, study_queries

FLAGSHIP = "C01_stats_overview"
_PARTS = (study_queries, content_queries, release_queries, document_queries, review_queries, audit_queries, catalog_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
