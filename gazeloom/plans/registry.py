"""Queries of the library's own operators, and their SQL."""

from gazeloom.plans import ingest_queries, serve_queries

MODULES = (ingest_queries, serve_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "ingest_summary"
