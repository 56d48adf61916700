"""The named queries of the engine, each with its DuckDB equivalent."""

from . import grid_queries, metric_queries, profile_queries, relation_queries, series_queries

_ALL = (series_queries, profile_queries, grid_queries, metric_queries, relation_queries)
QUERIES = {name: q for part in _ALL for name, q in part.QUERIES.items()}
SQL = {name: sql for part in _ALL for name, sql in part.SQL.items()}
