"""Queries over the test tables, one or more per operator of the reference, with their DuckDB SQL."""

from __future__ import annotations

from . import backup_queries, capture_queries, grid_queries, invalidation_queries, memory_queries, packet_queries, quality_queries, ranking_queries, reconcile_queries, signal_queries, source_queries, structure_queries, walk_queries

MODULES = (ranking_queries, quality_queries, structure_queries, source_queries, memory_queries, signal_queries, walk_queries, capture_queries, grid_queries, reconcile_queries, backup_queries, packet_queries, invalidation_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
