"""Queries over the star schema and their SQL: each operator on columns that stand for those of a run's tables."""

from __future__ import annotations

from plumbline.catalog import aggregates, joins, runs, texts

MODULES = (runs, joins, aggregates, texts)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
