"""Registered queries: every operator run on the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from trustframe.catalog import partition_queries, record_queries, run_queries, training_queries, update_queries

_MODULES = (update_queries, record_queries, partition_queries, training_queries, run_queries)


def all_queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
