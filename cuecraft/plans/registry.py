"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from cuecraft.plans import chunks, entities, intervals, search

MODULES = [search, chunks, entities, intervals]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
