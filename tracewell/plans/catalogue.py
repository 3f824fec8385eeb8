"""All queries by name and their SQL."""

from __future__ import annotations

from tracewell.plans import calling, cleaning, decisions, provenance, reading, streams

_MODULES = (provenance, cleaning, decisions, reading, streams, calling)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
