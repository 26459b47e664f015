"""All queries of the library's core, by name, and their SQL."""

from __future__ import annotations

from doclattice.plans import nested_queries, round_trips, verify_queries

_MODULES = (nested_queries, verify_queries, round_trips)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
