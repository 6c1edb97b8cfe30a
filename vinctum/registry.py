"""All registered queries of the library's own operators, with their DuckDB SQL."""

from __future__ import annotations

from vinctum.demo import aggregates, cleaning, governance, linkage, offers, search, tables, texts, vectors

_MODULES = (linkage, cleaning, texts, offers, search, aggregates, tables, governance, vectors)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.Q.queries
    ORACLE_SQL |= _m.Q.oracles
