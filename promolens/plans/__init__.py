"""Registered queries of the retail operators, each beside its DuckDB SQL."""

from __future__ import annotations

from . import functions_extract, relational, search_writes

FAMILIES = [relational, search_writes, functions_extract]


def queries() -> dict:
    return {name: run for f in FAMILIES for name, run in f.reg.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for f in FAMILIES for name, sql in f.reg.sql.items()}
