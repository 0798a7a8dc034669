"""Registered queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from gleaner.queries import facts, ingest, retrieval, sessions, sql, text

_PARTS = (retrieval, text, ingest, facts, sessions, sql)


def queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: twin for part in _PARTS for name, twin in part.ORACLES.items()}
