"""Named queries over the test tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from tickloom.plans import conversations, indexes, services, tables, texts, timeseries

_MODULES = (timeseries, texts, conversations, tables, services, indexes)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}


flagship = timeseries.flagship
