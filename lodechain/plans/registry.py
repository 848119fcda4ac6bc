"""All queries of the reference's own operators, and the SQL that must agree with them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query and, where SQL expresses it, its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    from lodechain.plans import chain_queries, evaluation_queries, event_queries, metric_queries  # noqa: F401


_load()
