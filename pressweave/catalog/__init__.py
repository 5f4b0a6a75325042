"""Registered queries and, where plain SQL can say the same, their ANSI twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            from .views import expand
            ORACLES[name] = expand(sql)
        return fn
    return keep


def load_all():
    from . import reading, texts, ingesting, costs, searching, vectors, upkeep, streams  # noqa: F401
    return QUERIES, ORACLES
