"""Registered queries: Spark form and, where it exists, the equivalent SQL."""

from __future__ import annotations

from bedside.plans.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", cte: str = ""):
    """Registers ``fn(spark, sf_dir)`` under ``name``; ``views`` are put in front of ``sql``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(views, cte, sql)
        return fn
    return register
