"""Query registry: a Spark callable and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearsay.plans.views import SQL_VIEWS, SQL_NEEDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, tuple[str, ...]] = {}


def with_views(uses: str, body: str, ctes: str = "") -> str:
    """Prefix a SQL body with the canonical views it needs."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in SQL_NEEDS.get(name, ()):
            need(other)
        if name not in names:
            names.append(name)

    for name in uses.split():
        if not name.endswith("_view"):  # plain driver tables need no view
            need(name)
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in names]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def query(name: str, rows: str = "", uses: str = "", sql: str | None = None, ctes: str = ""):
    """Register a query; ``rows`` names the inventory rows it covers."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        ROWS[name] = tuple(rows.split())
        if sql is not None:
            ORACLES[name] = with_views(uses, sql, ctes)
        return fn

    return register
