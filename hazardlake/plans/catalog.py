"""Named queries: a function over the views, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardlake.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_VIEWS = {
    "reports": Tables.REPORTS_SQL, "findings": Tables.FINDINGS_SQL, "analyses": Tables.ANALYSES_SQL,
    "barrier_rows": Tables.BARRIERS_SQL, "reviews": Tables.REVIEWS_SQL, "texts": Tables.TEXTS_SQL,
}


def views(*names: str) -> str:
    """WITH clause for the named views."""
    parts: list[str] = []
    for name in names:
        if name in ("findings", "barrier_rows") and "analyses" in names:
            continue
        parts.append(_VIEWS[name])
    return "WITH " + ",\n".join(parts)


def query(name: str, sql: str | None = None):
    """Register a query under its operator id; ``sql`` is left out where SQL cannot say it."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register
