"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorcade.plans.telemetry import TELEMETRY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, telemetry: bool = True):
    """Register a function (spark, sf_dir) -> DataFrame; `sql` may use t, the telemetry view, and starts after its WITH."""

    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            ORACLE[name] = (f"WITH {TELEMETRY}" + (", " + body[1:] if body.startswith(",") else " " + body)) if telemetry else body
        return f

    return add
