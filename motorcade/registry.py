"""All registered queries of the vehicle operators, and DuckDB SQL for the same rows."""

from __future__ import annotations

from motorcade.plans import edges, more_sql, relational, scalars, stateful  # noqa: F401  they register their queries
from motorcade.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
