"""Named queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalake.plans.fixtures import FIXTURES, RUN_ERRORS_SQL

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

# Named sub-queries an oracle may mention; fixtures are added below, query modules add their own.
VIEWS: dict[str, str] = {name: fixture.sql() for name, fixture in FIXTURES.items()}
VIEWS["fx_run_errors"] = RUN_ERRORS_SQL


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def with_views(sql: str) -> str:
    """The query with a WITH list of every named sub-query it needs, in dependency order."""
    ordered: list[str] = []

    def need(body: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", body):
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered) + "\n" + sql
