"""Queries of the engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from covenant.bindings import ROLE_SQL, Roles

#: Modules that register queries.
MODULES = ("scans", "predicates", "joining", "aggregating", "windowing", "ordering", "combining", "scalars", "texts", "incremental", "composite", "records", "searching", "runs", "sequences", "screens", "keeping", "synthesis")


@dataclass(frozen=True)
class Query:
    """A query, the inventory rows it covers and its SQL for DuckDB."""

    name: str
    covers: tuple[str, ...]
    run: Callable[[Roles], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Callable[[Roles], DataFrame]], Callable[[Roles], DataFrame]]:
    """Register a function of the role views as a query. ``sql`` may read the roles as tables."""

    def register(run: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, tuple(covers.split()), run, with_roles(sql) if sql else None)
        return run

    return register


def with_roles(body: str) -> str:
    """The SQL with those role views in front that it or they read."""
    need: list[str] = []

    def add(text: str) -> None:
        for role, definition in ROLE_SQL.items():
            if role not in need and f"{role}" in _words(text):
                add(definition)
                if role not in need:
                    need.append(role)

    add(body)
    ctes = ",\n".join(f"{role} AS ({ROLE_SQL[role]})" for role in need)
    body = body.strip()
    if not ctes:
        return body
    head = next((w for w in ("WITH RECURSIVE", "WITH") if body.upper().startswith(w)), "")
    return f"{head} {ctes},\n{body[len(head):]}" if head else f"WITH {ctes}\n{body}"


def _words(text: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"covenant.plans.{module}")
    return _QUERIES


def all_of(name: str) -> Query:
    """A query that a module before this one has registered."""
    return _QUERIES[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=q.run: run(Roles(spark, sf_dir))) for name, q in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in all_queries().items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily brief: issuers with new developments, worst first."""
    return all_queries()["q07_morning_brief"].run(Roles(spark, sf_dir))
