"""Queries by name, each with the SQL that says the same over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.views import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable:
    """Registers fn(views) under name; sql may use the views of operators.views.SQL."""

    def add(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            body = sql.strip()
            more = body[5:] if body.lower().startswith("with ") else None
            ORACLES[name] = f"with {'recursive ' if recursive else ''}{SQL.strip()}" + (f",\n{more}" if more else f"\n{body}")
        return fn

    return add
