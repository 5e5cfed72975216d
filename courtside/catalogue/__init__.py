"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.fixtures import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of the views under its own name, with its check SQL."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def number(column: str | Column, name: str | None = None, places: int = 4) -> Column:
    """A statistic as a rounded double, so that both engines print it alike."""
    value = F.col(column) if isinstance(column, str) else column
    rounded = F.round(value.cast("double"), places)
    return rounded.alias(name or column) if isinstance(column, str) else rounded.alias(name)


def number_sql(column: str, name: str | None = None, places: int = 4) -> str:
    return f"round(CAST({column} AS double), {places}) AS {name or column}"


def load() -> None:
    """Import the modules that register queries."""
    from courtside.catalogue import (  # noqa: F401
        cleaning,
        corpus,
        evaluation,
        integrity,
        loading,
        questions,
        text,
    )
