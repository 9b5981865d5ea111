"""Queries by name, with the SQL that a second engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `function(tables) -> DataFrame` under `name`."""

    def register(function):
        from corpusmill.tables import Tables

        _QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
