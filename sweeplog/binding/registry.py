"""Name -> (query, SQL twin). A query takes (spark, sf_dir); the twin is None where SQL cannot express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def keep(query: Query) -> Query:
        REGISTRY[name] = (query, sql)
        return query

    return keep
