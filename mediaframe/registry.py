"""Registered queries: a callable of (spark, sf_dir), and for most an equivalent in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add
