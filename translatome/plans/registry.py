"""Registered queries: functions of (spark, sf_dir), and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def also(*names: str) -> None:
    """Each query under its name with _whole too, as it was called while the plain name left rows out."""
    for name in names:
        QUERIES[f"{name}_whole"], SQL[f"{name}_whole"] = QUERIES[name], SQL[name]
