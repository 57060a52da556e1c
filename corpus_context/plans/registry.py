"""Registry of named queries: a Spark plan over the testdata and its DuckDB oracle SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, ops)
        return fn

    return deco
