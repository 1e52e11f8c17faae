"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# inventory ids of SURVEY section 2 covered by each query
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with its SQL check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
