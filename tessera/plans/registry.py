"""Registry of named queries over the driver tables.

Each query is a callable ``(spark, sf_dir) -> DataFrame``; most also carry
an equivalent DuckDB SQL string (the correctness oracle). Result hygiene:
arrays are rendered as space-joined strings, doubles rounded to 6 places,
integers cast to BIGINT, every column aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)
