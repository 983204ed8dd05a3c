"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, scratch_dir
from tessera.sources.tables import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: the six white-space characters of the contracts, [\x20\x09-\x0D]
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other code point stays as it is."""
    return F.translate(c, UPPER, LOWER)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    Catalyst inlines a computed column wherever it is used, also into lambda
    bodies, where it would be evaluated again for every element; a lambda
    variable is not inlined."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker. This package's code is
    shipped with each task, so its own globals are new in every task."""
    return vars(sys.modules.setdefault("tessera_worker_cache", ModuleType("tessera_worker_cache"))).setdefault(name, {})
