"""Parquet table reader that keeps per-row text work parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an input that arrives in fewer partitions than the
    session can run at once (one small file = one split). Inputs that are
    already split at least that finely — any large table — are returned
    unchanged, so this never adds a shuffle at scale."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def read_table(spark: SparkSession, directory: str, name: str, spread: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return balanced(df) if spread else df
