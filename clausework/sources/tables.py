"""Readers for the input parquet tables.

Reads are lazy: Catalyst prunes columns and pushes filters into the scan,
so callers select only what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, per_core: int = 2) -> DataFrame:
    """Give CPU-heavy text work at least ``per_core`` partitions per core.

    Parquet cannot split inside a row group, so a text table stored as one
    large row group is scanned by one task however many splits it gets.
    When the scan has fewer partitions than ``per_core * defaultParallelism``
    the rows are hash-partitioned on ``key`` (deterministic under task
    retry).  At cluster scale the input splits already outnumber the cores
    and the plan is left alone: no shuffle is added.
    """
    target = per_core * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)
