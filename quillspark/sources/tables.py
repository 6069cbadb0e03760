"""Typed access to the parquet tables of a data directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; callers select columns so only those are read."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = table_path(sf_dir, name)
    if not os.path.exists(path) and "://" not in path:
        raise FileNotFoundError(f"table {name!r} not found at {path}")
    return spark.read.parquet(path)


#: Compressed bytes of a scan for one task of the text work behind it.
SPREAD_BYTES = 8 << 20


def spread_input(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan over tasks of at most about ``SPREAD_BYTES``, two for every task slot at least.

    A file of one row group is read by one task however many splits it is cut
    into, and a split of 128 MB of compressed text is several times as much
    work and memory once it is cut into sentences. The number of tasks grows
    with the bytes, so a task stays as it is. The size is the planner's
    estimate; nothing is read. The rows are shuffled once, as they are scanned.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(slots * 2, -(-size // SPREAD_BYTES)), key)
