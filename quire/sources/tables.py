"""Parquet table access.

Tables are read lazily; callers select the columns they need so Catalyst
prunes the scan (``ReadSchema``) and pushes filters into the Parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


MIN_SCAN_SPLITS = "spark.quire.minScanSplits"


def spread(df: DataFrame) -> DataFrame:
    """A file written as one row group is read by one task. Where the session
    sets ``spark.quire.minScanSplits`` (tests and bench do, a cluster need not), a scan
    with fewer splits is dealt round-robin to that many; without it the scan is
    left as it is."""
    n = int(df.sparkSession.conf.get(MIN_SCAN_SPLITS, "0"))
    return df.repartition(n) if n and df.rdd.getNumPartitions() < n else df


# Tables whose rows carry whole texts: per-row work (regex, tokenising,
# hashing) dominates, so they are worth spreading over every slot.
TEXT_TABLES = {"documents", "conversations", "pages"}


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if balance is None:
        balance = name in TEXT_TABLES
    return spread(df) if balance else df
