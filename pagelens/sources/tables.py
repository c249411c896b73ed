"""Scans of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to parse, in the splits of the scan: markup is never shuffled before the
    parse. How finely a small file is split is a setting of the session
    (spark.sql.files.maxPartitionBytes, row groups), not of this code."""
    return read_table(spark, folder, "pages")
