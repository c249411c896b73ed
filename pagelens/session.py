"""Session helpers: checkpoint folder, scratch paths, table scans."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: spark.checkpoint.dir, or where that is unset a
    folder of the session's warehouse, which executors share as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pagelens-scratch"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pagelens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the application's part of the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are written."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to Parquet in the shared folder and read back, so that readers of it
    get column and nested-field pruning as well as a short lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str, most_rows: int = 100_000) -> DataFrame:
    """`df` written once; marked for broadcast only if it is found to have few rows."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    context = spark.sparkContext
    if any("pagelens" in path for path in context.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    build = tempfile.mkdtemp(prefix="pagelens-ship-")  # on the driver; Spark copies it on
    archive = shutil.make_archive(f"{build}/pagelens", "zip", root, "pagelens")
    context.addPyFile(archive)
