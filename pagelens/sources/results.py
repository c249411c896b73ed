"""Result documents as JSON.

A document that the size of the site bounds (a summary, a report) is one row. What
grows with the site (page types, features, pairs) is written as JSON lines beside it,
by all tasks, never as one document.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST_SCHEMA = (
    "url string, method string, headers map<string,string>, cookies map<string,string>, "
    "path string, query string, request_id string, ts timestamp"
)


def write_json(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").json(path)
    return path


def write_document(row: DataFrame, path: str) -> str:
    """A one-row result as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_result(path: str, summary: DataFrame, parts: dict[str, DataFrame]) -> str:
    """A result document: its summary, and its parts as JSON lines."""
    for name, part in parts.items():
        write_json(part, f"{path}/{name}")
    write_document(summary, f"{path}/summary")
    return path


def read_result(
    spark: SparkSession, path: str, schema: T.StructType | str, required: bool = True
) -> DataFrame | None:
    """One part of a result. An optional part that is absent gives None."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as problem:
        if required or problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document written over several lines by another tool."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_interactables(found: DataFrame, path: str) -> str:
    """One JSON line per page with the list of its interactive elements. One file per page
    would make as many files as pages; `read_interactables` finds a page by filter."""
    return write_json(found, path)


def read_interactables(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_requests(requests: DataFrame, path: str) -> str:
    """Append captured requests to the log; readers keep the last one per URL."""
    requests.write.mode("append").json(path)
    return path


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The request log: the last write of each URL wins."""
    log = spark.read.schema(REQUEST_SCHEMA).json(path)
    row = F.struct("method", "headers", "cookies", "path", "query", "request_id", "ts")
    latest = log.groupBy("url").agg(F.max_by(row, "ts").alias("last"))
    return latest.select("url", "last.*")
