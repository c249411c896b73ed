"""Streams over request and response logs. The state is one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def seen_keys(stream: DataFrame, key: str = "url") -> DataFrame:
    """Each key once, when it is first seen."""
    return stream.dropDuplicates([key])


def last_values(stream: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """Latest row per key, in update mode; group state merges partial maxima."""
    latest = stream.groupBy(key).agg(F.max_by(F.struct(at, *values), at).alias("last"))
    return latest.select(key, "last.*")


def run_to_table(stream: DataFrame, path: str, mode: str) -> StreamingQuery:
    """Write every batch of a stream under its number, take all there is and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
