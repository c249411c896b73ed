"""Helpers several operators share: words, tables, deterministic numbering, Arrow limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import written

# Characters that separate words, for regular expressions and for trimming.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
TABLE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE, -1)
    )


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker gets at once: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def is_training_row(doc_id: str = "doc_id") -> Column:
    """Rows labels may be learnt from; the others are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4, F.lit(0)) != 2


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows in a total order with their rank from 0, without gathering them in one task.

    Range partitions are written with their number and place; the counts of the partitions
    (as many as shuffle partitions) give each its first rank.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(
        ranged.withColumn("__part", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    first, total = {}, 0
    for row in sorted(kept.groupBy("__part").count().collect()):
        first[row["__part"]] = total
        total += row["count"]
    offset = F.lit(0).cast("long")
    if first:
        pairs = [F.lit(x) for part, at in first.items() for x in (part, at)]
        offset = F.element_at(F.create_map(*pairs), F.col("__part")).cast("long")
    return kept.withColumn(name, F.col("__place") + offset).drop("__part", "__place")
