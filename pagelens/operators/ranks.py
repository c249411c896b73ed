"""Exact quantiles of large groups without bringing a group into one task.

Equal values are counted first. The distinct values are range-partitioned, each
partition totals itself, and running totals follow from the totals of the partitions
before it: a distributed prefix sum. A group held by a third of all rows, or all of
them, is therefore spread over every partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.session import shuffle_width, written


def running_counts(
    rows: DataFrame, group: str, value: str, weight: Column | None = None
) -> DataFrame:
    """(group, value, n, upto, total): weight of each distinct value, of all values up to
    it, and of the group."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.sum(F.lit(1).cast("bigint") if weight is None else weight).alias("n")
    )
    ranged = counted.repartitionByRange(shuffle_width(rows), group, value)
    # Written, so that partition numbers stay what the totals were taken with.
    placed = written(ranged.withColumn("part", F.spark_partition_id()), "ranked")
    totals = placed.groupBy(group, "part").agg(F.sum("n").alias("in_part"))
    # One row per group and partition it touches: few, as ranges keep groups together.
    before = W.partitionBy(group).orderBy("part")
    offsets = totals.select(
        group,
        "part",
        (F.sum("in_part").over(before) - F.col("in_part")).alias("offset"),
        F.sum("in_part").over(W.partitionBy(group)).alias("total"),
    )
    inside = W.partitionBy(group, "part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumn("local", F.sum("n").over(inside))
    return local.join(offsets, [group, "part"]).select(
        group, value, "n", (F.col("local") + F.col("offset")).alias("upto"), "total"
    )


def quantiles(counts: DataFrame, group: str, value: str, probabilities: dict) -> DataFrame:
    """Quantiles by linear interpolation, one named column each, from `running_counts`."""
    start = F.col("upto") - F.col("n")
    picks = []
    for name, p in probabilities.items():
        at = (F.col("total") - 1) * F.lit(p)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (start <= rank) & (rank < F.col("upto"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"{name}_{end}"))
        picks.append(F.max(at - F.floor(at)).alias(f"{name}_part"))
    found = counts.groupBy(group).agg(*picks)
    columns = [
        (
            F.col(f"{name}_lo")
            + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_part")
        ).alias(name)
        for name in probabilities
    ]
    return found.select(group, *columns)
