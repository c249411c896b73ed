"""Feature table to vectors: numeric columns, standard scaling, profile, combination.

Statistics are two numbers per dimension, however many pages. They come to the driver
and go back as constants, so scaling itself is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.operators.ranks import quantiles, running_counts
from pagelens.session import written

# Standard deviations below this share of the mean are rounding noise of a constant.
_CONSTANT = 1e-12


def numeric_columns(features: DataFrame, *skip: str) -> list[str]:
    """Columns of a number type, booleans left out."""
    return [
        f.name
        for f in features.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def numeric_features(features: DataFrame, key: str = "page_id") -> DataFrame:
    """The key and the numeric columns, missing numbers as 0."""
    names = numeric_columns(features, key)
    return features.select(key, *names).fillna(0, subset=names)


def standard_vectors(features: DataFrame, key: str = "page_id") -> DataFrame:
    """(id, vector): each numeric column as (x - mean) / population deviation, 0 where the
    deviation is 0. `features` should be written or cheap: it is read twice."""
    filled = numeric_features(features, key)
    names = numeric_columns(filled, key)
    vector = F.array(*[F.col(n).cast("double") for n in names])
    return standardise(filled.select(F.col(key).alias("id"), vector.alias("vector")))


def standardise(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Standard-scale every dimension of a vector column."""
    each = vectors.select(F.posexplode(column).alias("dim", "x"))
    stats = each.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    rows = sorted(stats.collect(), key=lambda row: row.dim)
    if not rows:
        return vectors
    constant = [row.sd <= _CONSTANT * max(1.0, abs(row.mean)) for row in rows]
    means = F.lit([float(row.mean) for row in rows])
    # A constant dimension is multiplied by 0 rather than divided by its deviation.
    factors = F.lit(
        [0.0 if flat else 1.0 / row.sd for row, flat in zip(rows, constant, strict=True)]
    )
    centred = F.zip_with(F.col(column), means, lambda x, mean: x - mean)
    return vectors.withColumn(column, F.zip_with(centred, factors, lambda x, f: x * f))


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Join two vector tables on id, rescale both over the ids they share, concatenate."""
    left = first.select("id", F.col("vector").alias("left"))
    right = second.select("id", F.col("vector").cast("array<double>").alias("right"))
    both = written(left.join(right, "id"), "combined")
    scaled = standardise(standardise(both, "left"), "right")
    return scaled.select("id", F.concat("left", "right").alias("vector"))


def profile(features: DataFrame, key: str = "page_id") -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max of each numeric column."""
    filled = numeric_features(features, key)
    names = numeric_columns(filled, key)
    doubles = filled.select(*[F.col(n).cast("double").alias(n) for n in names])
    long = doubles.unpivot([], names, "feature", "value")
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    counts = running_counts(long, "feature", "value")
    quarters = quantiles(counts, "feature", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quarters, "feature")
