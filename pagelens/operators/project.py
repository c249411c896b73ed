"""Two-dimensional views: principal components and metric scaling of a pair table."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import written


REPORT_EVERY = 5


def pca_2d(vectors: DataFrame) -> DataFrame:
    """(id, x, y): first two principal components of centred vectors; needs over 2 rows.

    The covariance is gathered by the tasks; the driver sees a d x d matrix. Signs are set
    so that the largest loading of each component is positive.
    """
    ml = vectors.select("id", array_to_vector("vector").alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred")
    ready = centred.fit(ml).transform(ml).select("id", "centred")
    model = PCA(k=2, inputCol="centred", outputCol="pc").fit(ready)
    loadings = model.pc.toArray()
    signs = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in loadings.T]
    placed = model.transform(ready).select("id", vector_to_array("pc").alias("pc"))
    return placed.select(
        "id",
        (F.col("pc")[0] * signs[0]).alias("x"),
        (F.col("pc")[1] * signs[1]).alias("y"),
    )


def start_layout(edges: DataFrame) -> DataFrame:
    """(id, x, y): a start that depends on the id alone, within the unit square."""
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id")))

    def spread(axis: str):
        digits = F.substring(F.md5(F.concat(F.lit(axis), F.col("id").cast("string"))), 1, 6)
        return F.conv(digits, 16, 10).cast("double") / 16.0**6

    return ids.distinct().select("id", spread("x").alias("x"), spread("y").alias("y"))


def metric_layout(pairs: DataFrame, iterations: int = 10) -> tuple[DataFrame, list[float]]:
    """Metric multidimensional scaling of distances 1 - similarity over the pairs given.

    Weighted stress with weight 1 on listed pairs and 0 elsewhere, so any pair table will
    do: all pairs of a small site, or the neighbour graph of a large one. Each step moves
    every point by half its mean pull, which majorises the stress: it never rises.
    Returns the layout (id, x, y) and the stress at the start, every fifth step and the end.
    Distances below 0 (scores above 1) count as 0.
    """
    edges = pairs.where("a <> b").select(
        "a", "b", F.greatest(F.lit(1.0) - F.col("similarity"), F.lit(0.0)).alias("wanted")
    )
    edges = written(edges, "edges")
    layout = written(start_layout(edges), "layout")
    stresses = [stress(edges, layout)]
    for step in range(1, iterations + 1):
        # Every pull carries its point's place, which is the same on all of them.
        twice = 2 * F.count("*")
        moved = _pulls(edges, layout).groupBy("id").agg(
            (F.max("x") + F.sum("dx") / twice).alias("x"),
            (F.max("y") + F.sum("dy") / twice).alias("y"),
        )
        layout = written(moved, "layout")
        if step % REPORT_EVERY == 0 or step == iterations:
            stresses.append(stress(edges, layout))
    return layout, stresses


def _placed(edges: DataFrame, layout: DataFrame) -> DataFrame:
    at_a = layout.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    at_b = layout.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    placed = edges.join(at_a, "a").join(at_b, "b")
    return placed.withColumn("apart", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))


def _pulls(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """The step each edge asks of each of its ends."""
    placed = _placed(edges, layout)
    ratio = F.when(F.col("apart") > 0, F.col("wanted") / F.col("apart")).otherwise(0.0)
    sized = placed.withColumn("keep", ratio - 1)
    dx = (F.col("xa") - F.col("xb")) * F.col("keep")
    dy = (F.col("ya") - F.col("yb")) * F.col("keep")
    ends = F.array(
        F.struct(
            F.col("a").alias("id"), F.col("xa").alias("x"), F.col("ya").alias("y"),
            dx.alias("dx"), dy.alias("dy"),
        ),
        F.struct(
            F.col("b").alias("id"), F.col("xb").alias("x"), F.col("yb").alias("y"),
            (-dx).alias("dx"), (-dy).alias("dy"),
        ),
    )
    return sized.select(F.inline(ends))


def stress(edges: DataFrame, layout: DataFrame) -> float:
    gap = F.col("apart") - F.col("wanted")
    total = _placed(edges, layout).agg(F.sum(gap * gap).alias("s")).first()
    return float(total.s or 0.0)
