"""Lenses put together by what the data say: fitted weights, and directions two lenses share.

Tasks gather moments; the driver solves systems of as many unknowns as there are lenses or
dimensions, however many pairs or pages there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.scaling import combine
from pagelens.session import written

# Variances below this share of the greatest one are those of dimensions that say nothing new.
FLAT = 1e-9


def fit_weights(compared: DataFrame, lenses: list[str], target: str) -> dict[str, float]:
    """The weights, and the `intercept`, of the least squares fit of `target` by the lenses.

    `compared` has one row per pair, as `blend.compare_lenses` gives it. Rows that lack a lens
    or the target are left out. Of lenses that move together or stay constant the smallest
    weights that fit are taken; without rows all are 0."""
    names = [*lenses, target]
    numbers = compared.select(*[F.col(n).cast("double").alias(n) for n in names]).dropna()
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = numbers.agg(
        *[F.avg(n).alias(f"mean_{i}") for i, n in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"moment_{i}_{j}") for i, j in upper],
    ).first()
    if row["mean_0"] is None:
        return dict.fromkeys([*lenses, "intercept"], 0.0)
    moments = np.zeros((len(names), len(names)))
    for i, j in upper:
        moments[i, j] = moments[j, i] = row[f"moment_{i}_{j}"]
    return weights_of(np.array([row[f"mean_{i}"] for i in range(len(names))]), moments, lenses)


def weights_of(means: np.ndarray, moments: np.ndarray, lenses: list[str]) -> dict[str, float]:
    """The weights from the means and centred moments of the lenses, in order, and the target."""
    k = len(lenses)
    weights = np.linalg.pinv(moments[:k, :k], rcond=FLAT, hermitian=True) @ moments[:k, k]
    found = dict(zip(lenses, weights.tolist(), strict=True))
    return found | {"intercept": float(means[k] - weights @ means[:k])}


def fused(compared: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(a, b, similarity): the fitted value of each pair; null where a lens lacks it."""
    score: Column = F.lit(weights["intercept"])
    for name, weight in weights.items():
        if name != "intercept":
            score = score + F.col(name) * F.lit(weight)
    return compared.select("a", "b", score.alias("similarity"))


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        rows = pa.array(range(len(total)), pa.int32())
        yield pa.RecordBatch.from_arrays([rows, pa.array(list(total))], ["row", "sums"])


def gram(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of all vectors of `size` numbers; a task passes on one matrix."""
    parts = vectors.select("vector").mapInArrow(_gram_batches, "row int, sums array<double>")
    sums = parts.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    return np.array([r.sums for r in sums.orderBy("row").collect()]).reshape(-1, size)


def _whitening(moments: np.ndarray) -> np.ndarray:
    """Columns that turn the moments into the identity, flat directions left out."""
    values, axes = np.linalg.eigh(moments)
    keep = values > FLAT * max(values.max(), FLAT)
    return axes[:, keep] / np.sqrt(values[keep])


def canonical(first: DataFrame, second: DataFrame, components: int = 2) -> tuple[list[float], DataFrame]:
    """Correlations of the directions two lenses share, greatest first, and (id, first, second):
    the place of each page of both lenses along them.

    Both are (id, vector) without missing numbers. Dimensions are standard-scaled over the ids
    both have. Signs are set so that the largest loading on the first lens is positive. Fewer
    directions come back if a lens has fewer; none, and no row, if no id is shared."""
    both = written(combine(first, second), "both-lenses")
    head = first.select(F.size("vector").alias("n")).first()
    row = both.select(F.size("vector").alias("n")).first()
    if row is None:
        empty = "id", F.array().cast("array<double>").alias("first"), F.array().cast("array<double>").alias("second")
        return [], both.select(*empty)
    size, split = row.n, head.n
    moments = gram(both, size) / both.count()
    left, right = _whitening(moments[:split, :split]), _whitening(moments[split:, split:])
    u, correlations, v = np.linalg.svd(left.T @ moments[:split, split:] @ right, full_matrices=False)
    a, b = (left @ u)[:, :components], (right @ v.T)[:, :components]
    signs = np.sign(a[np.abs(a).argmax(axis=0), np.arange(a.shape[1])])

    def along(loadings: np.ndarray, start: int) -> Column:
        part = F.slice("vector", start + 1, len(loadings))
        return F.array(*[
            F.aggregate(F.zip_with(part, F.lit(c.tolist()), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
            for c in loadings.T
        ])

    places = both.select("id", along(a * signs, 0).alias("first"), along(b * signs, split).alias("second"))
    return correlations[:components].tolist(), places
