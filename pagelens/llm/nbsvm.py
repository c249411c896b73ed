"""Naive Bayes support vectors over n-grams.

The indicators of a text's byte n-grams (hashed to places) are scaled by the log-count
ratios of the two classes, and a linear hinge-loss model is fitted on them by dual
coordinate descent. A logistic curve through margins of rows the model has not seen turns a
margin into a score between 0 and 1.

The model is fitted in one task on a bounded sample of labelled rows (SAMPLE rows at most,
those of the least hashes); scoring runs over all rows, in the tasks that read them. Only
the sample and the model (PLACES numbers) are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import is_training_row, small_batches

SAMPLE = 12_000
PLACE_BITS = 16
PLACES = 1 << PLACE_BITS
ORDERS = (1, 2, 3, 4)
SMOOTHING = 1.0
PENALTY = 1.0  # C of the hinge loss
EPOCHS = 12
MIX = 0.8  # share of the fitted weights against their mean magnitude
REPEATS = np.uint32(1 << 31)  # sets the n-grams of repetition signs apart
SPREAD = np.uint32(2654435761)  # odd multiplier of the hash


def places(text: str | None) -> np.ndarray:
    """Sorted places of the n-grams of a text, those of its bytes and those of the signs
    whether a word equals the one before it; empty for null and empty texts."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(PLACES, bool)
    for at in range(0, len(data), 1 << 20):  # bounded memory for very long texts
        part = data[at : at + (1 << 20) + ORDERS[-1] - 1].astype(np.uint32)
        for n in ORDERS:
            size = len(part) - n + 1
            if size <= 0:
                break
            gram = np.full(size, n, np.uint32)
            for j in range(n):
                gram = gram * np.uint32(257) + part[j : j + size]
            seen[(gram * SPREAD) >> np.uint32(32 - PLACE_BITS)] = True
    tokens = (text or "").split()
    same = np.fromiter(map(eq, tokens, tokens[1:]), np.uint32, max(0, len(tokens) - 1))
    if len(same) >= 3:
        gram = REPEATS + (same[:-2] * 4 + same[1:-1] * 2 + same[2:])
        seen[np.unique(gram * SPREAD) >> np.uint32(32 - PLACE_BITS)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each place: how much more often rows of class 1 have it."""
    counts = np.full((2, PLACES), SMOOTHING)
    for row, label in zip(rows, y, strict=True):
        counts[int(label)][row] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by place, bias: hinge loss with an L2 penalty, by dual coordinate descent
    over the rows in random orders. Classes weigh the same in sum."""
    sign = np.where(y > 0, 1.0, -1.0)
    bound = PENALTY * np.where(y > 0, 0.5 / max(1e-9, (y > 0).mean()), 0.5 / max(1e-9, (y <= 0).mean()))
    values = [r[row] for row in rows]
    norms = [math.sqrt(float(v @ v) + 1e-12) for v in values]
    values = [v / n for v, n in zip(values, norms, strict=True)]
    w, bias = np.zeros(PLACES), 0.0
    alpha, draw = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            row, v = rows[i], values[i]
            slope = sign[i] * (float(w[row] @ v) + bias) - 1
            diagonal = 2.0 if len(v) else 1.0
            new = min(bound[i], max(0.0, alpha[i] - slope / diagonal))
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[row] += step * v
                bias += step
                alpha[i] = new
    w = (1 - MIX) * np.abs(w).mean() + MIX * w
    return w, bias


def margin(row: np.ndarray, r: np.ndarray, w: np.ndarray, bias: float) -> float:
    v = r[row]
    return float(w[row] @ v) / math.sqrt(float(v @ v) + 1e-12) + bias


def curve(margins: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with a small penalty."""
    a, b = 1.0, 0.0
    hits, misses = float((y > 0).sum()), float((y <= 0).sum())
    goal = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (misses + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        error, weight = p - goal, p * (1 - p) + 1e-6
        slope = np.array([error @ margins + 1e-3 * a, error.sum()])
        bend = np.array([
            [weight @ (margins * margins) + 1e-3, weight @ margins],
            [weight @ margins, weight.sum() + 1e-9],
        ])
        step = np.linalg.solve(bend, slope)
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-9:
            break
    return a, b


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(ratios, weights, bias, slope, offset). A quarter of the rows is kept from a first
    model to place the curve; the model itself is then fitted on all."""
    if len(rows) == 0 or y.min() == y.max():  # nothing to tell apart
        sure = float(np.clip(y.mean() if len(rows) else 0.5, 0.01, 0.99))
        return np.zeros(PLACES), np.zeros(PLACES), 0.0, 0.0, math.log(sure / (1 - sure))
    own = np.arange(len(rows)) % 4 != 3
    if len(np.unique(y[own])) < 2 or len(np.unique(y[~own])) < 2:
        own = np.ones(len(rows), bool)
    kept = [row for row, o in zip(rows, own, strict=True) if o]
    other = [row for row, o in zip(rows, own, strict=True) if not o] or rows
    y_other = y[~own] if not own.all() else y
    r = ratios(kept, y[own])
    w, bias = descend(kept, y[own], r)
    a, b = curve(np.array([margin(x, r, w, bias) for x in other]), y_other)
    r = ratios(rows, y)
    w, bias = descend(rows, y, r)
    return r, w, bias, a, b


def score(row: np.ndarray, model: tuple) -> float:
    r, w, bias, a, b = model
    z = a * margin(row, r, w, bias) + b
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


# -- on Spark ----------------------------------------------------------------------


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [places(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
            ["doc_id", "label", "places"],
        )


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(*[batch.column(c).to_pylist() for c in ("doc_id", "label", "places")], strict=True)
    rows.sort()
    y = np.array([label for _, label, _ in rows], np.int64)
    r, w, bias, a, b = fit([np.frombuffer(p, np.uint32) for _, _, p in rows], y)
    numbers = np.concatenate([r, w, [bias, a, b]]).astype("<f8").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([numbers], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> tuple:
    """Model from at most `most` labelled rows that may be learnt from. Rows without a
    label are left out; of repeated labels of a doc_id the greatest counts."""
    small_batches(docs.sparkSession)
    sample = (
        labels.filter(is_training_row() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = joined.select("doc_id", "label", "text").mapInArrow(
        _place_batches, "doc_id long, label int, places binary"
    )
    # One task: the sample is bounded.
    (found,) = rows.repartition(1).mapInArrow(_fit_batches, "model binary").collect()
    numbers = np.frombuffer(bytes(found["model"]), "<f8")
    r, w = numbers[:PLACES], numbers[PLACES : 2 * PLACES]
    return r, w, *map(float, numbers[2 * PLACES :])


def scored(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the score of no n-grams."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [score(places(t.as_py()), shared.value) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        batches, "doc_id long, score double"
    )
