"""Matching-blocks ratio 2 M / T of tag sequences, many pairs at once.

M adds up the longest common run of two sequences (the earliest in the first one, then in
the second) and what the parts before and after it match in the same way. It depends
on the order of the two. Each ordered pair of different sequences is computed once, whatever
the number of pages that hold them, in Arrow batches: the open parts of all pairs of a batch are one
array, and each round finds the longest runs of all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import shuffle_width, written

PAIRS_AT_ONCE = 1_000


def _padded(codes: np.ndarray, offsets: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each sequence, filled up with `blank`, and the lengths."""
    sizes = np.diff(offsets)
    out = np.full((len(sizes), max(int(sizes.max(initial=0)), 1)), blank, np.int32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = codes[offsets[0] : offsets[-1]]
    return out, sizes


def _cut(rows: np.ndarray, pair: np.ndarray, low: np.ndarray, high: np.ndarray, blank: int) -> np.ndarray:
    """Places low to high of the rows of each part, filled up with `blank`."""
    at = low[:, None] + np.arange(int((high - low).max()))[None, :]
    return np.where(at < high[:, None], rows[pair[:, None], np.minimum(at, rows.shape[1] - 1)], blank)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the longest common run of each row."""
    best, start_a, start_b = (np.zeros(len(a), np.int64) for _ in range(3))
    runs = np.zeros((len(b), b.shape[1] + 1), np.int16)  # runs ending before place 0, 1, ...
    for i in range(a.shape[1]):
        longer = (runs[:, :-1] + 1) * (a[:, i, None] == b)
        runs[:, 1:] = longer
        most = longer.max(axis=1)
        better = np.flatnonzero(most > best)
        if len(better):
            best[better] = most[better]
            start_a[better] = i + 1 - most[better]
            start_b[better] = longer[better].argmax(axis=1) + 1 - most[better]
    return start_a, start_b, best


def matched(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Matching tags of each row of a with the same row of b."""
    total = np.zeros(len(a), np.int64)
    zero = np.zeros(len(a), np.int64)
    parts = np.stack([np.arange(len(a)), zero, a_sizes, zero, b_sizes])
    while True:
        parts = parts[:, (parts[2] > parts[1]) & (parts[4] > parts[3])]
        if not parts.shape[1]:
            return total
        pair, a_low, a_high, b_low, b_high = parts
        found = _longest(_cut(a, pair, a_low, a_high, -1), _cut(b, pair, b_low, b_high, -2))
        at_a, at_b, size = a_low + found[0], b_low + found[1], found[2]
        np.add.at(total, pair, size)
        before = np.stack([pair, a_low, at_a, b_low, at_b])
        after = np.stack([pair, at_a + size, a_high, at_b + size, b_high])
        parts = np.concatenate([before[:, size > 0], after[:, size > 0]], axis=1)


def ratios(left: pa.ListArray, right: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of the rows of two list columns, in both orders; two empty rows have 1."""
    both = pa.concat_arrays([left.flatten(), right.flatten()])
    codes = pc.dictionary_encode(both).indices.to_numpy(zero_copy_only=False)
    cut = len(left.flatten())
    sides = []
    for column, own, blank in ((left, codes[:cut], -1), (right, codes[cut:], -2)):
        offsets = column.offsets.to_numpy()
        sides.append(_padded(own, offsets - offsets[0], blank))
    (a, a_sizes), (b, b_sizes) = sides
    sum_of_sizes = a_sizes + b_sizes
    out = []
    for m in (matched(a, a_sizes, b, b_sizes), matched(b, b_sizes, a, a_sizes)):
        out.append(np.divide(2.0 * m, sum_of_sizes, out=np.ones(len(m)), where=sum_of_sizes > 0))
    return out[0], out[1]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
            batch = whole.slice(at, PAIRS_AT_ONCE)
            xy, yx = ratios(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(xy), pa.array(yx)], ["x", "y", "xy", "yx"]
            )


def with_ratios(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with `seq_ab` and `seq_ba`, for sequences(id, seq) of the ids. Pairs with
    an id that has no sequence are left out. Equal sequences are known by their md5."""
    keyed = sequences.select("id", F.md5(F.array_join("seq", " ")).alias("key"), "seq")
    distinct = written(keyed.groupBy("key").agg(F.first("seq").alias("seq")), "sequences")
    held = written(keyed.select("id", "key"), "sequence-keys")
    named = written(
        pairs.join(held.select(F.col("id").alias("a"), F.col("key").alias("__x")), "a").join(
            held.select(F.col("id").alias("b"), F.col("key").alias("__y")), "b"
        ),
        "named-pairs",
    )
    low, high = F.least("__x", "__y"), F.greatest("__x", "__y")
    asked = named.where("__x <> __y").select(low.alias("x"), high.alias("y")).distinct()
    first = distinct.select(F.col("key").alias("x"), F.col("seq").alias("one"))
    second = distinct.select(F.col("key").alias("y"), F.col("seq").alias("two"))
    rows = asked.join(first, "x").join(second, "y").select("x", "y", "one", "two")
    # The costly step: its pairs are spread evenly.
    found = rows.repartition(shuffle_width(rows), "x", "y").mapInArrow(
        _batches, "x string, y string, xy double, yx double"
    )
    met = named.join(found, (low == F.col("x")) & (high == F.col("y")), "left")
    same, ordered = F.col("__x") == F.col("__y"), F.col("__x") == F.col("x")
    return met.select(
        *pairs.columns,
        F.when(same, 1.0).when(ordered, F.col("xy")).otherwise(F.col("yx")).alias("seq_ab"),
        F.when(same, 1.0).when(ordered, F.col("yx")).otherwise(F.col("xy")).alias("seq_ba"),
    )
