"""SimHash near-duplicates, found through Golay-code keys.

A 64-bit fingerprint is cut into three segments, each read as a word of the perfect binary
Golay code of length 23, whose 4,096 codewords have every word within distance 3 of exactly
one of them. near(x) are the codewords that x, or x with one bit flipped, decodes to: up to
six. If two segments differ in at most one bit, the codeword of the one is in near() of the
other.

Pigeonhole: of 3 differing bits in segments A, B, C either A and B have at most one each, or
one of them has two or more and the other two segments together at most one. So the keys are
pairs of codeword indices: near(A) x near(B), and for AC and BC only pairs in which one of
the two is the segment's own codeword. Each fingerprint is looked up under these keys among
the own codeword pairs of all fingerprints, and every meeting is verified by counting bits.
No link is lost; only links that hold leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import small_batches
from pagelens.llm.components import components
from pagelens.session import written

SHINGLE = 3
SEED = 42
MOST_BITS = 3
WIDTHS = (22, 21, 21)  # of segments A, B, C, lowest bits first
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a fixed value of the code
LENGTH, CHECK = 23, 11


# -- fingerprints ------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """SimHash of a text's 3-word shingles as a signed 64-bit number; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lower: A-Z only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= SHINGLE:
        hashes = [digest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - SHINGLE].tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(packed[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column("text")]
        names = [n for n in batch.schema.names if n != "text"]
        arrays = [*[batch.column(n) for n in names], pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [*names, "fp"])


def mark() -> Column:
    """What tells rows of one doc_id apart: rows of equal text have equal marks."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, marked: bool = False) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text); with `marked` (doc_id, mark, fp)."""
    small_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([mark().alias("mark")] if marked else [])]
    schema = "doc_id long, mark long, fp long" if marked else "doc_id long, fp long"
    return docs.select(*columns).mapInArrow(_fingerprint_batches, schema)


# -- the code ----------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high halves of a word, and the error of each syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(LENGTH - 1, CHECK - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - CHECK)
        return word

    single = [syndrome(1 << i) for i in range(LENGTH)]

    def table(first: int, width: int) -> np.ndarray:
        out = np.zeros(1 << width, np.int32)
        for i in range(width):
            out[1 << i : 2 << i] = out[: 1 << i] ^ single[first + i]
        return out

    errors = np.zeros(1 << CHECK, np.int32)
    for i in range(LENGTH):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return table(0, 12), table(12, LENGTH - 12), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECK


def near_indices(words: np.ndarray, width: int) -> list[np.ndarray]:
    """For each word the indices that it and its neighbours by one bit decode to, without
    repeats, its own first."""
    flips = np.array([0, *[1 << i for i in range(width)]], np.int32)
    all_of = codeword_index(words[:, None] ^ flips[None, :])
    return [np.array(list(dict.fromkeys(row.tolist())), np.int64) for row in all_of]


def segments(prints: np.ndarray) -> list[np.ndarray]:
    values, out = prints.view(np.uint64), []
    for width in WIDTHS:
        out.append((values & np.uint64((1 << width) - 1)).astype(np.int32))
        values = values >> np.uint64(width)
    return out


def _pair_key(which: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (which << 24) + (first << 12) + second


def own_keys(prints: np.ndarray) -> np.ndarray:
    """The three keys a fingerprint is found under, one row per fingerprint."""
    a, b, c = [codeword_index(s).astype(np.int64) for s in segments(prints)]
    return np.stack([_pair_key(0, a, b), _pair_key(1, a, c), _pair_key(2, b, c)], axis=1)


def search_keys(prints: np.ndarray) -> list[np.ndarray]:
    """The keys each fingerprint is looked up under."""
    near = [near_indices(s, w) for s, w in zip(segments(prints), WIDTHS, strict=True)]

    def light(which: int, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [_pair_key(which, x, y[:1]), _pair_key(which, x[:1], y[1:])]

    return [
        np.concatenate([
            _pair_key(0, a[:, None], b[None, :]).ravel(), *light(1, a, c), *light(2, b, c)
        ])
        for a, b, c in zip(*near, strict=True)
    ]


def _own_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = own_keys(prints).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(prints, 3))], ["key", "b"])


def _search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = search_keys(prints)
        if keys:
            fps = np.repeat(prints, [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fps)], ["key", "a"])


# -- links and groups --------------------------------------------------------------


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: fingerprints of `distinct` that differ in at most MOST_BITS bits."""
    own = distinct.select("fp").mapInArrow(_own_batches, "key long, b long")
    looked = distinct.select("fp").mapInArrow(_search_batches, "key long, a long")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    met = looked.join(own, (looked["key"] == own["key"]) & (F.col("a") < F.col("b")) & close)
    return met.select("a", "b").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, n_links) for every row of (doc_id, text).

    component_id is the smallest doc_id that can be reached over links, the row's own
    included; n_links counts the other fingerprints it links to. Equal fingerprints are
    folded before the search, so copies are compared once. Null and blank texts have
    fingerprint zero and link like any other. A null doc_id never names a component
    unless the component has no other. Repeated rows each give a row.
    """
    return labelled(written(fingerprints(docs), "fingerprints")).drop("root")


def labelled(prints: DataFrame) -> DataFrame:
    """Written `prints`, rows with fp, with component_id, n_links and root, a fingerprint that
    names the group whatever its doc_ids."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    pairs = written(links(distinct), "links")
    degree = (
        pairs.select(F.col("a").alias("fp"))
        .union(pairs.select("b"))
        .groupBy("fp")
        .agg(F.count(F.lit(1)).alias("n_links"))
    )
    nodes = written(components(pairs), "components")
    smallest = (
        nodes.join(distinct, nodes["node"] == distinct["fp"])
        .groupBy("root")
        .agg(F.min("least").alias("component"))
    )
    named = nodes.join(smallest, "root").select(F.col("node").alias("fp"), "component", "root")
    labels = written(
        distinct.join(named, "fp", "left")  # by fp: rows without a link spread over the tasks
        .join(degree, "fp", "left")
        .select(
            "fp",
            F.coalesce("component", "least").alias("component_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("root", "fp").alias("root"),
        ),
        "labels",
    )
    others = [c for c in prints.columns if c != "fp"]
    return prints.join(labels, "fp").select(*others, "fp", "component_id", "n_links", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of `docs` without near-duplicates: of each group the row of its smallest doc_id,
    null last. Of rows of that doc_id in the group one stays; which, is settled by their
    text. Rows of one doc_id, null included, that are in different groups all stay."""
    prints = written(fingerprints(docs.select("doc_id", "text"), marked=True), "fingerprints")
    each = labelled(prints).groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "n")
    chosen = each.groupBy("root").agg(F.min(order).alias("c"))
    chosen = written(
        chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.mark").alias("__mark"), F.col("c.n").alias("__rows")),
        "chosen",
    )
    # What is kept grows with the table: it is never sent to all tasks.
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (mark() == F.col("__mark"))
    kept = docs.join(chosen.hint("merge"), same)
    once = kept.filter("__rows = 1")
    row = F.struct(*docs.columns)
    first = kept.filter("__rows > 1").groupBy("__id", "__mark").agg(
        F.min_by(row, F.xxhash64(F.to_json(row))).alias("r")
    )
    return once.select(*docs.columns).union(first.select(*[f"r.{c}" for c in docs.columns]))
