"""Repeated passages, by MinHash banding of paragraphs.

Passages recur in the middle of lines and between other words, so a paragraph is cut where
its own words say so: before each word whose hash (with the next word's) is the least among
SPAN words on either side. A passage of some 50 words then has the same inner paragraphs
wherever it stands, several of them, so that a changed word spoils one or two. Line ends
play no part.

Paragraphs are sets of 5-word shingles. Equal ones are folded; MinHash bands of ROWS values
(BANDS of them: two paragraphs of Jaccard similarity 0.8 meet with probability
1 - (1 - 0.8**ROWS)**BANDS = 0.983) name the buckets in which different ones meet. Pairs are
verified by exact Jaccard similarity; of those that hold a bucket passes on a
star for each component, so that many variants make as many links, not their square.
Components of the links are classes, and a class found in two documents or more is repeated.
Repeated paragraphs in a run count from MIN_RUN words on; all but the first occurrence of a
class are marked for removal. A run goes on over paragraphs that are not repeated, such as
one with a changed word, where the classes on both sides stand within REACH paragraphs, in
this order, in another document too. What is bridged adds no words and is not marked.

A bucket with more than SMALL different paragraphs is not compared in one task: its pairs
are found through prefix filtering, which is exact. Two sets of similarity 0.8 must share one of the
first n - ceil(0.8 n) + 1 shingles of each in an order common to both, and the order here is
from rare to frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import small_batches
from pagelens.llm.components import components
from pagelens.session import small_side, written

SPAN = 4
SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 2, 4
ALONE = 4  # smaller sets are similar to equal ones only: 3 of 4 is below SIMILARITY
MIN_RUN = 12
REACH = 4
SMALL = 1_024
SIDE_ROWS = 1_000_000  # of 16 bytes: most a broadcast may have
SEEN = 100_000  # paragraphs a task remembers in order not to band copies again

PARAGRAPHS = (
    "doc_id long, doc long, paragraph int, start int, stop int, n_words int, h long, "
    "shingles array<int>"
)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd mixing constants


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def cuts(hashes: np.ndarray) -> np.ndarray:
    """Places of the words before which a text is cut, 0 first."""
    n = len(hashes)
    pairs = _mix(hashes * _P + np.append(hashes[1:], np.uint64(0)))
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.concatenate([np.full(SPAN, most), pairs, np.full(SPAN, most)])
    left, right = np.full(n, most), np.full(n, most)
    for j in range(1, SPAN + 1):
        np.minimum(left, padded[SPAN - j : SPAN - j + n], out=left)
        np.minimum(right, padded[SPAN + j : SPAN + j + n], out=right)
    found = np.flatnonzero((pairs < left) & (pairs <= right))
    return np.concatenate([[0], found[found > 0]])


def _distinct(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each stretch of words a to b, in order, one after the other,
    and how many each stretch has."""
    counts = b - a - (SHINGLE - 1)
    owner = np.repeat(np.arange(len(a)), counts)
    places = np.arange(len(owner)) + np.repeat(a - (np.cumsum(counts) - counts), counts)
    wide = (owner.astype(np.int64) << 32) + shingles[places].astype(np.int64)
    wide.sort()
    wide = wide[np.append(True, wide[1:] != wide[:-1])]
    own = wide.astype(np.int32)  # the low half, whatever its sign
    return own, np.bincount((wide - own) >> 32, minlength=len(a))


def paragraphs(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray, np.ndarray]:
    """(starts, stops, words, hashes, shingles, sizes) of the paragraphs of at least SHINGLE
    words; places in code points, the distinct shingles of all in one array, `sizes` of them
    each. All empty for texts without so many words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass").lower()
    tokens = data.split()
    none = np.zeros(0, np.int64)
    if len(tokens) < SHINGLE:
        return none, none, none, [], none.astype(np.int32), none
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    shingles = hashes[: 1 - SHINGLE].copy()
    for j in range(1, SHINGLE):
        shingles = shingles * _P + hashes[j : len(hashes) - SHINGLE + 1 + j]
    shingles = (_mix(shingles) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]  # of the words, in bytes
    a = cuts(hashes)
    b = np.append(a[1:], len(tokens))
    long = b - a >= SHINGLE
    a, b = a[long], b[long]
    if not len(a):
        return none, none, none, [], none.astype(np.int32), none
    h = [digest(b" ".join(tokens[i:j])) - (1 << 63) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    starts, stops = begins[a], ends[b - 1]
    if len(data) != len(text):
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        starts, stops = points[starts], points[stops]
    return starts, stops, b - a, h, *_distinct(shingles, a, b)


def document_key(doc_id: int | None, text: str) -> int:
    """What tells documents apart, those without a doc_id or of a shared one too."""
    named = f"{'' if doc_id is None else doc_id}\0{text}".encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(named) - (1 << 63)


def _paragraph_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARAGRAPHS.split(", ")]
    for batch in batches:
        keys, docs, counts, hashes = [], [], [], []
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in range(6)]
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            starts, stops, words, h, own, sizes = paragraphs(text)
            if not h:
                continue
            keys.append(key)
            docs.append(document_key(key, text))
            counts.append(len(h))
            hashes += h
            for part, values in zip(parts, (np.arange(len(h)), starts, stops, words, own, sizes), strict=True):
                part.append(values.astype(np.int32))
        number, starts, stops, words, own, sizes = [np.concatenate(part) for part in parts]
        owner = pa.array(np.repeat(np.arange(len(counts)), np.array(counts, np.int64)))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        arrays = [
            pa.array(keys, pa.int64()).take(owner), pa.array(docs, pa.int64()).take(owner),
            pa.array(number), pa.array(starts), pa.array(stops), pa.array(words),
            pa.array(hashes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(own)),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names)


def cut(docs: DataFrame) -> DataFrame:
    """The paragraphs of all rows of (doc_id, text), whole texts."""
    small_batches(docs.sparkSession, 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _paragraph_batches, PARAGRAPHS
    )


# -- banding -----------------------------------------------------------------------


def band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys by paragraph and band, of the paragraphs whose shingles start at `starts`."""
    wide = values.view(np.uint32).astype(np.uint64)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            odd = 2 * (band * ROWS + row) + 1
            factor = np.uint64(int(_Q) * odd & 0xFFFFFFFFFFFFFFFF)
            key = key * _P + np.minimum.reduceat(_mix(wide * factor + np.uint64(odd)), starts)
        keys[:, band] = _mix(key)
    return keys.view(np.int64)


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        hashes, lists = batch.column("h").to_pylist(), batch.column("shingles")
        fresh = []
        for i, h in enumerate(hashes):
            if h not in seen:
                seen.add(h)
                fresh.append(i)
        if len(seen) > SEEN:
            seen.clear()
        if not fresh:
            continue
        lists = lists.take(pa.array(fresh))
        own = np.array([hashes[i] for i in fresh], np.int64)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        keys = band_keys(lists.flatten().to_numpy(zero_copy_only=False), starts)
        used = (sizes[:, None] >= ALONE) | (np.arange(BANDS) == 0)  # equal sets meet in any band
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[used]), pa.array(np.repeat(own, used.sum(1)))], ["key", "h"]
        )


def colliding(cut_rows: DataFrame) -> DataFrame:
    """(key, h, n): the buckets with more than one paragraph, each paragraph once; n is
    their number."""
    keys = cut_rows.select("h", "shingles").mapInArrow(_band_batches, "key long, h long")
    bucket = Window.partitionBy("key")
    spread = keys.withColumns({"low": F.min("h").over(bucket), "high": F.max("h").over(bucket)})
    met = spread.filter("low <> high").select("key", "h").distinct()
    return met.withColumn("n", F.count(F.lit(1)).over(bucket))


def jaccard(a, b):
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _prefix_pairs(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of large buckets that can be similar, by prefix filtering."""
    members = large.join(sets, "h").select("h", "shingles").distinct()
    each = members.select("h", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    frequent = each.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("h").orderBy("f", "s")
    ranked = each.join(frequent, "s").withColumn("at", F.row_number().over(order))
    first = ranked.filter(
        F.col("at") <= F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9) + 1
    ).select("s", "h")
    a, b = first.alias("a"), first.alias("b")
    return a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.h") < F.col("b.h"))).select(
        F.col("a.h").alias("a"), F.col("b.h").alias("b")
    )


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets are similar, by exact Jaccard similarity; a matrix."""
    sizes = np.array([len(s) for s in sets])
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((len(sets), places.max() + 1), np.float32)
    held[np.repeat(np.arange(len(sets)), sizes), places] = 1
    both = held @ held.T
    return both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both) - 1e-6


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The components of the similar pairs of a few sets, each as a star around its first
    set, in pairs of their numbers: buckets that hold the same sets give the same pairs."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both >= SIMILARITY * (len(sets[0]) + len(sets[1]) - both) - 1e-6 else []
    similar, open_, edges = _similar(sets), np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        reached = [root]
        while reached:
            at = reached.pop()
            found = np.flatnonzero(similar[at] & open_)
            open_[found] = False
            edges += [(root, int(x)) for x in found]
            reached += found.tolist()
    return edges


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that stand together in (key, h, shingles); one bucket is held."""
    key, names, sets, out = None, [], [], []

    def passed() -> pa.RecordBatch:
        ends = [np.array([e[i] for e in out], np.int64) for i in (0, 1)]
        low, high = np.minimum(*ends), np.maximum(*ends)
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    for batch in batches:
        lists = batch.column("shingles")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        own = np.split(flat, ends[:-1]) if len(ends) else []
        rows = zip(batch.column("key").to_pylist(), batch.column("h").to_pylist(), own, strict=True)
        for bucket, h, shingles in rows:
            if bucket != key:
                out += [(names[i], names[j]) for i, j in (forest(sets) if len(sets) > 1 else [])]
                key, names, sets = bucket, [], []
            names.append(h)
            sets.append(shingles)
        if out:
            yield passed()
            out = []
    out = [(names[i], names[j]) for i, j in (forest(sets) if len(sets) > 1 else [])]
    if out:
        yield passed()


def links(cut_rows: DataFrame) -> DataFrame:
    """(a, b), a < b: hashes of different paragraphs that are similar or connected by verified
    pairs of a bucket; enough of them to connect all that are connected."""
    met = written(colliding(cut_rows), "met")
    small, large = met.filter(F.col("n") <= SMALL), met.filter(F.col("n") > SMALL)
    wanted = small_side(met.select("h").distinct(), "met-hashes", SIDE_ROWS)
    sets = written(
        cut_rows.select("h", "shingles").join(wanted, "h").groupBy("h").agg(F.first("shingles").alias("shingles")),
        "shingle-sets",
    )
    buckets = small.join(sets, "h").select("key", "h", "shingles")
    found = (
        buckets.repartition("key")
        .sortWithinPartitions("key", "h")
        .mapInArrow(_forest_batches, "a long, b long")
    )
    if not large.isEmpty():
        of_a = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x"))
        of_b = sets.select(F.col("h").alias("b"), F.col("shingles").alias("y"))
        pairs = _prefix_pairs(large.select("h").distinct(), sets).distinct()
        compared = pairs.join(of_a, "a").join(of_b, "b")
        alike = jaccard(F.col("x"), F.col("y")) >= SIMILARITY
        found = found.union(compared.filter(alike).select("a", "b"))
    return found.distinct()


def in_runs(members: DataFrame, key: str = "doc_id") -> DataFrame:
    """`members` with `run`, which numbers the runs of a document; `key` tells documents apart.

    The class before a gap and the one after it bridge it if they stand so in two documents;
    the pairs asked for are those of gaps, and each is one row, however many documents hold
    it."""
    inside = Window.partitionBy(key).orderBy("paragraph")
    earlier = [F.max("class_id").over(inside.rangeBetween(-o, -o)) for o in range(1, REACH + 1)]
    placed = written(members.withColumn("earlier", F.array(*earlier)), "placed")
    gap = F.when(F.col("earlier")[0].isNull(), F.coalesce(*[F.col("earlier")[o] for o in range(1, REACH)]))
    asked = placed.select(gap.alias("a"), F.col("class_id").alias("b")).filter("a is not null").distinct()
    asked = small_side(asked, "gaps", SIDE_ROWS)
    pairs = placed.select(key, F.explode("earlier").alias("a"), F.col("class_id").alias("b"))
    bridges = (
        pairs.filter("a is not null")
        .join(asked, ["a", "b"], "left_semi")
        .groupBy("a", "b")
        .agg(F.min(key).alias("low"), F.max(key).alias("high"))
        .filter("low <> high")
        .select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    )
    bridges = small_side(bridges, "bridges", SIDE_ROWS)
    over = (gap == F.col("__a")) & (F.col("class_id") == F.col("__b"))
    starts = F.col("earlier")[0].isNull() & F.col("__a").isNull()
    met = placed.join(bridges, over, "left").withColumn("starts", starts.cast("int"))
    return met.withColumn("run", F.sum("starts").over(inside)).drop("earlier", "starts", "__a", "__b")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start, stop, n_words, class_id, class_doc, removed): every
    paragraph of a class that two documents or more share, in runs of MIN_RUN words.

    class_doc is the smallest doc_id of the class; the first paragraph of the first document
    stays, the others are marked removed. Documents stand by doc_id, those without one last.
    A document is a doc_id with its text: repeated rows are one document, listed once; rows of
    one doc_id with different texts, or of no doc_id, are documents of their own, and class_doc
    is null where no document of a class has an id. Null and empty texts and texts of fewer
    than five words have no paragraphs; of very long ones all paragraphs are compared. An empty
    table gives an empty result. Columns other than the two are not read, whatever their
    names."""
    rows = written(cut(docs), "paragraphs")
    nodes = written(components(written(links(rows), "links")), "classes")
    shared = rows.groupBy("h").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("doc_id").alias("least")
    )
    classed = written(
        shared.join(nodes.withColumnRenamed("node", "h"), "h", "left")
        .filter("root is not null or low <> high")
        .select("h", F.coalesce("root", "h").alias("class_id"), "low", "high", "least"),
        "classed",
    )
    wide = (
        classed.groupBy("class_id")
        .agg(F.min("least").alias("class_doc"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("low <> high")
        .drop("low", "high")
    )
    chosen = written(classed.select("h", "class_id").join(wide, "class_id"), "chosen")
    # One shuffle by document serves the rows kept once and the runs.
    once = F.row_number().over(Window.partitionBy("doc", "paragraph").orderBy("h"))
    members = rows.drop("shingles").join(chosen, "h").repartition("doc")
    members = members.withColumn("once", once).filter("once = 1").drop("once")
    run = Window.partitionBy("doc", "run")
    found = written(
        in_runs(members, "doc").withColumn("run_words", F.sum("n_words").over(run))
        .filter(F.col("run_words") >= MIN_RUN)
        .drop("run", "run_words"),
        "members",
    )
    here = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc", "paragraph")
    first = found.groupBy("class_id").agg(
        F.min(here).alias("first"), F.min("doc").alias("low"), F.max("doc").alias("high")
    )
    stays = (F.col("doc") == F.col("first.doc")) & (F.col("paragraph") == F.col("first.paragraph"))
    return (
        found.join(first.filter("low <> high"), "class_id")
        .select(
            "doc_id", "paragraph", "start", "stop", "n_words", "class_id", "class_doc",
            (~stays).alias("removed"),
        )
    )
