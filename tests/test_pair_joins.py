"""Matching-blocks kernel, set join and count join against plain versions."""

import difflib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.operators import matching, set_join, structure

SEQUENCE = st.lists(st.sampled_from("abcd"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(SEQUENCE, SEQUENCE), min_size=1, max_size=12))
def test_ratios_equal_the_standard_library(pairs):
    left, right = (pa.array([p[i] for p in pairs], pa.list_(pa.string())) for i in (0, 1))
    xy, yx = matching.ratios(left, right)
    for n, (a, b) in enumerate(pairs):
        assert xy[n] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
        assert yx[n] == pytest.approx(difflib.SequenceMatcher(None, b, a).ratio())


def test_ratios_of_full_length_and_of_slices():
    draw = random.Random(4)
    rows = [[draw.choice(["p", "li", "a", "b", "br", "div"]) for _ in range(100)] for _ in range(40)]
    left, right = (pa.array(r, pa.list_(pa.string())).slice(5, 30) for r in (rows, rows[::-1]))
    xy, _ = matching.ratios(left, right)
    for n, (a, b) in enumerate(zip(left.to_pylist(), right.to_pylist(), strict=True)):
        assert xy[n] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_each_sequence_pair_is_computed_once(spark, tmp_path):
    """Pairs of pages that hold two sequences, in any order, are one row of the kernel."""
    sequences = spark.createDataFrame(
        [(i, ["a", "b", "c"] if i % 2 else ["b", "c", "a", "d"]) for i in range(10)] + [(20, [])],
        "id long, seq array<string>",
    )
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(10) if a != b] + [(1, 20), (99, 1)], "a long, b long")
    found = matching.with_ratios(pairs, sequences).collect()
    assert len(found) == 91  # the id without a sequence is left out
    texts = {i: ["a", "b", "c"] if i % 2 else ["b", "c", "a", "d"] for i in range(10)} | {20: []}
    for r in found:
        assert r.seq_ab == pytest.approx(difflib.SequenceMatcher(None, texts[r.a], texts[r.b]).ratio())
        assert r.seq_ba == pytest.approx(difflib.SequenceMatcher(None, texts[r.b], texts[r.a]).ratio())


def random_sets(seed, n=250):
    draw = random.Random(seed)
    base = [[f"i{draw.randint(0, 60)}" for _ in range(draw.randint(1, 25))] for _ in range(25)]
    sets = []
    for _ in range(n):
        items = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            items[draw.randrange(len(items))] = f"i{draw.randint(0, 60)}"
        sets.append((len(sets), items))
    return [*sets, *[(1000 + i, sets[3][1]) for i in range(80)], (2000, []), (2001, None), (2002, ["i1", None])]


@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
def test_similar_sets(spark, least):
    rows = random_sets(1)
    found = set_join.similar_sets(spark.createDataFrame(rows, "id long, x array<string>"), "x", least).collect()
    held = {}
    for i, items in rows:
        key = frozenset(x for x in items or [] if x is not None)
        if key:
            held.setdefault(key, []).append(i)
    want = {}
    groups = [(min(v), len(v), k) for k, v in held.items()]
    for n, (a, p, x) in enumerate(groups):
        if p > 1:
            want[a, a] = (p * (p - 1) // 2, 1.0)
        for b, q, y in groups[n + 1 :]:
            jaccard = len(x & y) / len(x | y)
            if jaccard >= least:
                want[min(a, b), max(a, b)] = (p * q, jaccard)
    assert {(r.a, r.b): (r.page_pairs, pytest.approx(r.jaccard)) for r in found} == want
    assert len(found) == len(want)


def count_rows(seed, n=220):
    draw = random.Random(seed)
    base = [{f"t{t}": draw.randint(1, 40) for t in draw.sample(range(30), draw.randint(2, 12))} for _ in range(20)]
    rows = []
    for i in range(n):
        counts = dict(draw.choice(base)) | {"html": 1, "body": 1}
        for _ in range(draw.randint(0, 2)):
            counts[f"t{draw.randint(0, 29)}"] = draw.randint(1, 40)
        rows.append((i, sorted(counts.items())))
    return rows


@pytest.mark.parametrize("least", [0.99, 0.9, 0.4])
def test_alike_counts_and_their_probes(spark, least):
    rows = count_rows(2)
    df = spark.createDataFrame([*rows, (900, []), (901, [("t1", 0)])], "id long, counts array<struct<tag:string,n:long>>")
    names = sorted({t for _, c in rows for t, _ in c})
    matrix = np.array([[dict(c).get(t, 0) for t in names] for _, c in rows], float)
    units = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    alike = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(units @ units.T >= least + 1e-9, 1)), strict=True)}
    probes = set_join.count_probes(df, least)
    found = {tuple(r) for r in probes.distinct().collect()}
    assert alike <= found
    every = len(rows) * (len(rows) - 1) // 2
    if least == 0.99:  # the index rules out nearly all others
        assert probes.count() < 0.2 * every
    elif least == 0.9:
        assert len(found) < 0.6 * every


def test_probes_of_rare_items_grow_with_the_rows(spark):
    """Many groups of rows that share rare items: probes grow with the rows, not their square."""
    counts = []
    for groups in (100, 400):
        rows = spark.range(4 * groups).select(
            "id",
            F.array(
                *[F.concat(F.lit(f"g{k}-"), (F.col("id") % groups).cast("string")) for k in range(8)],
                F.lit("common"), F.concat(F.lit("own"), F.col("id").cast("string")),
            ).alias("x"),
        )
        counts.append(set_join.set_probes(set_join.fold_sets(rows, "x"), 0.8).count())
    assert 0 < counts[1] <= 5 * counts[0]


def test_limits_that_prune_nothing_are_refused(spark):
    df = spark.createDataFrame([(1, ["a"])], "id long, x array<string>")
    with pytest.raises(ValueError, match="above 0"):
        set_join.similar_sets(df, "x", 0.0)


def test_tally(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["x"])]
    got = structure.with_tally(spark.createDataFrame(rows, "id long, tags array<string>"), "tags").collect()
    assert {r.id: [tuple(e) for e in r["counts"]] for r in got} == {1: [("a", 1), ("b", 2)], 2: [], 3: [("x", 1)]}
