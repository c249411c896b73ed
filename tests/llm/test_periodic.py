"""Runs of repeated words against a search of every period."""

import hashlib
import random
import zlib

import edge
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import periodic
from pagelens.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


def all_runs(words, least=2, power=2):
    """(start, length, period): each period on its own, longest stretches, least periods only."""
    found, covered = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            end = i
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            start, length = i, end - i + q
            if end > i and length >= 2 * q and (start, length) not in covered:
                covered.add((start, length))
                if length >= max(least, power * q):
                    found.append((start, length, q))
            i = max(end, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_squares_of_short_alphabets(words):
    ends = periodic.ends_of_squares(words)
    assert sorted((s, e - s + 1, q) for (s, q), e in ends.items()) == sorted(all_runs(words))


def test_runs_with_noise_between_and_within():
    draw = random.Random(3)
    for _ in range(300):
        words = []
        for _ in range(draw.randint(1, 4)):
            words += [str(draw.randint(0, 5000)) for _ in range(draw.randint(0, 40))]
            part = [str(draw.randint(0, 4)) for _ in range(draw.randint(1, 30))]
            words += (part * 5)[: draw.randint(1, 5 * len(part))]
        if draw.random() < 0.5:
            words[draw.randrange(len(words))] = "odd"
        assert periodic.runs_of(words) == all_runs(words, 24, 3)


def test_limits_are_exact():
    for q in (1, 7, 8, 9, 20):
        long_enough = max(24, 3 * q)
        part = [f"w{i}" for i in range(q)]
        for length in (long_enough - 1, long_enough):
            words = ["a", "b"] + (part * 60)[:length] + ["c"]
            expected = [(2, length, q)] if length == long_enough else []
            assert periodic.runs_of(words) == expected
    assert periodic.window_size(24, 3) == 16


def test_a_long_text_of_one_run_and_of_many():
    one = ["x", "y", "z"] * 100_000
    assert periodic.runs_of(one) == [(0, 300_000, 3)]
    draw = random.Random(5)
    block = [str(draw.randint(0, 10**6)) for _ in range(5_000)]
    words = block * 2 + ["end"] + block
    assert periodic.runs_of(words) == []  # two periods are not three
    assert periodic.runs_of(block * 3) == [(0, 15_000, 5_000)]


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words, 24, 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (
        doc_id, len(runs), *best, milli,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_query_on_given_documents(spark):
    rows = LLM_QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) <= 2_000}
    assert len(rows) == len(docs) and len(short) > 100
    got = {r.doc_id: tuple(r) for r in rows}
    assert any(r.n_runs for r in rows)
    for doc_id, text in short.items():
        assert got[doc_id] == expected(doc_id, text)


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_query_on_edge_tables(spark, tmp_path, name):
    df = edge.docs(spark) if name == "edge" else edge.empty(spark)
    folder = edge.save(spark, tmp_path, df)
    rows = LLM_QUERIES["op11_periodic_runs"](spark, folder).collect()
    want = [expected(r.doc_id, r.text) for r in df.collect() if r.text is None or len(r.text) < 10**5]
    got = [tuple(r) for r in rows]
    assert len(got) == df.count()
    for row in want:
        assert got.count(row) == want.count(row)


def test_operator_returns_spans_and_texts(spark):
    text = "start " + "a b  c\n" * 9 + "end"
    row = periodic.find(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_words int")).collect()[0]
    assert (row.n_words, row.collapsed) == (29, "start a b c end")
    assert [tuple(r) for r in row.runs] == [(1, 27, 3)]
