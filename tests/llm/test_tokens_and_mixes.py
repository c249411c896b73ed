"""Packing and mixing against plain versions."""

import zlib
from collections import defaultdict

import brute
import edge
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelens.llm import mixing, packing
from pagelens.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = [
    "", " ", "  two  blanks ", "line\n end \n\n x", "it's 'll 12345 ＡＢ ünï 😀😀 \t x", "a<|endoftext|>b c",
    "x   y z", " \n", "tail ", "…—​ zero",
]


def test_ids_equal_tokenizers(tokenizer):
    texts = ODD + [t or "" for _, t, *_ in edge.rows() if len(t or "") < 10_000]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.tokens().ids(text), "<u4").tolist() == want, text


@settings(max_examples=300, deadline=None)
@given(st.text(" \n\t ab'sé9.😀", max_size=30))
def test_ids_of_random_texts(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.tokens().ids(text), "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=60))
def test_blocks_are_filled_without_padding(lengths):
    pieces = packing.pack(lengths)
    covered, places = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        covered[doc].append((start, length))
        places[sequence].append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at
            at += length
        assert at == n
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_costs_are_balanced():
    draw = np.random.default_rng(4)
    lengths = draw.integers(20, 1200, 400).tolist()
    cost = defaultdict(float)
    for _, _, length, sequence, _ in packing.pack(lengths):
        cost[sequence] += packing.cost(length)
    full = sorted(cost.values())[10:]
    assert max(full) < 1.6 * min(full)


def check_pieces(rows, texts, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packed_query(spark, tokenizer):
    rows = LLM_QUERIES["op2_packed_sequences"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    check_pieces(rows, [tuple(r) for r in docs], tokenizer)


def test_packing_edge_rows(spark, tokenizer):
    rows = [r for r in edge.rows() if r[0] is not None]
    unique = {r[0]: r for r in rows}
    df = spark.createDataFrame(list(unique.values()), edge.SCHEMA)
    check_pieces(packing.packed(df).collect(), [(r[0], r[1]) for r in unique.values()], tokenizer)
    assert packing.packed(edge.docs(spark)).agg({"length": "sum"}).first()[0] > 0
    assert packing.packed(edge.empty(spark)).collect() == []


def test_flight_keeps_totals_and_leaves_two():
    draw = np.random.default_rng(3)
    units = [(float(p), float(s)) for p, s in zip(draw.random(300), draw.integers(1, 5000, 300), strict=True)]
    result = mixing.flight(units, mixing._seed("test"))
    assert sum(0 < p < 1 for p in result) <= 2
    assert sum(result) == pytest.approx(sum(p for p, _ in units), abs=1e-3)
    assert sum(r * s for r, (_, s) in zip(result, units, strict=True)) == pytest.approx(
        sum(p * s for p, s in units), rel=1e-6
    )


def test_flight_keeps_chances():
    units = [(0.3, float(s)) for s in (10, 20, 30, 40, 50, 60, 70, 80)]
    hits = np.zeros(len(units))
    for n in range(3000):
        hits += mixing.flight(units, mixing._seed(n))
    assert abs(hits / 3000 - 0.3).max() < 0.04


def test_landing_takes_the_nearest_rounding():
    assert mixing.landing([(0.5, 10.0), (0.5, 10.0)]) in ([1.0, 0.0], [0.0, 1.0])
    assert mixing.landing([(0.9, 100.0), (0.1, 5.0)]) == [1.0, 0.0]
    assert mixing.landing([]) == []


def check_mix(rows, docs):
    sizes, by_source = defaultdict(list), defaultdict(int)
    for i, text, source in docs:
        n = len(brute.WORD.findall(text or ""))
        sizes[i].append(n)
        by_source[source] += n
    want, taken = brute.mix_targets(by_source), defaultdict(int)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in sizes.items()}
    return taken, want


def test_mix_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs.select("doc_id", "source", "text")).collect()
    taken, want = check_mix(rows, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    assert all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in want)
    spread = docs.repartition(13, "lang").select("doc_id", "source", "text")
    assert sorted(map(tuple, mixing.mix(spread).collect())) == sorted(map(tuple, rows))


def test_levels_meet_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(i, "ab"[i % 3 == 0], "w " * (1 + i * 37 % 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, want = check_mix(mixing.mix(df).collect(), [(i, t, s) for i, s, t in rows])
    assert all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in want)


def test_small_sources_beside_a_large_one(spark):
    draw = np.random.default_rng(12)
    units, want, most = [], defaultdict(float), {}
    for stratum, n in enumerate([3000, 20, 50, 100, 200, 300, 500, 700, 1200]):
        sizes = np.maximum(1, draw.lognormal(5, 1, n)).astype(int)
        sizes[: max(1, n // 100)] = 2_000
        p = float(draw.uniform(0.1, 0.9))
        want[stratum], most[stratum] = p * float(sizes.sum()), n
        units += [(stratum, n, 10_000 * stratum + i, 1, int(x), p) for i, x in enumerate(sizes)]
    df = spark.createDataFrame(units, "stratum long, n long, doc_id long, copy long, size long, p double")
    drawn, got = mixing.sample(df).collect(), defaultdict(float)
    size = {u[2]: u[4] for u in units}
    assert len(drawn) == len(units) and {r.p for r in drawn} == {0.0, 1.0}
    for r in drawn:
        got[r.doc_id // 10_000] += size[r.doc_id] * r.p
    miss = {most[s]: abs(got[s] - want[s]) / want[s] for s in want}
    assert all(miss[n] < (0.01 if n >= 50 else 0.1) for n in miss), miss


def test_mix_edge_rows(spark):
    docs = edge.docs(spark)
    rows = mixing.mix(docs.select("doc_id", "source", "text")).collect()
    check_mix(rows, [(i, t, s) for i, t, _, s, *_ in edge.rows()])
    repeated = mixing.repeat(docs)
    assert repeated.columns == docs.columns
    times = sum(r.times for r in rows)
    assert repeated.count() == times
    assert mixing.mix(edge.empty(spark).select("doc_id", "source", "text")).collect() == []
    assert mixing.repeat(edge.empty(spark)).collect() == []
