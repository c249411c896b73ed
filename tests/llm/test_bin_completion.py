"""Bin completion against the best packing of small cases, and its query against tokenizers."""

import random
import time
import zlib
from collections import defaultdict

import edge
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelens.llm import bin_completion
from pagelens.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[at]}.values():
            rooms[i] -= items[at]
            go(at + 1, rooms)
            rooms[i] += items[at]
        rooms.append(capacity - items[at])
        go(at + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def test_small_cases_are_packed_at_best():
    draw, better = random.Random(2), 0
    for _ in range(1_500):
        capacity, n = draw.choice([10, 20, 37, 50]), draw.randint(1, 11)
        items = [
            draw.randint(1, capacity) if draw.random() < 0.5 else draw.randint(capacity // 6 + 1, capacity // 2)
            for _ in range(n)
        ]
        bins = bin_completion.pack(items, capacity)
        assert sorted(x for b in bins for x in b) == sorted(items)
        assert max(map(sum, bins)) <= capacity
        best = fewest(items, capacity)
        assert len(bins) == best >= bin_completion.least_sequences(np.bincount(items, minlength=capacity + 1))
        better += len(bin_completion.best_fit(items, capacity)) > best
    assert better > 5  # cases that best fit alone does not pack at best


def test_completions_are_all_that_none_dominates():
    draw = random.Random(4)
    for _ in range(200):
        room = draw.randint(1, 14)
        counts = np.zeros(room + 3, int)
        for _ in range(draw.randint(0, 7)):
            counts[draw.randint(1, room + 2)] += 1
        found = [s for s in bin_completion.completions(counts, room) if s is not None]
        sets = {()}
        for size in range(1, room + 1):
            sets |= {tuple(sorted((*s, *[size] * k), reverse=True)) for s in sets for k in range(1, counts[size] + 1)}
        sets = {s for s in sets if sum(s) <= room}
        for s in found:
            assert s in sets
        for s in sets:  # each set is found or dominated by one that is
            assert any(bin_completion.dominates(f, s) for f in found)
        for i, s in enumerate(found):
            assert not any(bin_completion.dominates(f, s) for f in found[:i])
        assert [room - sum(s) for s in found] == sorted(room - sum(s) for s in found)


def test_many_items_come_near_the_bound():
    draw = np.random.default_rng(1)
    items = np.minimum(1023, draw.gamma(2.2, 200, 4_000).astype(int) + 5).tolist()
    bins, fit = bin_completion.pack(items), bin_completion.best_fit(items, 1024)
    bound = bin_completion.least_sequences(np.bincount(items, minlength=1025))
    assert bound <= len(bins) <= len(fit) and len(bins) <= 1.01 * bound
    assert bin_completion.pack(items) == bins


def test_many_tiny_items():
    """Thousands of empty texts beside a few long ones: sets of a thousand items each."""
    for items in ([1] * 3_000, [1] * 2_000 + [700] * 9 + [333] * 7, [2] * 900 + [3] * 900 + [511, 340]):
        bins = bin_completion.pack(items)
        assert sorted(x for b in bins for x in b) == sorted(items)
        assert len(bins) == bin_completion.least_sequences(np.bincount(items, minlength=1025))


def test_many_equal_items_end_soon():
    draw = np.random.default_rng(3)
    items = [130] * 3_000 + draw.integers(20, 60, 300).tolist() + draw.integers(1, 9, 40).tolist()
    start = time.process_time()
    bins = bin_completion.pack(items)
    assert time.process_time() - start < 20
    assert sorted(x for b in bins for x in b) == sorted(items)


def test_pieces_of_long_documents():
    pieces = bin_completion.place([1, 1024, 1025, 3000, 2048, 5])
    by_doc = defaultdict(list)
    for doc, piece, start, length, *_ in sorted(pieces):
        by_doc[doc].append((piece, start, length))
    assert by_doc == {
        0: [(0, 0, 1)], 1: [(0, 0, 1024)], 2: [(0, 0, 1), (1, 1, 1024)],
        3: [(0, 0, 952), (1, 952, 1024), (2, 1976, 1024)],
        4: [(0, 0, 1024), (1, 1024, 1024)], 5: [(0, 0, 5)],
    }
    assert len({p[4] for p in pieces}) == 7


def check(rows, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            crc = zlib.crc32(np.array(ids[start:end], "<u4").tobytes())
            want[doc_id].append((piece, start, end - start, crc))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_query_on_given_documents(spark):
    rows = LLM_QUERIES["op13_bin_completion"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert check(rows, docs) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_query_on_edge_tables(spark, tmp_path, name):
    df = edge.docs(spark) if name == "edge" else edge.empty(spark)
    rows = LLM_QUERIES["op13_bin_completion"](spark, edge.save(spark, tmp_path, df)).collect()
    check(rows, df.select("doc_id", "text").collect())
