"""Golay near-duplicates, components, repeated passages."""

import random

import brute
import edge
import numpy as np
import pytest

from pagelens.llm import components, golay, paragraphs
from pagelens.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_word_has_one_codeword_within_three_bits():
    draw = random.Random(1)
    words = np.array([draw.getrandbits(23) for _ in range(2000)], np.int32)
    index = golay.codeword_index(words)
    assert index.min() >= 0 and index.max() < 4096
    low, high, errors = golay._tables()
    error = errors[low[words & 0xFFF] ^ high[words >> 12]]
    assert max(int(e).bit_count() for e in error) <= 3
    assert (golay.codeword_index(words ^ error) == index).all()


def test_near_indices_number_one_or_six():
    words = np.arange(0, 1 << 23, 9973, dtype=np.int32)
    assert {len(x) for x in golay.near_indices(words, 23)} <= {1, 2, 3, 4, 5, 6}


def test_keys_meet_for_every_error_of_three_bits():
    draw = random.Random(2)
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.choice([1, 2, 3])):
            b ^= 1 << bit
        both = np.array([a, b], np.uint64).view(np.int64)
        looked, own = golay.search_keys(both), golay.own_keys(both)
        assert set(looked[0].tolist()) & set(own[1].tolist())
        assert set(looked[1].tolist()) & set(own[0].tolist())


def test_links_equal_brute_force(spark):
    draw = random.Random(3)
    prints = [draw.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for _ in range(4):
            q = p
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                q ^= 1 << bit
            prints.append(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in {*prints, 0}]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r.a, r.b) for r in golay.links(df).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("kind", ["given", "edge"])
def test_groups_equal_brute_force(spark, kind):
    if kind == "given":
        df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
        rows = [tuple(r) for r in df.collect()]
    else:
        rows = [(i, t) for i, t, *_ in edge.rows() if i is not None]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: brute.simhash(t) for i, t in rows}
    want = brute.near_components(prints)
    got = golay.groups(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.fp & ((1 << 64) - 1) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want


def test_one_of_each_group_stays(spark):
    docs = edge.docs(spark)
    kept = golay.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 8, 9, 10, 11]
    assert ids.count(None) == 1


def test_rows_of_one_id_in_different_groups_stay(spark):
    draw = random.Random(31)
    a, b, c, d, e = (text(draw, 60) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (6, d), (8, c), (None, e), (9, e), (9, e)]
    kept = golay.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, b), (7, c), (6, d), (9, e)])


def test_no_rows(spark):
    none = edge.empty(spark)
    assert golay.groups(none.select("doc_id", "text")).collect() == []
    assert golay.keep_one(none).collect() == []
    assert paragraphs.repeated(none.select("doc_id", "text")).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 140)]
    df = spark.createDataFrame(chain + star + [(7, 7), (500, 499)], "a long, b long")
    got = dict(map(tuple, components.components(df).collect()))
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 140), 100) | {499: 499, 500: 499}
    assert got == want


def text(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(n))


def test_passages_are_found_wherever_they_stand(spark):
    draw = random.Random(5)
    rows, planted = [], set()
    for p in range(12):
        passage = text(draw, draw.randint(52, 110))
        for _ in range(draw.randint(2, 5)):
            doc = len(rows)
            rows.append((doc, text(draw, draw.randint(0, 80)) + " " + passage + " " + text(draw, draw.randint(5, 80))))
            planted.add(doc)
    rows += [(1000 + i, text(draw, 120) + "\nAll rights reserved.\n" + text(draw, 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated(df).collect()
    assert {r.doc_id for r in found} == planted
    texts = dict(rows)
    first = {}
    for r in found:
        part = " ".join(texts[r.doc_id][r.start : r.stop].split())
        assert len(part.split()) == r.n_words
        first.setdefault(r.class_id, set()).add(part)
    for parts in first.values():  # equal, or near-equal at the edge of a passage
        sets = [{tuple(p.split()[i : i + 5]) for i in range(len(p.split()) - 4)} for p in parts]
        assert all(any(len(a & b) >= 0.8 * len(a | b) for b in sets if b is not a or len(sets) == 1) for a in sets)
    for c in first:
        assert sum(not r.removed for r in found if r.class_id == c) == 1


@pytest.mark.parametrize("changed", [0, 1])
def test_passages_of_just_over_50_words_are_found(spark, changed):
    draw = random.Random(21 + changed)
    rows, planted = [], []
    for n in range(51, 71):
        for _ in range(10):
            passage = text(draw, n).split()
            for copy in range(2):
                words = list(passage)
                if copy and changed:
                    words[n // 2 + draw.randint(-5, 5)] = "changed"
                planted.append(len(rows))
                rows.append((len(rows), f"{text(draw, 40)} {' '.join(words)} {text(draw, 40)}"))
    rows += [(1000 + i, text(draw, 160)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in paragraphs.repeated(df).collect()}
    assert found <= set(planted) and len(found) >= 0.985 * len(planted)


def test_runs_bridge_only_what_two_documents_hold(spark):
    # Classes 1, 2 stand around a gap in documents 1 and 2; 3, 4 only in document 3.
    rows = [(1, 0, 1), (1, 2, 2), (2, 5, 1), (2, 6, 9), (2, 7, 2), (3, 0, 3), (3, 2, 4), (3, 9, 1), (3, 20, 2)]
    df = spark.createDataFrame(rows, "doc_id long, paragraph int, class_id long")
    runs = {(r.doc_id, r.paragraph): r.run for r in paragraphs.in_runs(df).collect()}
    assert len(runs) == len(rows) and runs[1, 0] == runs[1, 2]
    assert runs[2, 5] == runs[2, 6] == runs[2, 7]
    assert len({runs[3, p] for p in (0, 2, 9, 20)}) == 4


def test_near_equal_paragraphs_link_by_jaccard(spark):
    draw = random.Random(6)
    base = text(draw, 30).split()
    sets = [np.arange(20), np.concatenate([np.arange(18), [90, 91]]), np.concatenate([np.arange(10), np.arange(50, 60)])]
    rows = [(i, [int(x) for x in s]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "h long, shingles array<int>")
    assert base and {tuple(r) for r in paragraphs.links(df).collect()} == {(0, 1)}


def test_forests_connect_what_is_connected():
    draw = random.Random(11)
    sets = []
    for _ in range(12):
        own = sorted(draw.sample(range(10_000), 20))
        for _ in range(draw.randint(1, 6)):
            sets.append(np.array(sorted({*own[: 20 - draw.randint(0, 2)], *draw.sample(range(10_000), draw.randint(0, 1))}), np.int32))
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
               if i < j and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}

    def classes(pairs):
        root = list(range(len(sets)))
        for _ in sets:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    edges = [tuple(sorted(e)) for e in paragraphs.forest(sets)]
    assert len(edges) < len(sets)
    assert classes(edges) == classes(similar)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "SMALL", 1)
    draw = random.Random(8)
    sets = []
    for _ in range(30):
        own = [draw.randrange(1 << 30) for _ in range(20)]
        sets += [own, own[:-1], own[:-2] + [draw.randrange(1 << 30)]]
    rows = [(i, sorted(set(s))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "h long, shingles array<int>")
    got = {tuple(r) for r in paragraphs.links(df).collect()}
    want = set()
    for i, a in rows:
        for j, b in rows:
            if i < j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
                want.add((i, j))
    assert got <= want and len(got) >= 0.95 * len(want)  # banding finds 98.3 % at the limit


def test_edge_rows(spark):
    found = paragraphs.repeated(edge.docs(spark).select("doc_id", "text")).collect()
    assert {r.doc_id for r in found} == {5, 6}


def test_passages_shared_with_documents_without_ids(spark):
    draw = random.Random(41)
    shared, alone = text(draw, 80), text(draw, 90)
    around = [text(draw, 30) for _ in range(8)]
    texts = [f"{a} {shared} {b}" for a, b in zip(around[::2], around[1::2], strict=True)]

    def marked(rows):
        found = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        for c in {r.class_id for r in found}:
            assert sum(not r.removed for r in found if r.class_id == c) == 1
        return found

    with_ids = marked([(1, texts[0]), (2, texts[1]), (9, alone)])
    a_class = len({r.class_id for r in with_ids})
    assert a_class > 4 and len(with_ids) == 2 * a_class
    one_null = marked([(1, texts[0]), (2, texts[1]), (None, texts[2]), (9, alone)])
    # Paragraphs at the edges of the passage depend on what stands around it.
    assert all(sum(r.doc_id == i for r in one_null) >= a_class - 1 for i in (1, 2, None))
    assert len({r.class_id for r in one_null if r.class_doc == 1}) >= a_class - 1
    assert all(r.doc_id == r.class_doc for r in one_null if not r.removed)
    nulls = marked([(None, texts[0]), (None, texts[1]), (None, texts[1])])
    assert len(nulls) == 2 * a_class and {r.class_doc for r in nulls} == {None}
    assert sum(r.removed for r in nulls) == a_class
    one_id = marked([(5, texts[0]), (5, texts[1]), (5, texts[0]), (5, alone)])
    assert len(one_id) == 2 * a_class and {r.class_doc for r in one_id} == {5}
    assert marked([(5, texts[0]), (5, texts[0])]) == []


def test_query_names():
    assert [n for n in LLM_QUERIES if n.startswith("op8_")]
