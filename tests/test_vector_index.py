"""The approximate index, and the ranges of whole columns, against brute force."""

import numpy as np
import pytest

from pagelens.operators import blend, vector_index, vector_join
from test_vector_join import sample, table


def clustered(n, seed=3, dims=12, centres=40):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dims))
    return middle[draw.integers(0, centres, n)] + 0.15 * draw.normal(size=(n, dims))


def test_visited_cells_are_the_nearest():
    draw = np.random.default_rng(1)
    books = draw.normal(size=(7, 3)), draw.normal(size=(5, 3))
    rows = draw.normal(size=(20, 6))
    far = np.array([[((r[:3] - x) ** 2).sum() + ((r[3:] - y) ** 2).sum() for x in books[0] for y in books[1]] for r in rows])
    for count in (1, 4, 35):
        found = vector_index.visited(rows, books, count)
        assert np.allclose(np.take_along_axis(far, found, 1), np.sort(far, 1)[:, :count])
    assert (vector_index.cells_of(rows, books) == far.argmin(1)).all()


@pytest.mark.parametrize("kind", ["clustered", "plain"])
def test_recall_of_the_index(spark, kind):
    rows = clustered(3_000) if kind == "clustered" else np.random.default_rng(2).normal(size=(1_500, 12))
    vectors = table(spark, range(len(rows)), rows)
    asked = vectors.where("id % 20 = 0")
    index = vector_index.fit(vectors, 10)
    best = vector_index.exact(vectors, asked, 10)
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    scores = np.round(units @ units.T, 9)
    np.fill_diagonal(scores, -2)
    for r in best.where("rank = 10").collect():
        assert r.similarity == pytest.approx(np.sort(scores[r.id])[-10], abs=1e-8)
    found = vector_index.search(index, asked, 10)
    for r in found.collect():
        assert r.similarity == pytest.approx(scores[r.id, r.neighbour], abs=1e-8)
    row = vector_index.recall(found, best).collect()[0]
    assert row.queries == len(rows) // 20 and row.neighbours == 10 * row.queries
    assert row.recall >= 0.9


def test_work_grows_slower_than_the_power_of_one_and_a_half(spark):
    """Candidates of searching all vectors, from n to 4 n."""
    candidates = []
    for n in (2_000, 8_000):
        rows = clustered(n, centres=400)
        index = vector_index.fit(table(spark, range(n), rows), 10)
        units = rows / np.linalg.norm(rows, axis=1)[:, None]
        held = np.bincount(vector_index.cells_of(units, index.books), minlength=len(index.books[0]) * len(index.books[1]))
        candidates.append(held[vector_index.visited(units, index.books, index.visits)].sum())
    assert candidates[1] < 4**1.5 * candidates[0]


def test_edge_vectors(spark):
    empty = table(spark, [], np.zeros((0, 3)))
    assert vector_index.search(vector_index.fit(empty), empty).collect() == []
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>")
    found = vector_index.search(vector_index.fit(vectors, 2), vectors, 2).collect()
    assert {(r.id, r.neighbour, r["rank"]) for r in found} >= {(1, 2, 1), (2, 1, 1)}
    assert {r.id for r in found} <= {1, 2, 5}


@pytest.mark.parametrize("block", [25, 2_000])
def test_column_ranges(spark, monkeypatch, block):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", block)
    ids, rows, scores = sample(7)
    found = {r.b: (r.lo, r.hi) for r in vector_join.column_ranges(table(spark, ids, rows)).collect()}
    assert len(found) == len(ids)
    for n, i in enumerate(ids):
        assert found[i] == (pytest.approx(scores[n].min(), abs=1e-9), 1.0)


def test_columns_beside_a_zero_vector(spark):
    rows = [(1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [0.0, 0.0]), (4, None)]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>")
    found = {r.b: (r.lo, r.hi) for r in vector_join.column_ranges(vectors).collect()}
    assert found == {1: (0.0, 1.0), 2: (0.0, 1.0), 3: (0.0, 0.0)}
    assert vector_join.column_ranges(vectors.limit(0)).collect() == []


def test_blend_over_whole_columns_equals_the_matrix(spark):
    ids, rows, scores = sample(9, n=60, copies=5)
    _, others, second = sample(10, n=60, copies=3)
    vectors = table(spark, range(60), rows)
    pairs = [(a, b, float(scores[a, b])) for a in range(60) for b in range(60) if a != b and scores[a, b] > 0.5]
    other = [(a, b, float(second[a, b])) for a, b, _ in pairs]
    schema = "a bigint, b bigint, similarity double"
    first_table = blend.with_diagonal(spark.createDataFrame(pairs, schema), vectors)
    second_table = blend.with_diagonal(spark.createDataFrame(other, schema), vectors)
    found = blend.weighted_blend(first_table, second_table, (0.7, 0.3), vector_join.column_ranges(vectors))
    low, high = scores.min(0), scores.max(0)
    whole = 0.7 * (scores - low) / (high - low) + 0.3 * second
    got = found.collect()
    assert len(got) == len(pairs) + 60
    for r in got:
        assert r.similarity == pytest.approx(whole[r.a, r.b], abs=1e-9)


def test_search_over_several_blocks_finds_each_neighbour_once(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 100)
    rows = clustered(600)
    vectors = table(spark, range(len(rows)), rows)
    index = vector_index.fit(vectors, 5)
    every = vector_index.Index(index.books, len(index.books[0]) * len(index.books[1]), index.placed)
    found = {tuple(r) for r in vector_index.search(every, vectors, 5).collect()}
    assert found == {tuple(r) for r in vector_index.exact(vectors, vectors, 5).collect()}
    assert len(found) == 5 * len(rows)
