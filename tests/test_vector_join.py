import numpy as np
import pytest

from pyspark.sql import functions as F

from pagelens.operators import blend, fusion, vector_join


def table(spark, ids, rows, id_type="bigint"):
    data = [(i, [float(x) for x in row]) for i, row in zip(ids, rows, strict=True)]
    return spark.createDataFrame(data, f"id {id_type}, vector array<double>")


def sample(seed=0, n=240, copies=80):
    """Clustered vectors, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 12))
    rows = centres[rng.integers(0, 8, n)] + 0.25 * rng.normal(size=(n, 12))
    rows[20:20 + copies] = rows[20]
    rows[-9:-6] = rows[-9]
    ids = [int(i) for i in rng.permutation(10 * n)[:n]]
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    return ids, rows, units @ units.T


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 25)


@pytest.mark.parametrize("limit", [0.999, 0.9, 0.3])
def test_similar_pairs_stand_for_every_pair(spark, limit):
    ids, rows, scores = sample()
    vs = table(spark, ids, rows)
    found = vector_join.similar_pairs(vs, limit).collect()
    upper = scores[np.triu_indices(len(ids), 1)]
    assert sum(r.page_pairs for r in found) == (upper >= limit - 1e-12).sum()
    at = {i: n for n, i in enumerate(ids)}
    for row in found:
        assert row.similarity == pytest.approx(scores[at[row.a], at[row.b]])
    assert len({(r.a, r.b) for r in found}) == len(found)


@pytest.mark.parametrize("copies", [80, 0])
def test_top_pairs(spark, copies):
    ids, rows, scores = sample(1, copies=copies)
    if not copies:
        rows[-9:-6] += np.eye(3, 12)
        units = rows / np.linalg.norm(rows, axis=1)[:, None]
        scores = units @ units.T
    found = vector_join.top_pairs(table(spark, ids, rows), 10).orderBy("rank").collect()
    every = sorted(
        (-round(scores[x, y], 9), min(ids[x], ids[y]), max(ids[x], ids[y]))
        for x in range(len(ids)) for y in range(x + 1, len(ids))
    )[:10]
    assert [(r.a, r.b) for r in found] == [(a, b) for _, a, b in every]


def test_nearest_with_copies(spark):
    ids, rows, scores = sample(2)
    found = {(r.id, r["rank"]): r for r in vector_join.nearest(table(spark, ids, rows), 5).collect()}
    assert len(found) == 5 * len(ids)
    for x in range(len(ids)):
        order = sorted((-round(scores[x, y], 9), ids[y]) for y in range(len(ids)) if y != x)[:5]
        assert [found[ids[x], k].neighbour for k in range(1, 6)] == [i for _, i in order]


def test_names_as_ids(spark):
    ids, rows, scores = sample(3, n=60, copies=10)
    names = [f"page{i}.html" for i in ids]
    vs = table(spark, names, rows, "string")
    found = vector_join.similar_pairs(vs, 0.9).collect()
    upper = scores[np.triu_indices(len(ids), 1)]
    assert sum(r.page_pairs for r in found) == (upper >= 0.9).sum()
    assert all(r.a <= r.b for r in found)
    near = vector_join.nearest(vs, 3).collect()
    assert len(near) == 3 * len(ids) and all(r.id != r.neighbour for r in near)
    assert vector_join.top_pairs(vs, 4).count() == 4


def test_few_vectors(spark):
    vs = table(spark, [1, 2, 3], [[1, 0], [0, 1], [0, 0]])
    assert vector_join.top_pairs(vs, 10).collect()[0]["similarity"] == pytest.approx(0.0)
    near = vector_join.nearest(vs, 15).collect()
    assert {(r.id, r.neighbour) for r in near} == {(1, 2), (2, 1)}


def test_mean_similarity(spark):
    ids, rows, scores = sample(4)
    got = vector_join.mean_similarity(table(spark, ids, rows)).first()
    assert got.mean_full == pytest.approx(scores.mean())
    assert got.mean_upper == pytest.approx(scores[np.triu_indices(len(ids), 1)].mean())


def test_scores_of_listed_pairs(spark):
    vs = table(spark, [1, 2], [[1, 1], [1, 0]])
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "a bigint, b bigint")
    found = vector_join.score_pairs(pairs, vs).collect()
    assert len(found) == 1 and found[0].similarity == pytest.approx(2**-0.5)


@pytest.fixture
def two_lenses(spark):
    """Two lenses of the same ids, the second without some of them, and numbers of the ids."""
    ids, rows, scores = sample(5, n=120, copies=20)
    _, others, second = sample(6, n=120, copies=3)
    others[7] = 0
    first = table(spark, ids, rows)
    numbers = spark.createDataFrame([(i, float(i % 3)) for i in ids], "id bigint, label double")
    return ids, first, table(spark, ids[5:], others[5:]), numbers


def joined_apart(first, second, limit):
    """The pairs of the first lens, joined to the second."""
    found = vector_join.similar_pairs(first, limit).where("a <> b").select("a", "b", "similarity")
    other = vector_join.score_pairs(found.select("a", "b"), second)
    return found.join(other.withColumnRenamed("similarity", "second"), ["a", "b"])


def test_pairs_scored_where_they_are_found(spark, two_lenses):
    _, first, second, numbers = two_lenses
    want = {(r.a, r.b): r for r in joined_apart(first, second, 0.3).collect()}
    found = vector_join.scored_pairs(first, 0.3, numbers, second).collect()
    assert len(found) == len(want) > 500
    for r in found:
        assert r.similarity == pytest.approx(want[r.a, r.b].similarity)
        assert r.second == pytest.approx(want[r.a, r.b].second)
        assert (r.label_a, r.label_b) == (r.a % 3, r.b % 3)
    both = blend.both_ends(vector_join.scored_pairs(first, 0.3, numbers), "label").collect()
    assert all(r.label == r.b % 3 for r in both) and {(r.a, r.b) for r in both} == {(r.b, r.a) for r in both}


def test_pairs_are_joined_to_nothing(spark, two_lenses):
    """Rows that are moved: as many as vectors times blocks, however many pairs there are."""
    _, first, second, numbers = two_lenses
    found = vector_join.scored_pairs(first, -2.0, numbers, second)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_moments_without_pairs(spark, two_lenses):
    _, first, second, numbers = two_lenses
    pairs = joined_apart(first, second, 0.3).withColumn("same", (F.col("a") % 3 == F.col("b") % 3).cast("double"))
    moments = vector_join.pair_moments(first, 0.3, second, numbers)
    want = pairs.agg(F.corr("second", "similarity").alias("r"), F.count("*").alias("n")).first()
    assert moments.count == want.n and moments.correlation(0, 1) == pytest.approx(want.r)
    fitted = fusion.fit_weights(pairs, ["second", "similarity"], "same")
    assert fusion.weights_of(moments.means, moments.products, ["second", "similarity"]) == pytest.approx(fitted)
    assert vector_join.pair_moments(first, 1.5, second).count == 0
    assert vector_join.pair_moments(first, 1.5, second).correlation(0, 1) is None


def test_lenses_compared_in_one_pass(spark, two_lenses):
    _, first, second, _ = two_lenses
    found = vector_join.compared_pairs({"one": (first, 0.9), "two": (second, 0.3)}).collect()
    want = blend.compare_lenses(
        {"one": vector_join.similar_pairs(first, 0.9), "two": vector_join.similar_pairs(second, 0.3)}
    )
    want = {(r.a, r.b): r for r in want.collect()}
    assert {(r.a, r.b) for r in found} == set(want) and len(found) == len(want)
    assert any(r.a == r.b for r in found) and any(r.one is None for r in found) and any(r.two is None for r in found)
    for r in found:
        assert r.one == pytest.approx(want[r.a, r.b].one) and r.two == pytest.approx(want[r.a, r.b].two)


def test_matrix_rows_equal_the_view_of_the_pairs(spark, two_lenses):
    _, first, _, _ = two_lenses
    pairs = blend.both_orders(vector_join.similar_pairs(first, 0.3).where("a <> b"))
    want = {(r.a, r.block): r for r in blend.matrix_view(pairs, F.floor(F.col("b") / 100).cast("bigint")).collect()}
    found = vector_join.matrix_rows(first, 0.3, F.floor(F.col("id") / 100)).collect()
    assert len(found) == len(want) > 100
    for r in found:
        assert r.columns == want[r.a, r.block].columns
        assert r.similarities == pytest.approx(want[r.a, r.block].similarities)


@pytest.mark.parametrize("n", [500, 1_500])
def test_rows_sent_grow_as_the_vectors(spark, n):
    """Vectors without any clusters: each is sent to BLOCKS blocks at most, not to every cell."""
    rows = np.random.default_rng(n).normal(size=(n, 12))
    vs = vector_join.fold_copies(table(spark, range(n), rows))
    placed = vector_join._spread(vs, vector_join._pivots(vs), vector_join._visits_within(1.2))
    sent = vector_join._groups(*placed, every=False, local=False).count()
    assert sent <= vector_join.BLOCKS * n
    sizes = [r["count"] for r in placed[0].groupBy("block").count().collect()]
    assert max(sizes) < 2 * n / len(sizes)
