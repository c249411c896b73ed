"""Scaling, quantiles, pair tables, projection, cache state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators import blend, embed, incremental, project, ranks, scaling, vector_join
from pagelens.plans import semantic


def test_quantiles_of_one_large_group(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=4000), 2)
    rows = [("big", float(v)) for v in values] + [("small", 1.0), ("small", 2.0)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    counts = ranks.running_counts(table, "g", "v")
    found = {r.g: r for r in ranks.quantiles(counts, "g", "v", {"q": 0.1, "h": 0.5}).collect()}
    assert found["big"].q == pytest.approx(np.percentile(values, 10))
    assert found["big"].h == pytest.approx(np.percentile(values, 50))
    assert found["small"].h == 1.5


def test_weighted_quantiles(spark):
    table = spark.createDataFrame([("g", 1.0, 5), ("g", 2.0, 1)], "g string, v double, w bigint")
    counts = ranks.running_counts(table, "g", "v", F.col("w"))
    assert ranks.quantiles(counts, "g", "v", {"q": 0.9}).first().q == pytest.approx(1.5)


def test_standard_vectors(spark):
    rows = [(1, 1, 5.0, True, "x"), (2, 3, 5.0, False, "y"), (3, None, 5.0, True, "z")]
    table = spark.createDataFrame(rows, "page_id bigint, n int, c double, flag boolean, s string")
    found = {r.id: list(r.vector) for r in scaling.standard_vectors(table).collect()}
    data = np.array([1.0, 3.0, 0.0])
    expected = (data - data.mean()) / data.std()
    for i in range(3):
        assert found[i + 1] == pytest.approx([expected[i], 0.0])


def test_profile(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    table = spark.createDataFrame(list(enumerate(values)), "page_id bigint, v double")
    got = scaling.profile(table).first()
    assert (got["count"], got["min"], got["max"], got.q25, got.q50, got.q75) == (5, 1, 5, 1, 3, 4)
    assert got["std"] == pytest.approx(np.std(values, ddof=1))


def test_combined_vectors_over_shared_ids(spark):
    first = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [9.0])], "id bigint, vector array<double>")
    second = spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0])], "id bigint, vector array<double>")
    found = {r.id: list(r.vector) for r in scaling.combine(first, second).collect()}
    assert found == {1: [-1.0, -1.0, 0.0], 2: [1.0, 1.0, 0.0]}


@pytest.fixture
def lenses(spark):
    schema = "a bigint, b bigint, similarity double"
    first = [(a, b, float(10 * a + b) / 100) for a in range(1, 5) for b in range(1, 5) if (a, b) != (4, 1)]
    first = [(a, b, 0.5 if b == 3 else s) for a, b, s in first]
    second = [(a, b, 1.0 if a == b else 0.25) for a in range(1, 5) for b in range(1, 5)]
    return spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)


def test_blend(lenses):
    first, second = lenses
    scaled = {(r.a, r.b): r.similarity for r in blend.column_min_max(first).collect()}
    assert scaled[1, 2] == 0.0 and scaled[4, 2] == 1.0 and scaled[2, 2] == pytest.approx(1 / 3)
    assert scaled[1, 3] == 0.0
    mixed = {(r.a, r.b): r.similarity for r in blend.weighted_blend(first, second, (0.7, 0.3)).collect()}
    assert mixed[4, 2] == pytest.approx(0.7 + 0.3 * 0.25) and (4, 1) not in mixed
    assert blend.weight_sweep(first, second).count() == 15 * 5
    with pytest.raises(ValueError, match="sum to 1"):
        blend.weighted_blend(first, second, (0.7, 0.4))


def test_comparison_and_matrix(lenses):
    first, second = lenses
    compared = blend.compare_lenses({"one": first, "two": second})
    row = compared.where("a = 4 and b = 1").first()
    assert row.one is None and row.two == 0.25
    assert blend.lens_correlation(compared, "one", "two").first().pairs == 15
    view = {(r.a, r.block): r for r in blend.matrix_view(second).collect()}
    assert view[2, 0].columns == [1, 2, 3, 4] and list(view[2, 0].similarities) == [0.25, 1.0, 0.25, 0.25]


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(40, 5)) * [5, 3, 1, 1, 1] + 7
    table = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(data)], "id bigint, vector array<double>"
    )
    found = sorted(project.pca_2d(table).collect())
    centred = data - data.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    expected = centred @ axes[:2].T
    for axis, name in enumerate(("x", "y")):
        got = np.array([r[name] for r in found])
        assert np.allclose(got, expected[:, axis]) or np.allclose(got, -expected[:, axis])


def test_layout_stress_never_rises(spark):
    points = np.random.default_rng(2).random((12, 2))
    pairs = [
        (i, j, float(1 - np.linalg.norm(points[i] - points[j]))) for i in range(12) for j in range(i + 1, 12)
    ]
    table = spark.createDataFrame(pairs, "a bigint, b bigint, similarity double")
    layout, stresses = project.metric_layout(table, iterations=10)
    assert layout.count() == 12
    assert all(later <= sooner + 1e-9 for sooner, later in zip(stresses, stresses[1:], strict=False))
    assert stresses[-1] < 0.5 * stresses[0]


def cache_rows(spark, *rows):
    return spark.createDataFrame(list(rows), incremental.cache_schema())


def test_change_detection_and_upsert(spark):
    cache = cache_rows(
        spark, (1, "m", "h1", [1.0]), (2, "m", "old", [2.0]), (4, "m", "h4", [4.0]), (1, "other", "x", [9.0]),
        (5, "m", "h5", None),
    )
    current = spark.createDataFrame(
        [(1, "m", "h1"), (2, "m", "h2"), (3, "m", "h3"), (5, "m", "h5")],
        "page_id bigint, model string, content_hash string",
    )
    assert sorted(r.page_id for r in incremental.changed_pages(current, cache).collect()) == [2, 3, 5]
    new = cache_rows(spark, (2, "m", "h2", [22.0]), (3, "m", "h3", None))
    merged = {(r.page_id, r.model): (r.content_hash, r.embedding) for r in
              incremental.upsert_cache(cache, new).collect()}
    assert merged[2, "m"] == ("h2", [22.0]) and merged[4, "m"] == ("h4", [4.0])
    assert (3, "m") not in merged and merged[1, "other"] == ("x", [9.0])
    origins = {r.page_id: r.origin for r in incremental.resolve_vectors(current, cache, new).collect()}
    assert origins == {1: "cached", 2: "new", 3: "missing", 5: "missing"}


def test_provider_errors_stay_with_their_row(spark):
    def picky(batch):
        if "bad" in batch:
            raise RuntimeError("refused")
        return [[float(len(t))] for t in batch]

    texts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc")], "page_id bigint, text string").coalesce(1)
    found = {r.page_id: (r.embedding, r.error) for r in embed.embed_texts(texts, picky).collect()}
    assert found == {1: ([1.0], None), 2: (None, "refused"), 3: ([3.0], None)}


def test_batches_hold_64_texts_at_most(spark):
    def sized(batch):
        return [[float(len(batch))] for _ in batch]

    texts = spark.range(150).select(F.col("id").alias("page_id"), F.lit("x").alias("text")).coalesce(1)
    sizes = [r.embedding[0] for r in embed.embed_texts(texts, sized).collect()]
    assert sorted(set(sizes)) == [22.0, 64.0]


def test_describe_then_embed(spark):
    def describe(prompts):
        if any("boom" in p for p in prompts):
            raise ValueError("no description")
        return ["alpha beta" for _ in prompts]

    made = spark.createDataFrame([(1, "<p>"), (2, "boom")], "page_id bigint, html string").coalesce(1)
    found = {r.page_id: r for r in semantic.describe_then_embed(made, describe, embed.hashed_words(8)).collect()}
    assert len(found[1].embedding) == 8 and found[1].error is None
    assert found[2].embedding is None and found[2].error == "no description"


def test_tfidf_and_cost(spark):
    texts = spark.createDataFrame([(1, "a b b"), (2, "a c")], "page_id bigint, text string")
    vectors = embed.tfidf_vectors(texts, 16)
    assert vector_join.mean_similarity(vectors).first().vectors == 2
    cost = embed.batch_cost(texts.limit(9)).first()
    assert cost.texts == 2 and cost.minutes == pytest.approx(2 * 25 / 60)


def test_hashed_words_agree_in_both_forms(spark):
    texts = ["a b b", "", "Été_1 été, ½ x", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, text string")
    provider = embed.hashed_words(8)
    found = {r.page_id: r.embedding for r in embed.embed_texts(df, provider).collect()}
    for i, want in enumerate(provider(texts)):
        assert found[i] == pytest.approx(want)


def test_key_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "m", "a")], "page_id int, model string, text string")
    for provider in (embed.hashed_words(2), lambda batch: [[1.0] for _ in batch]):
        (row,) = embed.embed_texts(df, provider, keep=("model",)).collect()
        assert row.asDict().keys() == {"page_id", "model", "embedding", "error"} and row.model == "m"
