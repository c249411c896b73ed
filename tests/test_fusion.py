"""Fitted weights and shared directions of lenses, against numpy."""

import numpy as np
import pytest

from pagelens.operators import fusion


def test_weights_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 0.3 * x[:, 0] - 1.2 * x[:, 1] + 0.5 + rng.normal(size=200) / 10
    rows = [(i, i + 1, float(p), float(q), float(t)) for i, ((p, q), t) in enumerate(zip(x, y))]
    rows += [(900, 901, None, 1.0, 5.0), (902, 903, 1.0, 1.0, None)]
    table = spark.createDataFrame(rows, "a long, b long, one double, two double, same double")
    found = fusion.fit_weights(table, ["one", "two"], "same")
    wanted = np.linalg.lstsq(np.column_stack([x, np.ones(200)]), y, rcond=None)[0]
    assert [found["one"], found["two"], found["intercept"]] == pytest.approx(wanted.tolist())
    scores = {r.a: r.similarity for r in fusion.fused(table, found).collect()}
    assert scores[3] == pytest.approx(x[3] @ wanted[:2] + wanted[2]) and scores[900] is None


def test_weights_of_equal_constant_and_no_lenses(spark):
    schema = "a long, b long, one double, two double, flat double, same double"
    rows = [(i, 0, float(i), float(i), 1.0, 4.0 * i + 1) for i in range(9)]
    table = spark.createDataFrame(rows, schema)
    found = fusion.fit_weights(table, ["one", "two", "flat"], "same")
    assert found == pytest.approx({"one": 2.0, "two": 2.0, "flat": 0.0, "intercept": 1.0})
    none = fusion.fit_weights(table.limit(0), ["one", "flat"], "same")
    assert none == {"one": 0.0, "flat": 0.0, "intercept": 0.0}


def test_canonical_against_numpy(spark):
    rng = np.random.default_rng(2)
    hidden = rng.normal(size=300)
    x = np.column_stack([hidden + rng.normal(size=300), rng.normal(size=300), np.full(300, 3.0)])
    y = np.column_stack([rng.normal(size=300), 5 * hidden + rng.normal(size=300)])
    schema = "id long, vector array<double>"
    first = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], schema)
    second = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)] + [(999, [0.0, 0.0])], schema)
    correlations, places = fusion.canonical(first, second)
    centred = [m - m.mean(0) for m in (x[:, :2], y)]
    bases = [np.linalg.qr(m)[0] for m in centred]
    assert correlations == pytest.approx(np.linalg.svd(bases[0].T @ bases[1])[1].tolist())
    rows = places.collect()
    assert len(rows) == 300
    for k, wanted in enumerate(correlations):
        along = np.array([(r.first[k], r.second[k]) for r in rows])
        assert np.corrcoef(along.T)[0, 1] == pytest.approx(wanted)
    assert fusion.canonical(first, second.where("id = 999"))[0] == []
    assert fusion.canonical(first, second.where("id = 999"))[1].count() == 0
