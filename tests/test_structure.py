import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import pages, parsed
from pagelens.operators import structure, summary, vector_join
from pagelens.plans import structural


def random_pages(count=40, seed=5):
    rng = random.Random(seed)
    made = []
    for _ in range(count):
        body = "".join(
            rng.choice(["<p></p>", "<p></p>", "<li></li>", "<i class='c1'></i>", "<b id='k1'></b>", "<input>"])
            + rng.choice(["", "", "", f"<u id='{rng.choice('abcdef')}'></u>"])
            for _ in range(rng.choice([3, 12, 14, 15, 120]))
        )
        made.append(f"<html><body class='{rng.choice(['x', 'y', 'x y'])}'>{body}</body></html>")
    return made + made[:3] * 8 + ["", "text"]


def brute_score(x, y):
    def counts(row):
        return {e.tag: e.n for e in row["counts"]}

    def relative(p, q):
        return abs(p - q) / max(p, q, 1)

    cx, cy = counts(x), counts(y)
    terms = [2 * difflib.SequenceMatcher(None, x.seq, y.seq).ratio()]
    if cx or cy:
        lengths = np.sqrt(sum(n * n for n in cx.values())) * np.sqrt(sum(n * n for n in cy.values()))
        terms.append(sum(n * cy.get(t, 0) for t, n in cx.items()) / lengths if lengths else 0.0)
    terms.append(1 - np.mean([relative(x[c], y[c]) for c in ("unique_classes", "unique_ids")]))
    terms.append(1 - np.mean([relative(x[c], y[c]) for c in structure.FORM_COUNTS]))
    union = set(x.patterns) | set(y.patterns)
    if union:
        terms.append(1.5 * len(set(x.patterns) & set(y.patterns)) / len(union))
    return float(np.mean(terms))


@pytest.mark.parametrize(
    ("limit", "block", "places", "buckets"), [(1.2, 2000, 127, 64), (1.0, 9, 3, 2), (0.91, 20, 40, 7)]
)
def test_similar_structures_against_brute_force(spark, monkeypatch, limit, block, places, buckets):
    monkeypatch.setattr(structure, "PATTERN_BUCKETS", buckets)
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(structure, "TOKEN_PLACES", places)
    monkeypatch.setattr(structure, "TAG_PLACES", places)
    sigs = structure.signatures(structure.page_structures(parsed(spark, *random_pages())))
    rows = sigs.collect()
    found = {(r.a, r.b): r for r in structure.similar_structures(sigs, limit).collect()}
    expected = set()
    for x in rows:
        if x.pages > 1:
            expected.add((x.sig, x.sig))
        for y in rows:
            if x.sig < y.sig:
                ab, ba = brute_score(x, y), brute_score(y, x)
                if max(ab, ba) >= limit:
                    expected.add((x.sig, y.sig))
                    assert found[x.sig, y.sig].score_ab == pytest.approx(ab)
                    assert found[x.sig, y.sig].score_ba == pytest.approx(ba)
    assert found.keys() == expected


def test_self_scores(spark):
    sigs = structure.signatures(
        structure.page_structures(parsed(spark, "<p class='c'>", "<p class='c'>", "<i>", "<i>", "", ""))
    )
    found = {r.a: r for r in structure.similar_structures(sigs, 1.2).collect() if r.a == r.b}
    assert found[1].score_ab == pytest.approx(1.3)
    assert found[3].score_ab == pytest.approx(1.25)
    assert found[5].score_ab == pytest.approx(4 / 3)
    assert all(r.score_norm == pytest.approx(1.0) and r.page_pairs == 1 for r in found.values())


def test_low_limits_are_refused(spark):
    sigs = structure.signatures(structure.page_structures(parsed(spark, "<p>")))
    with pytest.raises(ValueError, match="0.9"):
        structure.similar_structures(sigs, 0.9)
    with pytest.raises(ValueError, match="above 0"):
        structure.similar_tag_counts(structure.tag_groups(structure.page_tag_counts(parsed(spark, "<p>"))), 0.0)


@pytest.mark.parametrize(("limit", "places"), [(0.99, 255), (0.5, 2)])
def test_similar_tag_counts_against_brute_force(spark, monkeypatch, limit, places):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 9)
    monkeypatch.setattr(structure, "TOKEN_PLACES", places)
    counted = structure.page_tag_counts(parsed(spark, *random_pages(seed=9)))
    groups = structure.tag_groups(counted)
    rows = [r for r in groups.collect() if r["counts"]]
    vectors = {r.sig: {e.tag: e.n for e in r["counts"]} for r in rows}

    def cosine(x, y):
        dot = sum(n * y.get(t, 0) for t, n in x.items())
        return dot / np.sqrt(sum(n * n for n in x.values())) / np.sqrt(sum(n * n for n in y.values()))

    expected = {
        (a, b) for a in vectors for b in vectors if a < b and cosine(vectors[a], vectors[b]) >= limit
    }
    found = structure.similar_tag_counts(groups, limit).collect()
    across = [(r.a, r.b) for r in found if r.a != r.b]
    assert set(across) == expected and len(across) == len(expected)
    within = {r.a: r.page_pairs for r in found if r.a == r.b}
    assert within == {r.sig: r.pages * (r.pages - 1) // 2 for r in rows if r.pages > 1}


def test_symmetric_terms_and_listed_pairs(spark):
    made = random_pages(10)
    structures = structure.page_structures(parsed(spark, *made))
    pairs = spark.createDataFrame([(i, j) for i in range(1, 9) for j in range(1, 9)], "a bigint, b bigint")
    rows = {(r.a, r.b): r for r in structure.score_listed(pairs, structures).collect()}
    by_id = {r.page_id: r for r in structures.collect()}
    for (i, j), row in rows.items():
        mirror = rows[j, i]
        for term in ("tag_sim", "css_sim", "form_sim", "pattern_sim"):
            assert row[term] == pytest.approx(mirror[term])
        assert row.score_ab == pytest.approx(mirror.score_ba)
        assert row.score_ab == pytest.approx(brute_score(by_id[i], by_id[j]))


def test_structural_report(spark, tmp_path):
    markup = ["<button title='add to bag'><p>"] * 3 + ["<h1>Your bag</h1><p>"] * 2 + ["<p>"]
    report = structural.analyse(pages(spark, *markup))
    assert {r.page_type: r.pages for r in report.distribution.collect()} == {"product": 3, "cart": 2, "other": 1}
    within = {r.page_type: r.page_pairs for r in report.within_types.collect()}
    assert within == {"product": 3, "cart": 1}
    doc = report.summary.first()
    assert doc.total_files == 6 and doc.page_type_distribution["product"] == 3
    assert len(doc.structural_features_sample) == 3
    structural.save(report, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/page_types")).count() == 6


def test_spread_and_first_of_types(spark):
    pairs = spark.createDataFrame(
        [("t", 1, 2, 3, 0.5, 0.5), ("t", 1, 3, 1, 0.9, 0.7), ("u", 4, 5, 1, 0.1, 0.1)],
        "page_type string, a int, b int, page_pairs bigint, score_ab double, score_ba double",
    )
    by_type = spark.createDataFrame([(1, "t", 3), (2, "t", 2), (4, "u", 2)], "sig int, page_type string, pages bigint")
    spread = summary.within_type_spread(pairs, by_type).collect()
    assert [r.pairs_possible for r in spread] == [10, 1]
    values = np.array([0.5] * 6 + [0.9, 0.7])
    assert [r.page_type for r in spread] == ["t", "u"]
    assert (spread[0].q1, spread[0].median, spread[0].q3) == tuple(np.percentile(values, [25, 50, 75]))
    assert spread[0].scores == 8
    typed = spark.createDataFrame(
        [(5, "product"), (2, "product"), (9, "cart"), (7, "cart")], "page_id int, page_type string"
    )
    assert tuple(summary.first_of_types(typed).first()) == (2, 7)
    assert summary.first_of_types(typed.where(F.col("page_id") != 5)).count() == 0
