"""The corpus pipeline, stage by stage, against plain versions of each."""

from collections import Counter, defaultdict

import brute
import edge
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from pagelens.session import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["given", "edge"])
def results(request, spark, tmp_path_factory):
    folder = FOLDER if request.param == "given" else edge.save(spark, tmp_path_factory.mktemp("p"), edge.docs(spark))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], folder), name))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns(results):
    assert all(df.columns == results[0].columns for df in results[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5


def test_quality_stage_keeps_clean_documents(results):
    before, after = Counter(rows(results[0])), Counter(rows(results[1]))
    assert not after - before
    assert all(brute.rules(r[1])[-1] for r in before - after)


def test_one_document_of_each_group_stays(results):
    before, after = rows(results[1]), rows(results[2])
    prints = {r[0]: brute.simhash(r[1]) for r in before if r[0] is not None}
    group = brute.near_components(prints)
    assert sorted(r[0] for r in after if r[0] is not None) == sorted(set(group.values()))
    assert set(after) <= set(before)


def test_personal_data_is_gone(results):
    before, after = rows(results[2]), rows(results[3])
    assert len(before) == len(after)
    assert not any(brute.personal(r[1])[5] for r in after)
    same = {r[0]: r for r in after}
    for r in before:
        if r[0] is not None and not any(c.isdigit() or c in "@=" for c in r[1] or ""):
            assert same[r[0]] == r


def test_mix_repeats_whole_documents(results):
    before, after = Counter(rows(results[3])), Counter(rows(results[4]))
    assert set(after) <= set(before)
    assert all(n <= 2 * before[r] for r, n in after.items())
    sizes, taken = defaultdict(int), defaultdict(int)
    for counter, total in ((before, sizes), (after, taken)):
        for r, n in counter.items():
            total[r[3]] += n * len(brute.WORD.findall(r[1] or ""))
    want, largest = brute.mix_targets(sizes), max(len(brute.WORD.findall(r[1] or "")) for r in before)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)


def test_packing_holds_every_token(results):
    pieces = results[5].collect()
    docs = Counter(r[0] for r in rows(results[4]))
    starts = Counter(p.doc_id for p in pieces if p.start == 0)
    assert starts == docs
    assert all(len(p.ids) == 4 * p.length for p in pieces)
    fill = defaultdict(int)
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 2048


def test_registered_and_runs(spark):
    assert entry_points.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_empty_table(spark, tmp_path):
    folder = edge.save(spark, tmp_path, edge.empty(spark))
    assert corpus_pipeline.run(spark, folder).collect() == []
