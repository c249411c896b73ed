"""Quality and toxicity: held-out accuracy, folding, exceptions, odd rows."""

import random
import time
import zlib

import edge
import numpy as np
import pytest

from pagelens.llm import nbsvm, toxicity
from pagelens.llm.queries import LLM_QUERIES

WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ren", "sta", "mol", "vix") for c in ("e", "o", "an", "us")]


def corpus(n=600, seed=1):
    """Documents a third of which are junk, a quarter toxic."""
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = draw.choices(WORDS, k=draw.randint(15, 120))
        bad, toxic = draw.random() < 0.33, draw.random() < 0.25
        if bad:
            words = [w + draw.choice(["$$$", "%%%", "###"]) for w in words] if i % 2 else [words[0]] * len(words)
        if toxic:
            for _ in range(draw.randint(1, 3)):
                words.insert(draw.randrange(len(words)), draw.choice(["glorp", "Gl0rp", "snarkelig", "snarkeluv", "ѕnаrkelop"]))
        elif draw.random() < 0.03:
            at = draw.randrange(len(words))
            words[at:at] = ["glorp", "museum"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = corpus()
    folder = tmp_path_factory.mktemp("labelled")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("name,column,limit,least", [("op4_quality_nbsvm", 0, 0.7, 0.95), ("op10_toxicity", 1, 0.3, 0.95)])
def test_held_out_accuracy(spark, tables, name, column, limit, least):
    folder, labels = tables
    rows = LLM_QUERIES[name](spark, folder).collect()
    assert len(rows) == len(labels)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= limit) for r in rows)
    right = [r.predicted == labels[r.doc_id][column] for r in rows if r.held_out]
    assert np.mean(right) >= least


def test_held_out_labels_are_not_learnt(spark, tables):
    folder, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    flipped = [(i, 1 - q if held_out(i) else q, 1 - t if held_out(i) else t) for i, (q, t) in labels.items()]
    other = spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")
    own = spark.read.parquet(f"{folder}/labels.parquet")
    a, b = nbsvm.train(docs, own, "quality"), nbsvm.train(docs, other, "quality")
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert toxicity.train(docs, own) == toxicity.train(docs, other)


def test_folding():
    assert toxicity.fold("Gl0rp, ɡlоrр! ＧＬＯＲＰ g10rp$ 5narkel 45 3.2") == " glorp glorp glorp giorp snarkel "
    assert toxicity.fold(None) == "" and toxicity.fold(" 12 !!") == ""
    assert toxicity.fold("été Ñandú") == " été ñandú "


def test_exceptions_spare_a_term():
    matcher = toxicity.Matcher({" glorp ": 2.0, " glo": 1.0}, [" glorp museum "])
    assert matcher.words(toxicity.fold("a glorp b")) == {2: 2.0}
    assert matcher.words(toxicity.fold("a glorp museum b")) == {}
    assert len(matcher.words(toxicity.fold("glorp glorp"))) == 2
    assert toxicity.Matcher({}, []).words(" a ") == {}


def test_learnt_exceptions(spark, tables):
    folder, _ = tables
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    weights, spared, _ = toxicity.train(docs, labels)
    assert any(t.startswith(" snark") for t in weights)
    assert all(p.count(" ") == 3 for p in spared)


def test_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 40, 8)).astype(np.uint32) for _ in range(200)]
    y = np.array([int(3 in r or 5 in r) for r in rows])
    r = nbsvm.ratios(rows, y)
    w, bias = nbsvm.descend(rows, y, r)
    assert np.mean([(nbsvm.margin(x, r, w, bias) > 0) == (t == 1) for x, t in zip(rows, y, strict=True)]) > 0.95


def test_places_of_very_long_texts_are_those_of_their_parts():
    part = "ab cd "
    assert nbsvm.places(part * 400_000).tolist() == nbsvm.places(part * 20).tolist()
    assert len(nbsvm.places("")) == 0 == len(nbsvm.places(None))


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0), (8, None, None), (9, 0, 1), (9, 0, 1), (None, 1, 1)]])
def test_odd_rows_and_few_labels(spark, labels):
    docs = edge.docs(spark)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for scored in (
        nbsvm.scored(docs, nbsvm.train(docs, known, "quality")),
        toxicity.scored(docs, toxicity.train(docs, known)),
    ):
        rows = scored.collect()
        assert len(rows) == len(edge.rows()) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) <= 2


def test_no_documents(spark):
    none = edge.empty(spark)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert nbsvm.scored(none, nbsvm.train(none, labels, "quality")).collect() == []
    assert toxicity.scored(none, toxicity.train(none, labels)).collect() == []


def test_rare_terms_count_where_they_are_sure(spark):
    """A term of 12 among 3,000 toxic texts (0.4 %) and of no harmless one is in the lexicon,
    one as frequent in harmless texts is not."""
    rows = [(i, f"plain words {i} " + ("grumph " if i < 12 else "") + ("both " if i % 250 == 0 else ""), 1) for i in range(3_000)]
    rows += [(i, f"plain words {i} " + ("both " if i % 250 == 0 else ""), 0) for i in range(3_000, 9_000)]
    weights = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert " grumph " in weights and " both " not in weights and " plain " not in weights


def test_many_terms_and_exceptions_in_one_text():
    matcher = toxicity.Matcher({" glorp ": 2.0}, [" glorp museum ", " the glorp "])
    folded = toxicity.fold("glorp museum the glorp glorp x " * 20_000)
    start = time.process_time()
    found = matcher.words(folded)
    assert len(found) == 20_000 and time.process_time() - start < 5
