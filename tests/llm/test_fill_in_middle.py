"""Fill-in-the-middle outputs against a plain version, and back to the text."""

import hashlib
import re

import edge
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.llm import fill_in_middle
from pagelens.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
SPECIAL = ["a\nb", "\n", "\n\n", "no end", "end\n", "a<P>b\nc", "<S>", "x\n<M>\n", "<\nP>\nS>", "ünï😀\n\r\nx y", "<P\n><"]


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def digested(row, text):
    *rest, output = row
    return (*rest, *(hashlib.sha256(x.encode()).hexdigest() for x in (output, text or "")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("a\n<PSM>é😀", max_size=12), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm", "plain"])), min_size=1, max_size=8))
def test_batches(rows):
    texts, first, second, forms = zip(*rows, strict=True)
    made = fill_in_middle.rewrite(
        pa.array(texts, pa.large_string()), np.array(first), np.array(second), pa.array(forms)
    )
    for i, (text, one, other, form) in enumerate(rows):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted((one % (len(units) + 1), other % (len(units) + 1)))
        pieces = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
        if not text or re.search("<[PSM]>", text):
            form = "plain"
        outputs = {
            "plain": text,
            "psm": f"<P>{pieces[0]}<S>{pieces[2]}<M>{pieces[1]}",
            "spm": f"<S>{pieces[2]}<P>{pieces[0]}<M>{pieces[1]}",
        }
        assert made["form"][i].as_py() == form
        assert made["output"][i].as_py() == outputs[form]
        assert made["n_units"][i].as_py() == len(units)
        lengths = (None, None) if form == "plain" else (len(pieces[0]), len(pieces[1]))
        assert (made["prefix_chars"][i].as_py(), made["middle_chars"][i].as_py()) == lengths


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = LLM_QUERIES["op12_fill_in_middle"](spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(digested(expected(*r), r.text) for r in docs)
    assert {r.form for r in rows} >= {"psm", "spm"}


@pytest.mark.parametrize("name", ["edge", "empty", "special"])
def test_query_on_edge_tables(spark, tmp_path, name):
    made = {
        "edge": edge.docs,
        "empty": edge.empty,
        "special": lambda s: s.createDataFrame(
            [(i, t) for i in range(40) for t in SPECIAL] + [(None, t) for t in SPECIAL], "doc_id long, text string"
        ),
    }
    df = made[name](spark)
    folder = edge.save(spark, tmp_path, df)
    rows = LLM_QUERIES["op12_fill_in_middle"](spark, folder).collect()
    want = [digested(expected(r.doc_id, r.text), r.text) for r in df.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_shares_of_forms_and_roundtrip(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"), F.lit(1).alias("form"))
    made = fill_in_middle.transform(docs, "salt:", percent=40, spm_percent=25)
    back = made.withColumn("text", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert back.where("text <> 'a\nb\nc'").isEmpty()
    shares = {r.form: r["count"] for r in made.groupBy("form").count().collect()}
    assert abs(shares["plain"] - 2_400) < 150 and abs(shares["spm"] - 400) < 80
