"""Registered queries against their SQL on the smallest tables.

All of them run with PAGELENS_ALL=1 (or through check.py); otherwise one of each kind.
"""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from check import TABLES, canonical
from pagelens.operators.structure import SIGNATURE_FIELDS
from pagelens.registry import inputs

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()
USUAL = [
    "page_elements", "visible_text", "page_feature_vectors", "interactive_elements", "page_type_labels",
    "depth_statistics", "similar_tag_counts", "similar_vectors", "nearest_neighbours", "standard_vectors",
    "feature_profile", "request_log", "changed_pages", "cache_upsert", "streamed_page_intake",
]
NAMES = sorted(ORACLES) if os.environ.get("PAGELENS_ALL") else USUAL


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    found = db.sql(ORACLES[name])
    want = pd.DataFrame(found.fetchall(), columns=found.columns)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())


def test_structures_are_parsed_without_page_texts(spark):
    parsed = inputs.dressed(spark, FOLDER, SIGNATURE_FIELDS)
    assert parsed.where("size(elements) > 0 and page_text is null").count() == parsed.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
