"""ZIP packages of WARC records: exact round trips."""

import brute
import pytest

from pagelens.llm import archives
from pagelens.llm.queries import LLM_QUERIES
from pagelens.session import scratch_path

PAGES = "page_id bigint, url string, html string, revisit string, refers_to string"


def fetch_of(data):
    return lambda offset, length: data[offset : offset + length]


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_and_index_of_a_package(zip64):
    records = [(f"r{i}", bytes([65 + i]) * (i * 1000)) for i in range(5)]
    data = archives.package(records, force_zip64=zip64) + b"\n"
    found = archives.index(len(data), fetch_of(data))
    assert [(n, data[a : a + z]) for n, a, z in found] == records


def test_zip64_end_records(monkeypatch):
    import zipfile

    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    records = [("a", b"x" * 500), ("b", b"y" * 700)]
    data = archives.package(records, force_zip64=True) + b"\n"
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    found = archives.index(len(data), fetch_of(data))
    assert [(n, data[a : a + z]) for n, a, z in found] == records


def test_only_ranges_are_read():
    records = [(f"r{i}", b"z" * 100_000) for i in range(20)]
    data, read = archives.package(records) + b"\n", []

    def fetch(offset, length):
        read.append(length)
        return data[offset : offset + length]

    archives.index(len(data), fetch)
    assert sum(read) < 70_000 < len(data)


def test_broken_packages_are_refused():
    data = archives.package([("a", b"x")]) + b"\n"
    with pytest.raises(ValueError):
        archives.directory(30, fetch_of(data[:30]))


def test_changed_payload_is_noticed():
    record = archives.record(1, "u", b"payload", None, False)
    assert archives.parse(record)["payload"] == b"payload"
    assert archives.digest(archives.parse(record.replace(b"payload\r\n", b"pAyload\r\n"))["payload"]) != archives.digest(b"payload")


def test_given_pages(spark):
    rows = LLM_QUERIES["op6_zip_archives"](spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    assert {r.page_id: tuple(r)[1:] for r in rows} == brute.archive_rows([tuple(p) for p in pages])


def test_edge_pages(spark, monkeypatch):
    monkeypatch.setattr(archives, "PACKAGE_BYTES", 2_000)
    html = [None, "", "<p>same</p>", "x" * 300_000, "<p>same</p>", "\r\n\r\nWARC/1.1\r\n", "PK\x05\x06 é😀\n", "<p>same</p>", "\x00\x01"]
    rows = [(i, None if i == 3 else f"http://h/{i} x\ny", h, "r", "t") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, PAGES)
    got = archives.round_trip(pages).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute.archive_rows(
        [(i, h) for i, _, h, *_ in rows]
    )
    path = scratch_path(spark, "packages")
    archives.write_packages(archives.decide(pages), path)
    found = archives.read(archives.records(spark, path)).collect()
    assert {r.page_id: r.html for r in found if r.record_type == "response"} == {
        i: h or "" for i, _, h, *_ in rows if i not in (0, 2, 4)
    }


def test_short_payloads_are_not_revisits(spark):
    rows = [(1, None, "a", "", ""), (2, None, "a", "", ""), (3, None, "abc", "", ""), (4, None, "abc", "", "")]
    pages = spark.createDataFrame(rows, PAGES)
    assert {r.page_id for r in archives.decide(pages, min_bytes=2).collect() if r.revisit} == {3}


def test_no_pages(spark):
    assert archives.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_null_and_repeated_page_ids(spark):
    rows = [(None, "u", "a", "", ""), (1, "u", "a", "", ""), (1, "u", "a", "", ""), (2, None, "b", "", "")]
    got = archives.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [
        (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0),
    ]


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_ids_that_share_payloads(spark, monkeypatch, broadcast):
    if not broadcast:  # the way taken when many pages are copies
        monkeypatch.setattr(archives, "small_side", lambda df, name: archives.written(df, name))
    pairs = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "zzz"), (4, "b"), (None, "a"), (None, "a"), (None, "own")]
    pages = spark.createDataFrame([(i, "u", h, "", "") for i, h in pairs], PAGES)
    decided = archives.decide(pages).select("page_id", "html", "revisit", "refers_to").collect()
    assert sorted(map(str, map(tuple, decided))) == sorted(map(str, [
        (1, "a", True, 2), (1, "a", True, 2), (2, "a", False, None), (3, "b", True, 4), (3, "zzz", False, None),
        (4, "b", False, None), (None, "a", True, 2), (None, "a", True, 2), (None, "own", False, None),
    ]))
    got = archives.round_trip(pages).collect()
    assert len(got) == len(pairs)
    assert sum(r.record_type == "response" for r in got) == 4
