"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP archive with stored members: archive/data.warc.gz, whose records stand
one after another, each compressed by itself, and indexes/index.cdxj, one line per record
with its offset and length in that member. The reader fetches the end of a package, follows the (ZIP64) end records to
the central directory, locates the members through their local headers, reads the index,
and then fetches single records by range.

Packages are written by Spark's own text writer, one file per row, so they reach whatever
store the folder lies in, and a lost task leaves nothing behind; the line end the writer
adds is declared as the ZIP comment.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import small_batches
from pagelens.session import scratch_path, small_side, written

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 16 << 20  # a package is closed when its records exceed this
MIN_BYTES = 0  # shorter payloads are never written as revisits
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:pagelens:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


# -- writing -----------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: the response with its payload, or a revisit with its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A record as a gzip member of its own, the same bytes at every run."""
    return gzip.compress(data, compresslevel=3, mtime=0)


def package(records: list[tuple[str, bytes]], force_zip64: bool = False) -> bytes:
    """A package of (record id, record) pairs, without the last byte: the line end that the
    writer adds is its comment."""
    lines, at = [], 0
    for name, data in records:
        lines.append(json.dumps({"id": name, "offset": at, "length": len(data)}))
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for member, parts in (
            (WARC_MEMBER, [data for _, data in records]),
            (INDEX_MEMBER, ["\n".join(lines).encode()]),
        ):
            info = zipfile.ZipInfo(member)
            with archive.open(info, "w", force_zip64=force_zip64) as to:
                for part in parts:
                    to.write(part)
        archive.comment = b"\n"
    return out.getvalue()[:-1]


def _package_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records, size = [], 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([package(records)], pa.binary())], ["value"])

    for batch in batches:
        ids, targets = batch.column("page_id").to_pylist(), batch.column("refers_to").to_pylist()
        urls, revisits = batch.column("url").to_pylist(), batch.column("revisit").to_pylist()
        for i, html in enumerate(batch.column("html")):
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            data = packed(record(ids[i], urls[i], payload, targets[i], revisits[i]))
            records.append((record_id(ids[i]), data))
            size += len(data)
            if size >= PACKAGE_BYTES:
                yield closed()
                records, size = [], 0
    if records:
        yield closed()


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): of records with equal payloads of at least
    `min_bytes` the one of the largest page_id is the response. Payloads are equal if their
    SHA-256 is. Each row is one record: rows repeated under one page_id are alike, and rows of
    one page_id with different payloads are judged by their own payload (a revisit is then known
    by page_id and digest together). Null ids have no order and are never the response that
    others revisit. Columns other than the three are left out, whatever their names."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    marks = rows.select(
        "page_id", F.sha2(body, 256).alias("mark"), F.octet_length(body).alias("size")
    ).filter(F.col("size") >= min_bytes)
    last = marks.groupBy("mark").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = last.filter("n > 1").select("mark", "last")
    revisits = (
        marks.join(shared, "mark")
        .filter(~F.col("page_id").eqNullSafe(F.col("last")))
        .select(F.col("page_id").alias("__id"), "mark", F.col("last").alias("refers_to"))
        .distinct()
    )
    revisits = small_side(revisits, "revisits")  # few as a rule: then no markup is moved
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha2(body, 256) == F.col("mark"))
    found = rows.join(revisits, same, "left")
    return found.select(
        "page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit")
    )


def write_packages(pages: DataFrame, path: str) -> None:
    """Write the decided rows of pages as packages under `path`."""
    small_batches(pages.sparkSession)
    packages = pages.mapInArrow(_package_batches, "value binary")
    packages.select(F.col("value").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)


# -- reading -----------------------------------------------------------------------

Fetch = Callable[[int, int], bytes]  # (offset, length) -> bytes


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def directory(size: int, fetch: Fetch) -> list[Member]:
    """Members by the central directory of a package of `size` bytes."""
    tail_at = max(0, size - 65_557)
    tail = fetch(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:  # the signature may also occur within the comment
        if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF or (
        tail_at + at >= 20 and fetch(tail_at + at - 20, 4) == b"PK\x06\x07"
    ):
        locator = fetch(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = fetch(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    data, members, at = fetch(start, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, full = struct.unpack_from("<II", data, at + 20)
        name_len, extra_len, comment_len = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + name_len].decode("utf-8", "replace")
        extra = data[at + 46 + name_len : at + 46 + name_len + extra_len]
        size_, header = _zip64(extra, full, packed, header)
        members.append(Member(name, method, size_, header))
        at += 46 + name_len + extra_len + comment_len
    return members


def _zip64(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int]:
    """Size and header offset with the values of the ZIP64 extra field put in; it holds
    those that do not fit their 32 bits, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = [struct.unpack_from("<Q", extra, at + 4 + 8 * i)[0] for i in range(length // 8)]
            full, packed, header = [
                values.pop(0) if v == 0xFFFFFFFF and values else v for v in (full, packed, header)
            ]
        at += 4 + length
    return full, header


def data_offset(member: Member, fetch: Fetch) -> int:
    """Where a stored member's bytes begin, by its local header."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed")
    local = fetch(member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    name_len, extra_len = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_len + extra_len


def index(size: int, fetch: Fetch) -> list[tuple[str, int, int]]:
    """(record id, offset in the package, length) of each record a package lists."""
    members = {m.name: m for m in directory(size, fetch)}
    base = data_offset(members[WARC_MEMBER], fetch)
    listing = members[INDEX_MEMBER]
    lines = fetch(data_offset(listing, fetch), listing.size).decode().splitlines()
    entries = [json.loads(line) for line in lines if line]
    return [(e["id"], base + e["offset"], e["length"]) for e in entries]


def parse(data: bytes) -> dict:
    """Fields and payload of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
    fields["http-length"] = declared["Content-Length"]
    return fields | {"payload": payload}


def opened(uri: str):
    """A file of any store pyarrow knows, for reads by range."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def fetcher(file) -> Fetch:
    def fetch(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return fetch


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            with opened(uri) as file:
                found = index(size, fetcher(file))
            rows = [[uri] * len(found), [n for n, _, _ in found], [a for _, a, _ in found], [z for _, _, z in found]]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array(r, t) for r, t in zip(rows, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "record", "offset", "length"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, offset, length) of every record of the packages under `path`. Only
    their ends, headers and indexes are read; the listing is Spark's."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(_index_batches, "path string, record string, offset long, length long")


FIELDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, html string"
)


def _read_batches(batches: Iterator[pa.RecordBatch], with_html: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    file, at = None, None
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for uri, offset, length in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")], strict=True):
            if uri != at:
                if file:
                    file.close()
                file, at = opened(uri), uri
            got = parse(gzip.decompress(fetcher(file)(offset, length)))
            kind = got["WARC-Type"]
            stated = got["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and digest(got["payload"]) != stated:
                raise ValueError(f"{uri}: payload of {got['WARC-Record-ID']} differs from its digest")
            size = int(got["http-length"]) if kind == "revisit" else len(got["payload"])
            html = got["payload"].decode("utf-8", "surrogatepass") if with_html and kind == "response" else None
            refers = page_of(got["WARC-Refers-To"]) if kind == "revisit" else None
            values = (page_of(got["WARC-Record-ID"]), got.get("WARC-Target-URI"), size, stated, kind, refers, html)
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)
    if file:
        file.close()


def read(listed: DataFrame, with_html: bool = True) -> DataFrame:
    """The listed records, each fetched by its range; payloads of responses are held
    against their digest. A revisit has no html of its own."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_batches(rows, with_html)

    return listed.mapInArrow(batches, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all rows of (page_id, url, html) as packages and read the records back.

    Null html is an empty payload, null url an empty target. An empty table gives an empty
    result. Equal texts under one page_id are one page repeated: each row is a response."""
    path = scratch_path(pages.sparkSession, "packages")
    write_packages(decide(pages), path)
    return read(written(records(pages.sparkSession, path), "records"), with_html=False)
