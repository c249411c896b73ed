import hashlib
import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import pages
from pagelens.operators import embed, weblog
from pagelens.operators.dom import parse_pages
from pagelens.operators.incremental import cache_schema
from pagelens.plans import interactive, semantic, site_report
from pagelens.registry import queries
from pagelens.sources import cache, folders, results
from pagelens.streaming import intake
from pagelens.streaming import requests as request_streams


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


SAMPLES = {
    "home.html": "<html><body><h1>Welcome here</h1><p>General information about a site.</p>"
    "<nav><a href='a.html'>About</a></nav></body></html>",
    "about.html": "<html><body><h1>About</h1><p>Who we are.</p><p>What we make.</p></body></html>",
    "contact.html": "<html><body><h1>Contact us</h1><p>Phone: 555</p></body></html>",
    "products.html": "<html><body><h2>First thing</h2><p>x</p><h2>Second thing</h2></body></html>",
    "blog.html": "<html><body><article><h2>One</h2></article><article><h2>Two</h2></article></body></html>",
}


def test_strict_folder(spark, tmp_path):
    for name, markup in SAMPLES.items():
        write(tmp_path / name, markup + "\r\nend\r")
    write(tmp_path / "note.txt", "x")
    write(tmp_path / "deep/inner.html", "x")
    found = {r.page_id: r.html for r in folders.html_folder(spark, str(tmp_path)).collect()}
    assert found.keys() == SAMPLES.keys()
    assert found["home.html"] == SAMPLES["home.html"] + "\nend\n"
    write(tmp_path / "bad.html", b"<p>\xff</p>")
    with pytest.raises(PySparkException):
        folders.html_folder(spark, str(tmp_path)).collect()


def test_lenient_folder(spark, tmp_path):
    write(tmp_path / "a.html", b"<p>one\xff\r\ntwo</p>")
    write(tmp_path / "b.htm", "<p>three  four</p>")
    write(tmp_path / "blank.html", "<script>x</script> <p> </p>")
    write(tmp_path / "odd.html", "<![foo bar")
    found = {r.page_id: r for r in folders.html_folder_lenient(spark, str(tmp_path)).collect()}
    assert {k: v.text for k, v in found.items()} == {
        "a.html": "one two", "b.htm": "three four", "odd.html": "<![foo bar",
    }
    assert found["b.htm"].content_hash == hashlib.md5(b"three four").hexdigest()
    assert folders.html_folder_lenient(spark, str(tmp_path / "missing")).count() == 0


@pytest.fixture
def crawl(tmp_path):
    write(tmp_path / "https___a.b__x/page.html", "<button>P</button>")
    write(tmp_path / "https___a.b__x/crawled.html", "<a>C</a>")
    write(tmp_path / "https___a.b__x/2.png", b"1")
    write(tmp_path / "https___a.b__x/1.png", b"1")
    write(tmp_path / "p2/crawled.html", "<a href='/q'>C</a>")
    write(tmp_path / "p2/final_page.html", "<a>F</a>")
    write(tmp_path / "p3/other.html", "<a>O</a>")
    write(tmp_path / "p4/shot.png", b"1")
    write(tmp_path / "p5/readme.txt", "x")
    write(tmp_path / "embeddings_analysis/page.html", "x")
    return tmp_path


def names(rows):
    return {r.page_id: r.path.rsplit("/", 1)[-1] for r in rows.collect()}


def test_crawl_tree(spark, crawl):
    files = folders.crawl_files(spark, str(crawl))
    found = {r.page_id: (len(r.html_files), len(r.screenshots)) for r in folders.discover_pages(files).collect()}
    assert found == {"https___a.b__x": (2, 2), "p2": (2, 0), "p3": (1, 0), "p4": (0, 1)}
    assert names(folders.primary_html(files)) == {"https___a.b__x": "page.html", "p2": "crawled.html"}
    assert names(folders.primary_html_or_first(files)) == {
        "https___a.b__x": "page.html", "p2": "crawled.html", "p3": "other.html",
    }
    assert names(folders.primary_screenshot(files)) == {"https___a.b__x": "1.png", "p4": "shot.png"}


def test_interactables_of_a_crawl(spark, crawl, tmp_path):
    found = interactive.extract_crawl(spark, str(crawl), str(tmp_path / "out"))
    rows = {r.page_id: r.interactables for r in found.collect()}
    assert {k: [e.tag for e in v] for k, v in rows.items()} == {"https___a.b__x": ["button"], "p2": ["a"]}
    assert rows["p2"][0].attributes["href"] == "/q" and rows["p2"][0].text == "C"


def test_cache_snapshots(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert cache.load_cache(spark, root).count() == 0
    first = spark.createDataFrame([(1, "m", "h", [1.0])], cache_schema())
    assert cache.save_cache(first, root) == 1
    second = cache.load_cache(spark, root).unionByName(
        spark.createDataFrame([(2, "m", "h", [2.0])], cache_schema())
    )
    assert cache.save_cache(second, root) == 2
    assert sorted(r.page_id for r in cache.load_cache(spark, root).collect()) == [1, 2]


def test_cache_deltas(spark, tmp_path):
    root = str(tmp_path / "cache")

    def rows(*entries):
        return spark.createDataFrame(list(entries), cache_schema())

    def held():
        return {r.page_id: (r.content_hash, r.embedding) for r in cache.load_cache(spark, root).collect()}

    cache.append_cache(rows((1, "m", "a", [1.0]), (2, "m", "b", None)), root)
    assert held() == {1: ("a", [1.0])}
    cache.append_cache(rows((1, "m", "c", [3.0]), (2, "m", "b", [2.0])), root)
    assert held() == {1: ("c", [3.0]), 2: ("b", [2.0])}
    assert cache.append_cache(rows((3, "m", "d", [4.0])), root) == 3
    assert cache.append_cache(rows(), root) == 3
    assert held() == {1: ("c", [3.0]), 2: ("b", [2.0]), 3: ("d", [4.0])}
    assert [tuple(r)[:3] for r in cache.load_errors(spark, root).collect()] == [(2, "m", "b")]
    assert cache.compact_cache(spark, root) == 4
    assert held() == {1: ("c", [3.0]), 2: ("b", [2.0]), 3: ("d", [4.0])}
    assert cache.load_errors(spark, root).count() == 0
    names = {p.name for p in (tmp_path / "cache").iterdir()}
    assert {n for n in names if n.startswith("pointer")} == {"pointer-0", "pointer-1"}


def test_a_cut_short_pointer_leaves_the_state_before(spark, tmp_path):
    root = str(tmp_path / "cache")
    for n in (1, 2):
        cache.append_cache(spark.createDataFrame([(n, "m", "h", [1.0])], cache_schema()), root)
    for part in (tmp_path / "cache/pointer-0").glob("part-*"):
        part.unlink()
    assert cache.current_version(spark, root) == 1
    assert [r.page_id for r in cache.load_cache(spark, root).collect()] == [1]


def test_documents(spark, tmp_path):
    path = tmp_path / "visual.json"
    path.write_text(json.dumps({"files_analyzed": ["a", "b"], "summary": {"total_files": 2}}, indent=2))
    schema = "files_analyzed array<string>, summary struct<total_files bigint>"
    assert results.read_document(spark, str(path), schema).first().summary.total_files == 2
    assert results.read_result(spark, str(tmp_path / "none"), schema, required=False) is None
    with pytest.raises(PySparkException):
        results.read_result(spark, str(tmp_path / "none"), schema)


def request(url, method, at, cookie="a=1"):
    return (url, method, {"cookie": cookie}, cookie, datetime(2024, 1, 1, 0, at))


REQUEST_ROW = "url string, method string, headers map<string,string>, cookie string, ts timestamp"


def test_request_log(spark, tmp_path):
    rows = [
        request("https://x/api/a?q=1", "GET", 1), request("https://x/api/a?q=1", "POST", 2, "b=2; b=3"),
        request("https://x/plain", "GET", 3),
    ]
    calls = weblog.api_requests(spark.createDataFrame(rows, REQUEST_ROW))
    path = str(tmp_path / "log")
    results.write_requests(calls.where("method = 'POST'"), path)
    results.write_requests(calls.where("method = 'GET'"), path)
    found = results.read_requests(spark, path).collect()
    assert len(found) == 1
    assert (found[0].method, found[0].path, found[0].query, found[0].cookies) == ("POST", "/api/a", "q=1", {"b": "3"})
    assert weblog.seen_urls(spark.createDataFrame(rows, REQUEST_ROW)).count() == 2


def test_assets_console_and_scripts(spark):
    assets = spark.createDataFrame(
        [
            ("https://x/a.js", "text/javascript", "first", 1), ("https://x/a.js", "text/javascript", "second", 2),
            ("https://x/js/b", "application/json", "kept", 1), ("https://x/c.js", "text/html", "no", 1),
            ("https://x/d.js", "text/javascript", "", 1), ("https://x/d.css", "text/javascript", "no", 1),
        ],
        "url string, content_type string, body string, ts int",
    )
    assert sorted(r.body for r in weblog.script_assets(assets).collect()) == ["first", "kept"]
    console = spark.createDataFrame(
        [("x DECRYPT_LOG:p1",), ("DECRYPT_LOG:p1",), ("fetch(1)",), ("XMLHttpRequest",), ("none",)], "message string"
    )
    assert [r.payload for r in weblog.console_payloads(console).collect()] == ["p1"]
    assert weblog.console_network_calls(console).count() == 2
    # Two pairs of texts whose short hashes are equal.
    texts = ["fetch(/api/32895)", "fetch(/api/55288)", "DECRYPT_LOG:p194560", "DECRYPT_LOG:p206842"]
    alike = spark.createDataFrame([(t,) for t in texts * 2], "message string")
    calls = weblog.console_network_calls(alike).collect()
    assert sorted(tuple(r) for r in calls) == [("bb702231", t) for t in texts[:2]]
    payloads = weblog.console_payloads(alike).collect()
    assert sorted(tuple(r) for r in payloads) == [("7c5294b8", "p194560"), ("7c5294b8", "p206842")]
    scripts = spark.createDataFrame(
        [("b", "token"), ("a", "token"), ("c", "fetch( token Bearer x"), ("d", "zzz")], "name string, body string"
    )
    assert [tuple(r) for r in weblog.api_scripts(scripts, "name", "body").collect()] == [
        ("c", 3), ("a", 1), ("b", 1),
    ]


def test_last_cookies(spark):
    rows = spark.createDataFrame(
        [("https://x/1", 200, "s", "old", 1), ("https://x/2", 200, "s", "new", 2), ("https://x/3", 500, "s", "bad", 3),
         ("https://y/1", 200, "s", "alien", 4)],
        "url string, status int, name string, value string, ts int",
    )
    assert [r.value for r in weblog.last_cookies(rows, "//x/").collect()] == ["new"]


PAGE_SCHEMA = "page_id bigint, html string"


def test_page_intake_stream(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "cache")
    seen = []

    def counting(batch):
        return embed.hashed_words(4)(batch)

    def run():
        stream = intake.page_stream(spark, str(folder), PAGE_SCHEMA, files_per_trigger=1)
        query = intake.start_intake(stream, root, counting, each=lambda df, n: seen.append(df.count()))
        query.awaitTermination()
        return {r.page_id: r.content_hash for r in cache.load_cache(spark, root).collect()}

    pages(spark, "<p>a</p>", "<p>b</p>").coalesce(1).write.parquet(f"{folder}/1")
    pages(spark, "<p>a</p>", "<p>b</p>").coalesce(1).write.mode("append").parquet(str(folder))
    first = run()
    assert first.keys() == {1, 2}
    version = cache.current_version(spark, root)
    # The same pages again: nothing to embed, so no new snapshot.
    pages(spark, "<p>a</p>", "<p>b</p>").coalesce(1).write.mode("append").parquet(str(folder))
    assert run() == first and cache.current_version(spark, root) == version
    pages(spark, "<p>changed</p>").coalesce(1).write.mode("append").parquet(str(folder))
    changed = run()
    assert changed[1] != first[1] and changed[2] == first[2]
    assert len(seen) >= 3


def test_failed_page_is_tried_again(spark, tmp_path):
    root = str(tmp_path / "cache")
    batch = pages(spark, "<p>good</p>", "<p>bad</p>")

    def failing(texts):
        if "bad" in texts:
            raise RuntimeError("rate limit")
        return [[1.0] for _ in texts]

    intake.embed_batch(batch, root, failing, "m")
    assert [r.page_id for r in cache.load_cache(spark, root).collect()] == [1]
    intake.embed_batch(batch, root, lambda texts: [[2.0] for _ in texts], "m")
    found = {r.page_id: r.embedding for r in cache.load_cache(spark, root).collect()}
    assert found == {1: [1.0], 2: [2.0]}


def test_the_last_version_of_a_page_counts(spark, tmp_path):
    """In either order, so that one of them has the smaller hash last."""
    for n, texts in enumerate((("first", "second"), ("second", "first"))):
        root = str(tmp_path / f"cache{n}")
        batch = spark.createDataFrame(
            [(1, f"<p>{texts[0]}</p>", 10), (1, f"<p>{texts[1]}</p>", 20)], "page_id bigint, html string, version int"
        )
        intake.embed_batch(batch, root, embed.hashed_words(4), "m")
        (row,) = cache.load_cache(spark, root).collect()
        assert row.content_hash == hashlib.md5(texts[1].encode()).hexdigest()


def test_errors_are_kept(spark, tmp_path):
    root = str(tmp_path / "cache")

    def refuse(texts):
        raise RuntimeError("rate limit")

    intake.embed_batch(pages(spark, "<p>a</p>"), root, refuse, "m")
    (row,) = cache.load_errors(spark, root).collect()
    assert (row.page_id, row.error) == (1, "rate limit")


def test_throttled_trigger(spark, tmp_path):
    folder = tmp_path / "in"
    pages(spark, "<p>a</p>").coalesce(1).write.parquet(str(folder))
    stream = intake.page_stream(spark, str(folder), PAGE_SCHEMA, files_per_trigger=1)
    query = intake.start_intake(stream, str(tmp_path / "c"), embed.hashed_words(4), throttled=True)
    try:
        query.processAllAvailable()
        assert cache.load_cache(spark, str(tmp_path / "c")).count() == 1
    finally:
        query.stop()


def test_streams_of_requests(spark, tmp_path):
    schema = "url string, value string, ts int"
    for n, rows in enumerate([[("u", "a", 1), ("v", "b", 2)], [("u", "c", 3), ("u", "z", 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seen = request_streams.seen_keys(stream.select("url"))
        request_streams.run_to_table(seen, str(tmp_path / "seen"), "append").awaitTermination()
        last = request_streams.last_values(stream, "url", "ts", "value")
        request_streams.run_to_table(last, str(tmp_path / "last"), "update").awaitTermination()
        assert n < 2
    assert spark.read.parquet(str(tmp_path / "seen/data")).count() == 2
    states = spark.read.parquet(str(tmp_path / "last/data"))
    final = weblog.last_per_key(states, "url", states["batch"], "ts", "value")
    assert {r.url: r.value for r in final.collect()} == {"u": "c", "v": "b"}


def test_semantic_job(spark, tmp_path):
    site = spark.createDataFrame(list(SAMPLES.items()), "page_id string, html string")
    report = semantic.analyse(site, str(tmp_path / "cache"), embed.hashed_words(16), k=2)
    assert report.vectors.count() == 5 and report.missing.count() == 0
    assert report.neighbours.count() == 10 and report.layout.count() == 5
    calls = []

    def never(batch):
        calls.append(batch)
        raise AssertionError("everything is cached")

    again = semantic.analyse(site, str(tmp_path / "cache"), never, k=2)
    assert again.vectors.count() == 5 and not calls


def test_site_report(spark, tmp_path):
    rows = [(i, f"https://x/{i}", markup) for i, markup in enumerate(SAMPLES.values())]
    site = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    visual = spark.createDataFrame(
        [(i, [float(i), 1.0, float(i * i)]) for i in range(4)], "id bigint, vector array<double>"
    )
    report = site_report.analyse(site, visual)
    cover = {r.lens: (r.total_pages, r.vectors, r.dimension) for r in report.summary.collect()}
    assert cover == {"structural": (5, 5, 28), "visual": (5, 4, 3), "combined": (5, 4, 31)}
    top = report.top.where("lens = 'visual'").orderBy("rank").collect()
    assert len(top) == 6 and top[0].url1.startswith("https://x/")
    site_report.save(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/feature_profile")).count() == 28


def test_refused_markup_is_its_own_text(spark):
    texts = folders.page_texts(pages(spark, "<![foo bar"))
    assert texts.first().text == "<![foo bar"
    assert parse_pages(pages(spark, "<![foo bar")).first().rejected


def test_stream_of_an_html_folder(spark, tmp_path):
    folder, root = tmp_path / "crawl", str(tmp_path / "cache")
    (folder / "deep").mkdir(parents=True)
    (folder / "a.html").write_bytes(b"<p>one \xff two</p>")  # a byte that is no text
    (folder / "b.htm").write_bytes("<p>zw\u00f6lf</p>".encode())
    (folder / "blank.html").write_bytes(b"<script>x()</script>")
    (folder / "notes.txt").write_bytes(b"<p>no</p>")
    seen = []

    def run():
        stream = intake.html_stream(spark, str(folder), files_per_trigger=2)
        query = intake.start_intake(stream, root, embed.hashed_words(4), each=lambda df, n: seen.append(df.count()))
        query.awaitTermination()
        return {r.page_id: r.content_hash for r in cache.load_cache(spark, root, "string").collect()}

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    assert run() == {"a.html": md5("one two"), "b.htm": md5("zw\u00f6lf")}
    (folder / "deep" / "c.html").write_bytes(b"<p>three</p>")
    assert run() == {"a.html": md5("one two"), "b.htm": md5("zw\u00f6lf"), "c.html": md5("three")}
    assert seen == [2, 1, 1]


def test_pages_named_by_their_path(spark, tmp_path):
    (tmp_path / "page_id=7").mkdir()
    (tmp_path / "page_id=7" / "x.txt").write_bytes(b"<p>a</p>\r\n")
    key = F.regexp_extract("path", "page_id=([^/]*)/", 1)
    rows = folders.html_folder(spark, str(tmp_path), "*.txt", key).select("page_id", "html").collect()
    assert [tuple(r) for r in rows] == [("7", "<p>a</p>\n")]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_of_tables_of_several_files(spark, tmp_path, files):
    rows = [(i, f"https://h{i}.example.org/x", "<p>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    if files > 1:
        pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    else:
        pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    found = queries.QUERIES["streamed_seen_urls"](spark, str(tmp_path)).collect()
    assert sorted(r.host for r in found) == sorted(f"h{i}.example.org" for i in range(12))


def test_a_batch_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(queries, "ROW_GROUP", 1 << 16)
    html = F.repeat(F.sha2(F.col("id").cast("string"), 512), 40)
    pages = spark.range(400).select(F.col("id").alias("page_id"), html.alias("html"))
    queries.write_batch_files(pages, str(tmp_path / "pages"), 3)
    files = list((tmp_path / "pages").glob("*.parquet"))
    assert len(files) == 3 and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)


def test_markup_files_of_pages_stand_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "FOLDER_FILES", 4)
    rows = [(i, f"<p>{i}é") for i in range(9)] + [(3, "<p>again"), (9, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1)
    root = tmp_path / "markup"
    for _ in range(2):  # a task that runs again changes nothing
        folders.write_html_files(pages, str(root))
        files = {f.name: f.read_bytes().decode() for f in root.rglob("*.txt")}
        lines = {n: sorted(text.split("\n")) for n, text in files.items()}
        want = {f"page_id={i}.txt": ["", f"<p>{i}é"] for i in range(9)} | {"page_id=9.txt": ["", ""]}
        assert lines == want | {"page_id=3.txt": ["", "<p>3é", "<p>again"]}
        assert sorted(f.name for f in root.iterdir()) == ["part=0"]
        assert len(list(root.rglob("block=*"))) == 3
    found = folders.html_folder(spark, str(root), "*.txt", queries.page_of_path()).collect()
    assert {r.page_id for r in found} == set(range(10)) and len(found) == 10


@pytest.fixture
def many_files(tmp_path):
    for i in range(1_500):
        (tmp_path / f"{i}.html").write_bytes(b"<p>%d</p>" % i)
    return tmp_path


def test_small_files_are_read_in_few_tasks(spark, many_files):
    found = folders.html_folder(spark, str(many_files))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert found.distinct().count() == 1_500


def test_small_files_of_a_stream_are_read_in_few_tasks(spark, many_files, monkeypatch):
    parts, texts = [], intake.page_texts

    def counted(pages, **options):
        parts.append(pages.rdd.getNumPartitions())
        return texts(pages, **options)

    monkeypatch.setattr(intake, "page_texts", counted)
    root = str(many_files / "cache")
    intake.start_intake(intake.html_stream(spark, f"{many_files}/*.html"), root, embed.hashed_words(4)).awaitTermination()
    assert len(parts) == 1 and parts[0] <= 4 * spark.sparkContext.defaultParallelism
    assert cache.load_cache(spark, root, "string").count() == 1_500
