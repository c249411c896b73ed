import hashlib
from urllib.parse import urlparse

from pyspark.sql import functions as F

from pagelens.functions import labels, text, urls, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{name} string" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def cleaned(raw):
    lines = (line.strip() for line in raw.splitlines())
    chunks = (phrase.strip() for line in lines for phrase in line.split("  "))
    return " ".join(chunk for chunk in chunks if chunk)


def test_visible_text_like_python(spark):
    samples = [
        "a  b\n c\t\n\n d", "   x   y  ", " a   b\x85c\x0bd\x1ce", "", " \n ", "a   b    c",
        "one\r\ntwo\rthree", "\ta  \tb",
    ]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    found = rows.select(text.visible_text(F.col("s")), text.word_count(F.col("s"))).collect()
    assert [r[0] for r in found] == [cleaned(s) for s in samples]
    assert [r[1] for r in found] == [len(s.split()) for s in samples]


def test_hashes_prompts_labels(spark):
    assert one(spark, text.short_hash(F.col("s")), s="abc") == hashlib.md5(b"abc").hexdigest()[:8]
    prompt = one(spark, text.description_prompt(F.col("s")), s="x" * 30_000)
    assert prompt.count("x") == 20_000 and prompt.endswith("three concise sentences.")
    assert one(spark, text.short_label(F.col("s"), 3), s="abcd") == "abc..."
    assert one(spark, text.short_label(F.col("s"), 4), s="abcd") == "abcd"
    assert one(spark, text.file_label(F.col("s")), s="home.html") == "home"


def test_url_parts_like_python(spark):
    samples = [
        "https://a.b:80/c/d?e=f#g", "http://a.b", "http://a b/c d?x y", "/only/path?q", "a/b#c", "", "http://x?y=1",
    ]
    rows = spark.createDataFrame([(s,) for s in samples], "u string")
    u = F.col("u")
    found = rows.select(urls.url_host(u), urls.url_path(u), urls.url_query(u)).collect()
    expected = [(p.netloc, p.path, p.query) for p in map(urlparse, samples)]
    assert [tuple(r) for r in found] == expected


def test_page_id_to_url(spark):
    got = one(spark, urls.url_from_page_id(F.col("s")), s="https___a.b__c__d")
    assert got == "https://a.b/c/d"


def test_cookies(spark):
    def parse(cookie):
        return one(spark, urls.cookie_map(F.col("s")), s=cookie)

    assert parse("a=1; b=x=y ;bare; a=2;c=") == {"a": "2", "b": "x=y", "c": ""}
    assert parse("") == {}
    assert parse("none") == {}


def test_api_urls(spark):
    good = ["/api/x", "x/graphql", "/rest/", "/v12/", "/service/", "a.json"]
    bad = ["/apis", "/v/", "/vx/", "json"]
    rows = spark.createDataFrame([(s,) for s in good + bad], "u string")
    found = [r[0] for r in rows.select(urls.is_api_url(F.col("u"))).collect()]
    assert found == [True] * len(good) + [False] * len(bad)


def test_scripts_and_console(spark):
    assert one(spark, urls.script_score(F.col("s")), s="fetch (x); headers : token") == 3
    assert one(spark, urls.script_score(F.col("s")), s="nothing") == 0
    assert one(spark, urls.tagged_payload(F.col("s")), s="a DECRYPT_LOG:b DECRYPT_LOG:c") == "b DECRYPT_LOG:c"
    assert one(spark, urls.tagged_payload(F.col("s")), s="a") is None


def test_name_categories(spark):
    names = ["Stans.html", "stan_pdp.html", "my_cart", "checkout2", "home", "cart_checkout"]
    rows = spark.createDataFrame([(s,) for s in names], "n string")
    found = rows.select(labels.name_category(F.col("n")), labels.name_colour(F.col("n"))).collect()
    assert [r[0] for r in found] == ["stan", "pdp", "cart", "checkout", "other", "cart"]
    assert found[0][1] == "#FF6B6B" and found[4][1] == "#FFD93D"


def test_bands(spark):
    rows = spark.createDataFrame([(0.81,), (0.8,), (0.6,)], "s double")
    found = [r[0] for r in rows.select(labels.similarity_band(F.col("s"))).collect()]
    assert found == ["Very similar", "Moderately similar", "Different"]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(
        vectors.unit(a), vectors.unit(b), vectors.cosine(a, a), vectors.cosine(a, b),
        vectors.weighted_average(a, F.array(F.lit(1.0)), 0.6),
    ).first()
    assert list(got[0]) == [0.6, 0.8] and got[1] is None and got[2] == 1.0 and got[3] == 0.0
    assert list(got[4]) == [3.0 * 0.6 + 0.4]
