"""Inputs that Spark derives from the given tables, as SQL both engines read.

The given pages have no forms, ids, roles or meta names, so documents are dressed up as
pages that have them; logs and crawl listings come from events, pages and embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.dom import ALL_FIELDS, parse_pages
from pagelens.sources.tables import read_table

DRESSED_HTML = """
concat(
  '<!DOCTYPE html><html lang="', lang, '"><head><meta charset="utf-8">',
  '<meta name="description" content="', source, '">',
  '<meta property="og:locale" content="', lang, '">',
  '<meta name="description" content="', source, '-', lang, '">',
  '<meta name="robots" content=""><title>', source, '</title></head>',
  '<body id="page-', source, '" class="', lang, ' theme', CAST(n_chars % 4 AS STRING), '">',
  '<nav>', repeat('<a href="/list">list</a>', CAST(n_chars % 60 AS INT)), '</nav>',
  '<a href="https://', lang, '.example.org/">out</a><a href="http://a.example.org/">old</a>',
  '<a href="httpfoo:1">odd</a><a name="top">here</a>',
  repeat('<section class="block"><img src="i.png"></section>', CAST(n_chars % 6 AS INT)),
  CASE WHEN quality = 1 THEN concat(
    '<form id="login7" onsubmit="go()"><label>Name</label><input>',
    '<input type="password" class="field wide"><input type="text" id="">',
    '<select><option>1</option></select></form>') ELSE '' END,
  CASE WHEN quality = 1 AND lang = 'en'
    THEN '<button title="ADD TO BAG" class="buy">Buy</button>' ELSE '' END,
  CASE n_chars % 9
    WHEN 0 THEN '<h1>Your Bag</h1>'
    WHEN 1 THEN '<h2>Payment</h2>'
    WHEN 2 THEN '<div class="product-grid"></div>'
    WHEN 3 THEN repeat('<div class="Product-Card x"></div>', 4)
    WHEN 4 THEN '<h1>Contact us</h1>'
    WHEN 5 THEN '<h1><span>My Account</span></h1>'
    WHEN 6 THEN '<h1>My <b>Account</b></h1>'
    WHEN 7 THEN '<div class="CHECKOUT-box"></div>'
    ELSE '' END,
  '<div role="button" tabindex="0" onclick="f()"> go <b> on </b></div>',
  '<div role="banner">b</div>',
  '<p id="para', CAST(n_chars % 5 AS STRING), '"><b>',
  translate(text, '<>&', '   '), '<br></div></body></html>')
"""

REQUEST_URL = """
concat(url, CASE event_type WHEN 'click' THEN '/api/items' WHEN 'view' THEN '/page.json'
  WHEN 'purchase' THEN '/v2/pay?step=1' WHEN 'signup' THEN '/graphql' ELSE '' END)
"""

# A repeated name, a value with '=', a bare word and stray blanks.
COOKIES = "concat('sid=', CAST(event_id AS STRING), '; u=a=b ;bare; sid=', event_type, ';e=')"

STATUS = "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END"

CONSOLE_MESSAGE = """
CASE WHEN toxic = 1 THEN concat('log DECRYPT_LOG:', text)
  WHEN quality = 1 THEN concat('fetch(', lang, ') ', text)
  ELSE text END
"""

HAS_PAGE = "url LIKE 'https://%'"
HAS_CRAWLED = "url LIKE '%?%'"
HAS_FINAL = "html NOT LIKE '%</html>%'"


def dressed_pages(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    joined = documents.join(labels, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("page_id"), F.expr(DRESSED_HTML).alias("html"))


def dressed(
    spark: SparkSession, sf: str, fields: tuple[str, ...] = ALL_FIELDS, texts: bool = False
) -> DataFrame:
    return parse_pages(dressed_pages(spark, sf), fields=fields, texts=texts)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Captured requests: each event of a user is a request to the page of that number."""
    events, pages = read_table(spark, sf, "events"), read_table(spark, sf, "pages")
    joined = events.join(
        pages.select(F.col("page_id").alias("user_id"), "url"), "user_id"
    )
    return joined.select(
        F.expr(REQUEST_URL).alias("url"),
        F.col("event_type").alias("method"),
        F.create_map(F.lit("cookie"), F.expr(COOKIES)).alias("headers"),
        F.expr(COOKIES).alias("cookie"),
        F.expr(STATUS).alias("status"),
        "ts",
    )


def crawl_listing(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, path, name, ext): which files a crawl left for each page."""
    pages, vectors = read_table(spark, sf, "pages"), read_table(spark, sf, "embeddings")
    markup = pages.select(
        "page_id",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.expr(HAS_PAGE), "page.html"),
                    F.when(F.expr(HAS_CRAWLED), "crawled.html"),
                    F.when(F.expr(HAS_FINAL), "final_page.html"),
                    F.lit("zz_other.html"),
                ),
                lambda name: name.isNotNull(),
            )
        ).alias("name"),
    )
    pictures = vectors.select(
        F.col("vec_id").alias("page_id"),
        F.concat(F.lit("shot"), F.col("label").cast("string"), F.lit(".png")).alias("name"),
    )
    both = markup.unionByName(pictures)
    path = F.concat(F.lit("crawl/"), F.col("page_id").cast("string"), F.lit("/"), F.col("name"))
    return both.select(
        "page_id", path.alias("path"), "name", F.substring_index("name", ".", -1).alias("ext")
    )


def console(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    joined = documents.join(labels, "doc_id", "left")
    return joined.select(F.expr(CONSOLE_MESSAGE).alias("message"))


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched files: pages and their scripts under script-like URLs."""
    pages = read_table(spark, sf, "pages")
    return pages.select(
        F.expr("concat('https://', split_part(url, '/', 3), '/js/', lower(substr(html, 39, 2)))")
        .alias("url"),
        F.expr(
            "CASE WHEN url LIKE 'https%' THEN 'text/javascript' "
            "WHEN url LIKE '%.html' THEN 'application/json' ELSE 'text/html' END"
        ).alias("content_type"),
        F.expr("CASE WHEN url LIKE '%#top' THEN '' ELSE html END").alias("body"),
        F.col("page_id").alias("ts"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, vector) of the visual lens."""
    table = read_table(spark, sf, "embeddings")
    return table.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )


def document_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current texts, an older cache of them, and a run's new vectors.

    The cache holds the labelled documents, those marked toxic under an outdated hash, and
    nothing for the others; in the new run, texts of fewer than 200 characters failed.
    """
    documents, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = F.lit("offline").alias("model")
    current = documents.select(
        F.col("doc_id").alias("page_id"), model, F.md5("text").alias("content_hash"), "n_chars"
    )
    old = documents.join(labels, "doc_id")
    cache = old.select(
        F.col("doc_id").alias("page_id"),
        model,
        F.when(F.col("toxic") == 1, F.md5(F.concat("text", F.lit("old"))))
        .otherwise(F.md5("text"))
        .alias("content_hash"),
        F.array(F.col("quality").cast("double"), F.lit(1.0)).alias("embedding"),
    )
    failed = F.col("n_chars") < 200
    new = current.select(
        "page_id",
        "model",
        "content_hash",
        F.when(~failed, F.array(F.col("n_chars").cast("double"), F.lit(2.0))).alias("embedding"),
    )
    return current.drop("n_chars"), cache, new
