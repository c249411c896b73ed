from pyspark.sql import functions as F

from helpers import by_page, parsed
from pagelens.functions.labels import with_type_colour
from pagelens.operators import features
from pagelens.operators.page_types import classify, type_distribution

LINKS = "<a href='#'>x</a>"
SECTIONS = "<section></section><article></article>"

CASES = [
    ("<button data-auto-id='add-to-bag'>", "product"),
    ("<div data-auto-id='add-to-bag'>", "product"),
    ("<button title='Please ADD to bag now'>", "product"),
    ("<div title='add to bag'>", "other"),
    ("<h1>Your BAG</h1>", "cart"),
    ("<h3>Your bag</h3>", "other"),
    ("<p class='x my-Cart-Items'>", "cart"),
    ("<h2><b>Checkout</b> now</h2>", "other"),
    ("<h2><b>Secure payment</b></h2>", "checkout"),
    ("<p class='BILLING'>", "checkout"),
    ("<nav>" + LINKS * 51 + "</nav>" + SECTIONS * 2, "homepage"),
    ("<nav>" + LINKS * 50 + "</nav>" + SECTIONS * 2, "other"),
    ("<nav>" + LINKS * 51 + "</nav>" + SECTIONS + "<section></section>", "other"),
    ("<i class='product-grid'>", "category"),
    ("<i class='product-card a'></i>" * 4, "category"),
    ("<i class='product-tile'></i>" * 3, "other"),
    ("<h1>Get help</h1>", "contact"),
    ("<i class='get-in-touch'>", "contact"),
    ("<h2>My Account</h2>", "account"),
    ("<i class='user-profile'>", "account"),
    ("<h1>Your bag</h1><button title='add to bag'>", "product"),
    ("<h1>Contact</h1><i class='checkout'>", "checkout"),
    ("", "other"),
]


def test_rules_in_order(spark):
    pages = parsed(spark, *[markup for markup, _ in CASES])
    found = by_page(classify(pages))
    assert [found[i].page_type for i in range(1, len(CASES) + 1)] == [label for _, label in CASES]


def test_own_rules(spark):
    pages = parsed(spark, "<b><b>", "<i>")
    rules = [("bold", features.count_of(features.tags(), "b") > 1)]
    assert [r.page_type for r in classify(pages, rules).orderBy("page_id").collect()] == ["bold", "other"]


def test_distribution_and_colours(spark):
    typed = spark.createDataFrame([(1, "cart"), (2, "cart"), (3, "account")], "page_id int, page_type string")
    assert {r.page_type: r.pages for r in type_distribution(typed).collect()} == {"cart": 2, "account": 1}
    colours = {r.page_id: r.colour for r in with_type_colour(typed).collect()}
    assert colours == {1: "#4ECDC4", 2: "#4ECDC4", 3: "#95A5A6"}


def test_distribution_of_none(spark):
    typed = spark.createDataFrame([], "page_id int, page_type string")
    assert type_distribution(typed).agg(F.count("*")).first()[0] == 0
