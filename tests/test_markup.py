import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from helpers import by_page, pages, parsed
from pagelens.operators.dom import _PageBuilder, elements, parse_pages
from pagelens.operators.markup import PageReader
from pagelens.operators.structure import SIGNATURE_FIELDS


def shape(markup):
    return [(e["tag"], e["depth"], e["parent"]) for e in PageReader().read(markup).elements]


def test_no_implied_end_tags():
    assert shape("<div><p>a<p>b</div><i>c") == [
        ("div", 1, -1), ("p", 2, 0), ("p", 3, 1), ("i", 1, -1),
    ]


def test_void_and_self_closed_elements_close_at_once():
    assert shape("<div><br>x<x/>y<img></div>") == [
        ("div", 1, -1), ("br", 2, 0), ("x", 2, 0), ("img", 2, 0),
    ]
    assert shape("<br></br><p>") == [("br", 1, -1), ("p", 1, -1)]


def test_stray_end_tag_is_dropped_and_match_pops_all_inside():
    assert shape("</b><p><i><u></p><b>") == [
        ("p", 1, -1), ("i", 2, 0), ("u", 3, 1), ("b", 1, -1),
    ]


def test_attributes():
    reader = PageReader().read('<P ID=a id="b" hidden CLASS=" x  y ">t</P>')
    assert reader.elements[0]["attrs"] == {"id": "b", "hidden": "", "class": " x  y "}


def test_page_text_leaves_out_scripts_comments_and_templates():
    reader = PageReader().read(
        "<!DOCTYPE html><!-- no --><p>a<script>var t='</p>';</script>&amp;&copy;&nope; b"
        "<template>x</template><style>p{}</style></p>"
    )
    assert reader.page_text() == "a&\xa9&nope b"


def test_white_space_strings():
    assert PageReader().read("<p>a</p> \n\t <p>b</p>   <pre>  </pre>").page_text() == "a\nb   "[:3] + " " + "  "


def test_character_references():
    assert PageReader().read("<p>&#65;&#x42;&#150;</p>").page_text() == "AB–"


def test_own_string_of_headings():
    def own(markup):
        reader = PageReader().read(markup)
        return reader.own_string(reader.elements[0])

    assert own("<h1>Cart</h1>") == "Cart"
    assert own("<h1><span>Cart</span></h1>") == "Cart"
    assert own("<h1>My <b>cart</b></h1>") is None
    assert own("<h1></h1>") is None
    assert own("<h1><!-- checkout --></h1>") == " checkout "


def test_parse_stage(spark):
    rows = by_page(parsed(spark, "<html><body class='a b'>x</body></html>", "", "only text", "<![foo bar"))
    first = rows[1].elements
    assert [(e.pos, e.tag, e.depth, e.parent_pos) for e in first] == [
        (0, "html", 1, -1), (1, "body", 2, 0),
    ]
    assert first[1].classes == ["a", "b"] and first[1].attrs == {"class": "a b"}
    assert rows[2].elements == [] and rows[2].page_text == ""
    assert rows[3].elements == [] and rows[3].page_text == "only text"
    assert not rows[1].rejected and rows[4].rejected


def test_binary_markup_drops_bad_bytes_and_translates_line_ends(spark):
    raw = spark.createDataFrame([(1, bytearray(b"<p>a\xff\r\nb</p>"))], "page_id bigint, html binary")
    assert parse_pages(raw).first().page_text == "a\nb"


def test_field_choice_and_element_limit(spark):
    few = parse_pages(pages(spark, "<a><b><i>"), fields=("tag",), max_elements=2)
    assert [r.tag for r in elements(few).collect()] == ["a", "b"]


def test_many_pages_keep_their_rows(spark):
    many = spark.range(5000).select(
        F.col("id").alias("page_id"), F.format_string("<p id='%d'>x", "id").alias("html")
    )
    wrong = parse_pages(many).where("elements[0].attrs['id'] <> cast(page_id as string)")
    assert wrong.count() == 0


def test_texts_are_built_only_for_those_who_read_them(spark):
    made = pages(spark, "<p id='a'>x</p>", "", "<![foo bar")
    with_texts = parse_pages(made)
    without = parse_pages(made, texts=False)
    assert without.schema == with_texts.schema
    assert without.drop("page_text").collect() == with_texts.drop("page_text").collect()
    assert [row.page_text for row in without.collect()] == [None] * 3


def test_rows_are_handed_back_before_much_has_gathered():
    for page in ("<p class='c d' id='i'>x" * 50, "<p>" + "text " * 2_000):
        builder = _PageBuilder(("tag", "attrs", "classes"), None)
        tracemalloc.start()
        while not builder.is_full():
            builder.add(page)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 10_000_000


class _OneTask:
    """Stands for a table of pages: `parse_pages` hands it what a task would run on its batches."""

    def __init__(self, table):
        self.schema = table.schema

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_memory_of_the_parse_stage_does_not_follow_the_pages(spark):
    made = pages(spark, "")
    parse = parse_pages(_OneTask(made), fields=SIGNATURE_FIELDS)
    page = "<p class='c d' id='i'>x" * 50

    def peak(rows, batches=1):
        batch = pa.record_batch([pa.array(range(rows)), pa.array([page] * rows)], ["page_id", "html"])
        found, held, before = 0, 0, pa.total_allocated_bytes()
        tracemalloc.start()
        for out in parse(iter([batch] * batches)):
            found += out.num_rows
            held = max(held, pa.total_allocated_bytes() - before)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == rows * batches
        return most + held

    few = peak(220)
    assert peak(660) < 1.5 * few
    assert peak(220, batches=2) < 1.5 * few


def test_many_void_tags_and_nested_links_take_linear_time():
    start = time.perf_counter()
    PageReader().read("<p>a<br></p>" * 40_000)
    reader = PageReader().read("<a>some text " * 4_000)
    assert len(reader.element_text(reader.elements[0])) == len("some text") * 4_000
    assert time.perf_counter() - start < 5
