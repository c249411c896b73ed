import pytest

from helpers import by_page, parsed
from pagelens.operators import features
from pagelens.operators.features import VECTOR_FEATURES

FORM_PAGE = (
    "<html><head><meta name='d' content='1'><meta property='og' content='2'>"
    "<meta name='d' content='3'><meta name='e' content=''></head><body id='main12' class='z a'>"
    "<nav><a href='http://x'>1</a><a href='https://x'>2</a><a href='httpfoo'>3</a>"
    "<a href='/r'>4</a><a href='mailto:x'>5</a><a href=''>6</a><a name='n'>7</a></nav>"
    "<form id='f7b8'><input><input type='radio'><select></select><button class='a a'></button>"
    "</form><table></table><h1>x y</h1><h6>z</h6></body></html>"
)


def test_css_forms_links(spark):
    pages = parsed(spark, FORM_PAGE, "")
    css = by_page(features.css_fingerprint(pages))
    assert (css[1].unique_classes, css[1].total_classes, css[1].unique_ids) == (2, 4, 2)
    assert (css[2].unique_classes, css[2].total_classes, css[2].unique_ids) == (0, 0, 0)
    form = by_page(features.form_structure(pages))[1]
    assert (form.form_count, form.input_count, form.button_count, form.select_count) == (1, 2, 1, 1)
    strict = by_page(features.link_structure(pages))[1]
    assert (strict.total_links, strict.internal_links, strict.external_links, strict.nav_links) == (
        6, 4, 2, 1,
    )
    loose = by_page(features.link_prefix_counts(pages))[1]
    assert (loose.internal_links, loose.external_links) == (3, 3)


def test_patterns(spark):
    found = by_page(features.pattern_list(parsed(spark, FORM_PAGE)))[1]
    assert found.patterns == ["id:mainN", "class:a.z", "id:fNbN", "class:a.a"]


def test_pattern_limits(spark):
    many = "".join(f"<p id='k{'x' * i}' class='c'></p>" for i in range(150))
    found = by_page(features.pattern_list(parsed(spark, many)))[1].patterns
    assert len(found) == 50 and found[0] == "id:k" and found[1] == "class:c"


def test_sequence_limit(spark):
    found = features.tag_sequence(parsed(spark, "<i></i>" * 250)).first()
    assert found.tags == ["i"] * 200


def test_depth(spark):
    found = by_page(features.depth_statistics(parsed(spark, "<a><b><i></i></b></a>", "")))
    assert (found[1].max_depth, found[1].avg_depth) == (3, 2.0)
    assert found[1].depth_variance == pytest.approx(2 / 3)
    assert (found[2].max_depth, found[2].avg_depth, found[2].depth_variance) == (0, 0.0, 0.0)


def test_meta_inputs_ids(spark):
    pages = parsed(spark, FORM_PAGE)
    assert {r.name: r.content for r in features.meta_info(pages).collect()} == {"d": "3", "og": "2"}
    assert {r.input_type: r.n for r in features.input_types(pages).collect()} == {"text": 1, "radio": 1}
    assert {r.id: r.n for r in features.id_counts(pages).collect()} == {"main12": 1, "f7b8": 1}


def test_vector(spark):
    row = by_page(features.feature_vector(parsed(spark, FORM_PAGE, "")))
    assert len(VECTOR_FEATURES) == 28
    assert row[1].total_tags == 23 and row[1].heading_count == 2 and row[1].nav_elements == 1
    assert row[1].has_table and not row[1].has_svg
    assert row[1].text_length == len("1234567x yz") and row[1].word_count == 2
    assert all(row[2][name] == 0 for name in VECTOR_FEATURES)


def test_top_k_breaks_ties_by_first_seen(spark):
    pages = parsed(spark, "<u class='z y'></u><b></b><i class='y'></i><i class='x'></i>")
    top = features.top_tags(pages, 2).orderBy("rank").collect()
    assert [(r.tag, r.n) for r in top] == [("i", 2), ("u", 1)]
    classes = features.top_k(features.class_counts(pages), "class", 2).orderBy("rank").collect()
    assert [(r["class"], r.n) for r in classes] == [("y", 2), ("z", 1)]
