from helpers import parsed
from pagelens.operators.interactables import interactable_counts, interactables, site_interactables
from pagelens.operators.markup import EVENT_ATTRIBUTES, INTERACTIVE_ROLES, INTERACTIVE_TAGS


def test_every_tag_handler_and_role_counts(spark):
    tags = "".join(f"<{t}></{t}>" for t in INTERACTIVE_TAGS)
    handlers = "".join(f"<i {h}='x()'></i>" for h in EVENT_ATTRIBUTES)
    roles = "".join(f"<i role='{r}'></i>" for r in INTERACTIVE_ROLES)
    others = "<i tabindex='-1'></i><i role='banner'></i><i role='Button'></i><i class='c' id='d'></i>"
    found = interactables(parsed(spark, tags + handlers + roles + others)).collect()
    assert len(found) == 8 + 13 + 10 + 1


def test_projection(spark):
    markup = (
        "<a href='/x' id='i' class='c d' rel='r' role='banner'> go <b> on </b><script>no</script></a>"
        "<div onclick='f()' href='/y' role='tab' tabindex=''>t</div><p class=''>x</p>"
    )
    link, div = interactables(parsed(spark, markup)).orderBy("pos").collect()
    assert link.attributes == {"href": "/x", "id": "i"}
    assert link.classes == ["c", "d"] and link.text == "goon"
    assert div.attributes == {"onclick": "f()", "role": "tab", "tabindex": ""}
    assert div.classes is None and div.text == "t"


def test_counts(spark):
    pages = parsed(spark, "<a></a><a></a><button>", "<p>")
    assert {r.page_id: r.interactables for r in interactable_counts(pages).collect()} == {1: 3, 2: 0}
    site = {r.tag: (r.elements, r.pages) for r in site_interactables(pages).collect()}
    assert site == {"a": (2, 1), "button": (1, 1)}
