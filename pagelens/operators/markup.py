"""Markup constants and the small HTML reader used inside the parse stage."""

from __future__ import annotations

import html
from html.parser import HTMLParser

# Tags that are interactive by themselves.
INTERACTIVE_TAGS = ["button", "input", "select", "textarea", "a", "label", "details", "summary"]

# Event-handler attributes.
EVENT_ATTRIBUTES = [
    "onclick", "onchange", "onsubmit", "onmouseover", "onmouseout",
    "onmouseenter", "onmouseleave", "onfocus", "onblur", "oninput",
    "onkeydown", "onkeyup", "onkeypress",
]

# ARIA roles that imply interaction.
INTERACTIVE_ROLES = [
    "button", "link", "menuitem", "tab", "checkbox", "switch",
    "slider", "radio", "textbox", "combobox",
]

# Elements that never have content (HTML void elements, old names included).
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)

# Elements whose text is kept apart from the page's text.
APART_TAGS = frozenset(["script", "style", "template", "rt", "rp"])

# Elements in which runs of white space are kept as they are.
PREFORMATTED_TAGS = frozenset(["pre", "textarea"])

_MAY_INTERACT = frozenset(EVENT_ATTRIBUTES + ["tabindex", "role"])
_HEADINGS = frozenset(["h1", "h2"])
_ASCII_SPACE = " \n\t\f\r"


class _Stripped:
    """The stripped texts of one kind run together, with where each begins, so that the
    text of any element is a slice."""

    def __init__(self, texts: list[tuple[str, str]], kind: str) -> None:
        parts, self.begins, at = [], [0], 0
        for text, apart in texts:
            if apart == kind:
                parts.append(text.strip())
                at += len(parts[-1])
            self.begins.append(at)
        self.text = "".join(parts)

    def between(self, first: int, last: int) -> str:
        return self.text[self.begins[first]:self.begins[last]]


class PageReader(HTMLParser):
    """One page's elements in document order, with no implied end tags.

    An end tag closes everything up to the nearest open element of its name and is
    dropped when none is open; void elements close at once.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.elements: list[dict] = []
        self.texts: list[tuple[str, str]] = []  # (text, apart tag or "")
        self.open: list[int] = []
        self.open_names: dict[str, int] = {}
        self.apart: list[str] = []  # open elements whose text is kept apart
        self.preformatted = 0
        self.pending: list[str] = []
        self.stripped: dict[str, _Stripped] = {}
        self.spare_ends: dict[str, int] = {}  # end tags to come that are already done, by name

    def read(self, markup: str) -> PageReader:
        self.feed(markup)
        self.close()
        self._end_text()
        self._close_to(0)
        return self

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed, and counting them costs a tenth of the time."""
        return j

    # -- parser events -----------------------------------------------------------

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)
        if tag in VOID_TAGS:
            self._end(tag)
            self.spare_ends[tag] = self.spare_ends.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)
        self._end(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.spare_ends.get(tag):
            self.spare_ends[tag] -= 1
        else:
            self._end(tag)

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_entityref(self, name: str) -> None:
        known = html.entities.html5.get(name + ";")
        self.pending.append(known if known is not None else "&" + name)

    def handle_charref(self, name: str) -> None:
        code = int(name[1:], 16) if name[:1] in "xX" else int(name)
        char = ""
        if code < 256:
            char = bytes([code]).decode("windows-1252", "ignore")
        if not char and code <= 0x10FFFF:
            char = chr(code)
        self.pending.append(char or "�")

    def handle_comment(self, data: str) -> None:
        self._aside(data)

    def handle_decl(self, decl: str) -> None:
        self._aside(decl)

    def handle_pi(self, data: str) -> None:
        self._aside(data)

    def unknown_decl(self, data: str) -> None:
        if data.upper().startswith("CDATA["):
            self._end_text()
            self._add_text(data[len("CDATA["):], "")
        else:
            self._aside(data)

    # -- tree --------------------------------------------------------------------

    def _start(self, tag: str, attrs: list) -> None:
        self._end_text()
        self._add_child(len(self.elements))
        self.elements.append(
            {
                "tag": tag,
                "depth": len(self.open) + 1,
                "parent": self.open[-1] if self.open else -1,
                "attrs": {name: value or "" for name, value in attrs},
                "children": 0,
                "only": None,
                "first_text": len(self.texts),
                "last_text": len(self.texts),
            }
        )
        self.open.append(len(self.elements) - 1)
        if tag in APART_TAGS:
            self.apart.append(tag)
        elif tag in PREFORMATTED_TAGS:
            self.preformatted += 1
        self.open_names[tag] = self.open_names.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        self._end_text()
        if self.open_names.get(tag):
            level = len(self.open) - 1
            while self.elements[self.open[level]]["tag"] != tag:
                level -= 1
            self._close_to(level)

    def _close_to(self, level: int) -> None:
        for pos in reversed(self.open[level:]):
            element = self.elements[pos]
            element["last_text"] = len(self.texts)
            tag = element["tag"]
            self.open_names[tag] -= 1
            if tag in APART_TAGS:
                self.apart.pop()
            elif tag in PREFORMATTED_TAGS:
                self.preformatted -= 1
        del self.open[level:]

    def _end_text(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending = []
        if not self.preformatted and not text.strip(_ASCII_SPACE):
            text = "\n" if "\n" in text else " "
        self._add_text(text, self.apart[-1] if self.apart else "")

    def _add_text(self, text: str, apart: str) -> None:
        self._add_child(text)
        self.texts.append((text, apart))

    def _aside(self, text: str) -> None:
        """A comment or declaration: a child of its parent, but no part of any text."""
        self._end_text()
        self._add_child(text)

    def _add_child(self, child: int | str) -> None:
        if self.open:
            parent = self.elements[self.open[-1]]
            parent["children"] += 1
            parent["only"] = child

    # -- results -----------------------------------------------------------------

    def page_text(self) -> str:
        return "".join(text for text, apart in self.texts if not apart)

    def own_string(self, element: dict) -> str | None:
        """The element's only string, followed through only children; headings alone need it."""
        if element["tag"] not in _HEADINGS:
            return None
        while element["children"] == 1:
            if isinstance(element["only"], str):
                return element["only"]
            element = self.elements[element["only"]]
        return None

    def element_text(self, element: dict) -> str | None:
        """Stripped strings run together, for the elements that may be interactive."""
        tag = element["tag"]
        if tag not in INTERACTIVE_TAGS and _MAY_INTERACT.isdisjoint(element["attrs"]):
            return None
        own = tag if tag in APART_TAGS else ""
        if own not in self.stripped:
            self.stripped[own] = _Stripped(self.texts, own)
        return self.stripped[own].between(element["first_text"], element["last_text"])
