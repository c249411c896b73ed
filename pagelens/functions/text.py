"""Text projections: visible text, hashes, prompts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip/str.split treat as white space,
# and those str.splitlines treats as line ends. Java's \s covers fewer of them.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"

# Prompt put around a page's markup before it is described.
PROMPT_CHARS = 20_000
PROMPT_HEAD = "Here is the HTML content of a webpage:\n"
PROMPT_TAIL = "\n\nDescribe the page in three concise sentences."


def strip(col: Column) -> Column:
    """Trim white space of any kind at both ends (SQL trim takes spaces only)."""
    return F.regexp_replace(col, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def visible_text(raw: Column) -> Column:
    """Clean a page's raw text: cut at line ends and double spaces, trim, drop blanks.

    Trimming before and after the double-space cut gives the same chunks as trimming
    after it, so one split does both cuts.
    """
    pieces = F.split(raw, f"[{LINE_ENDS}]|  ", -1)
    kept = F.filter(F.transform(pieces, strip), lambda piece: piece != "")
    return F.array_join(kept, " ")


def word_count(text: Column) -> Column:
    words = F.split(text, f"[{WHITESPACE}]+", -1)
    return F.size(F.filter(words, lambda w: w != "")).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.md5(text)


def short_hash(value: Column) -> Column:
    """First eight hex digits of the md5: the id used in captured file names."""
    return F.substring(F.md5(value), 1, 8)


def description_prompt(html: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), F.substring(html, 1, PROMPT_CHARS), F.lit(PROMPT_TAIL))


def short_label(label: Column, width: int) -> Column:
    """Cut a label longer than `width` and mark the cut (20 on heat maps, 15 on scatters)."""
    cut = F.concat(F.left(label, F.lit(width)), F.lit("..."))
    return F.when(F.length(label) > width, cut).otherwise(label)


def file_label(name: Column) -> Column:
    return F.replace(name, F.lit(".html"), F.lit(""))
