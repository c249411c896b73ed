"""Fill-in-the-middle rewriting of texts, as pyarrow.compute kernels over whole batches.

A text is cut into units (its lines, each with its line end), and two numbers of the row
say where prefix, middle and suffix part. All texts of a batch are worked on at once:
split into lists of units, the lists flattened with the row each unit came from, each unit
given its place in the row and from that its role, the units of a role taken out and made
into lists again, the lists joined to pieces, and the pieces put in the order of the form.
No step of this goes through Python values.

A text that holds one of the marks is left plain, as is an empty one, so that every output
can be turned back into its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REWRITTEN = (
    "doc_id long, n_units long, form string, prefix_chars long, middle_chars long, "
    "output string"
)
_PLAIN, _PSM, _SPM = "plain", "psm", "spm"


# -- one batch ---------------------------------------------------------------------


def units(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The units of all texts in one array, the row of each, and the number in each row.

    A unit ends with its line end or with the text; an empty text has none.
    """
    lists = pc.split_pattern(texts, "\n")
    parts, rows = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    last = np.zeros(len(parts), bool)
    last[np.cumsum(pc.list_value_length(lists).to_numpy()) - 1] = True
    ended = pc.if_else(pa.array(last), "", "\n").cast(parts.type)
    whole = pc.binary_join_element_wise(parts, ended, pa.scalar("", parts.type))
    kept = pc.not_equal(whole, pa.scalar("", whole.type))  # nothing stands after a last line end
    rows = rows[kept.to_numpy(zero_copy_only=False)]
    return pc.filter(whole, kept), rows, np.bincount(rows, minlength=len(texts))


def ordinals(counts: np.ndarray) -> np.ndarray:
    """Place of each unit in its row, from 0, for rows of so many units one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def joined(parts: pa.LargeStringArray, rows: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """The chosen units of each of n rows, joined to one string a row."""
    taken = pc.filter(parts, pa.array(chosen))
    ends = np.cumsum(np.bincount(rows[chosen], minlength=n))
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), taken)
    return pc.binary_join(lists, pa.scalar("", parts.type))


def rewrite(
    texts: pa.LargeStringArray, first: np.ndarray, second: np.ndarray, wanted: pa.Array
) -> dict[str, pa.Array]:
    """Outputs of a batch. `first` and `second` give the ends of prefix and middle as numbers
    that are taken modulo the units plus one; `wanted` is the form of each row, for texts
    that can have one."""
    n = len(texts)
    parts, rows, counts = units(texts)
    one, other = first % (counts + 1), second % (counts + 1)
    place, prefix_end, middle_end = ordinals(counts), np.minimum(one, other), np.maximum(one, other)
    before, after = place < prefix_end[rows], place >= middle_end[rows]
    pieces = [joined(parts, rows, chosen, n) for chosen in (before, ~before & ~after, after)]
    prefix, middle, suffix = pieces
    marks = [pa.scalar(m, parts.type) for m in (PREFIX, SUFFIX, MIDDLE, "")]
    p, s, m, none = marks
    plain = pc.equal(texts, none)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    form = pc.if_else(plain, _PLAIN, wanted)
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(
        pc.equal(form, _PLAIN), texts, pc.if_else(pc.equal(form, _PSM), psm, spm)
    )
    lengths = [
        pc.if_else(pc.equal(form, _PLAIN), pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64()))
        for x in (prefix, middle)
    ]
    return {
        "n_units": pa.array(counts, pa.int64()),
        "form": form,
        "prefix_chars": lengths[0],
        "middle_chars": lengths[1],
        "output": output,
    }


def _rewrite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        first, second = (batch.column(c).to_numpy() for c in ("__first", "__second"))
        made = rewrite(texts, first, second, batch.column("__form"))
        made["output"] = made["output"].cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *made.values()], names=["doc_id", *made]
        )


# -- tables ------------------------------------------------------------------------


def chance(doc_id: str, salt: str, number: int) -> Column:
    """The number-th unsigned 32 bits (from 1) of the SHA-256 of salt and id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, salt: str = "7:", percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """(doc_id, n_units, form, prefix_chars, middle_chars, output) of every row of (doc_id, text).

    `percent` of the rows are rewritten, `spm_percent` of these with the suffix first; which
    ones, and where they are cut, follows from the salt and the doc_id alone, so that reruns
    agree. A null doc_id counts as an empty one, and rows of one doc_id are cut at places
    drawn alike. A null text counts as empty; an empty text and one that holds a mark stay
    plain, with null lengths. Rows stay rows, repeated ones too. No row needs another: there is
    no shuffle, and a task holds one batch of whole texts, of any length. An empty table gives
    an empty result. Columns other than these two are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    form = F.when(chance("doc_id", salt, 3) % 100 >= percent, _PLAIN)
    form = form.when(chance("doc_id", salt, 4) % 100 < spm_percent, _SPM).otherwise(_PSM)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        chance("doc_id", salt, 1).alias("__first"),
        chance("doc_id", salt, 2).alias("__second"),
        form.alias("__form"),
    ).mapInArrow(_rewrite_batches, REWRITTEN)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. Texts that hold a mark are plain, so each mark of
    another output stands in it once."""
    def between(start: str, end: str | None) -> Column:
        begin = F.locate(start, output) + len(start)
        if end is None:
            return F.substring(output, begin, F.length(output))
        return F.substring(output, begin, F.locate(end, output) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == _PLAIN, output).when(form == _PSM, psm).otherwise(spm)
