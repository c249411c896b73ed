"""Runs of repeated words: maximal stretches that repeat with a period.

Method. The words of a text are appended one by one. The suffix automaton of the text has a
tree of suffix links, and the path from its root to the state of a prefix holds all suffixes
of that prefix. Each state carries the place where its words last ended. Appending word i
recolours the path of its prefix with i, which is the access operation of a link-cut tree:
a path is kept as splay trees, one for each segment of one colour, so that the segments met
on the way are few (amortised, their number is logarithmic). A segment of colour e whose
deepest state is `length` words long says that these words ended at e and end again at i,
and that no longer ones do. With d = i - e: if d <= length, the last 2 d words are a square
of period d, and the period holds from e - length + 1 up to i, not further left. The least
period of a run always shows as such a segment, since the last occurrence of a primitive
word inside its own square is one period back; so d is the least period, and the last i that
gives one (first word, d) is the end of the run.

Only words that can be in a run are appended. A run of `length >= max(LEAST, POWER * period)`
holds two equal windows of `window_size()` words that cover all of it, so a text is cut to the
stretches its repeated windows cover (equal hashes; a collision makes a stretch longer and
changes nothing). A stretch holds each of its runs whole with the words around it that could
extend it, so that cutting loses and changes none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import small_batches

LEAST = 24  # words of a run, at least
POWER = 3  # periods in a run, at least
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
FOUND = (
    "doc_id long, n_words long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


# -- suffix automaton and its link tree --------------------------------------------


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: longest length and suffix link of each state, state of each prefix.

    State 1 is the root; 0 is none.
    """
    lengths, links, steps = [0, 0], [0, 0], [{}, {}]
    prefixes = []
    last = 1
    for i, word in enumerate(words):
        new = len(lengths)
        lengths.append(i + 1)
        links.append(1)
        steps.append({})
        at = last
        while at and word not in steps[at]:
            steps[at][word] = new
            at = links[at]
        if at:
            target = steps[at][word]
            if lengths[target] == lengths[at] + 1:
                links[new] = target
            else:
                copy = len(lengths)
                lengths.append(lengths[at] + 1)
                links.append(links[target])
                steps.append(steps[target].copy())
                links[target] = links[new] = copy
                while at and steps[at].get(word) == target:
                    steps[at][word] = copy
                    at = links[at]
        prefixes.append(new)
        last = new
    return lengths, links, prefixes


def _to_root(x: int, up: list[int], left: list[int], right: list[int], colours: list[int]) -> None:
    """Splay x to the root of its tree. A tree's colour stands at its root."""
    while True:
        parent = up[x]
        if left[parent] == x:
            x_left = True
        elif right[parent] == x:
            x_left = False
        else:
            return
        grand = up[parent]
        if left[grand] == parent:
            if x_left:  # both left: turn the parent first
                moved = left[grand] = right[parent]
                right[parent] = grand
            else:
                moved = left[grand] = right[x]
                right[x] = grand
            top = grand
        elif right[grand] == parent:
            if x_left:
                moved = right[grand] = left[x]
                left[x] = grand
            else:
                moved = right[grand] = left[parent]
                left[parent] = grand
            top = grand
        else:
            top = 0
        if not top:  # the parent is the root
            if x_left:
                moved = left[parent] = right[x]
                right[x] = parent
            else:
                moved = right[parent] = left[x]
                left[x] = parent
            up[moved] = parent
            up[parent] = x
            up[x] = grand
            up[0] = 0
            colours[x] = colours[parent]
            return
        up[moved] = grand
        above = up[grand]
        if right[parent] == grand or left[parent] == grand:  # straight: x below its parent below
            up[grand] = parent
            if x_left:
                moved = left[parent] = right[x]
                right[x] = parent
            else:
                moved = right[parent] = left[x]
                left[x] = parent
        else:  # bent: x goes between
            up[grand] = x
            if x_left:
                moved = left[parent] = right[x]
                right[x] = parent
            else:
                moved = right[parent] = left[x]
                left[x] = parent
        up[moved] = parent
        up[parent] = x
        up[x] = above
        up[0] = 0
        if left[above] == grand and above:
            left[above] = x
        elif right[above] == grand and above:
            right[above] = x
        else:
            colours[x] = colours[grand]


def ends_of_squares(words: list[int]) -> dict[tuple[int, int], int]:
    """Last word of every run (first word, least period) of at least two periods."""
    lengths, links, prefixes = automaton(words)
    n = len(lengths)
    left, right, colours = [0] * n, [0] * n, [-1] * n
    up = links  # every state starts as a tree of its own below its link
    ends: dict[tuple[int, int], int] = {}
    for i, x in enumerate(prefixes):
        below = 0
        while x:
            _to_root(x, up, left, right, colours)
            e = colours[x]
            if right[x]:
                colours[right[x]] = e  # what hangs below leaves the path with its colour
            right[x] = below
            length = lengths[x]
            if e >= 0 and i - e <= length:
                ends[e - length + 1, i - e] = i
            below = x
            x = up[x]
        colours[below] = i
    return ends


# -- texts -------------------------------------------------------------------------


def window_size(least: int = LEAST, power: int = POWER) -> int:
    """Words that every run of some period p repeats p words on, at least; a power of two."""
    repeated = min(max(least, power * p) - p for p in range(1, least + 1))
    return 1 << (repeated.bit_length() - 1)


def stretches(words: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches covered by windows found twice or more."""
    keys, size = words.astype(np.uint64), 1
    while size < window:
        mixed = keys ^ (keys >> np.uint64(29))
        keys = keys[:-size] * np.uint64(_FACTORS[size.bit_length() % 4]) + mixed[size:]
        size *= 2
    order = np.argsort(keys)
    equal = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(equal):
        return []
    starts = np.unique(np.concatenate([order[equal], order[equal + 1]]))
    cuts = np.flatnonzero(starts[1:] > starts[:-1] + window) + 1
    firsts = starts[np.concatenate([[0], cuts])]
    lasts = starts[np.concatenate([cuts - 1, [len(starts) - 1]])]
    return list(zip(firsts.tolist(), (lasts + window).tolist(), strict=True))


def runs_of(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if len(words) < least:
        return []
    numbers: dict = {}
    for word in words:
        numbers.setdefault(word, len(numbers))
    coded = np.array([numbers[word] for word in words], np.int64)
    found = []
    for first, end in stretches(coded, window_size(least, power)):
        for (start, period), last in ends_of_squares(coded[first:end].tolist()).items():
            length = last - start + 1
            if length >= least and length >= power * period:
                found.append((first + start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        counts, found, texts = [], [], []
        for text in batch.column(1):
            words = (text.as_py() or "").encode().split()  # at ASCII white space
            runs = runs_of(words)
            counts.append(len(words))
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            texts.append(b" ".join(collapsed(words, runs)).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(struct)), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of (doc_id, text).

    Words are what ASCII white space separates. `runs` holds the start (from 0), length and
    least period in words of every run of LEAST words and POWER periods or more; `collapsed`
    is the text's words joined by one space, each run cut to its first period. Rows stay
    rows: repeated ones are repeated, a null doc_id stays null, and no row needs another, so
    there is no shuffle. A null, empty or blank text has no words, no runs and an empty
    collapsed text. A text is handled whole in its task, in n log n steps; its automaton takes
    about half a kilobyte for each word of its longest repeated stretch. Ties of
    two runs (one start) stand by period. An empty table gives an empty result. Columns other
    than these two are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _find_batches, FOUND
    )
