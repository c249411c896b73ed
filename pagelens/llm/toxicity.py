"""Toxicity by a weighted lexicon.

Texts are folded first: case, look-alike letters of other scripts and full-width forms to
plain letters, digits and signs within words to the letters they stand for. An Aho-Corasick
automaton then finds the terms of the lexicon: whole words and beginnings of words, each
with a weight, and exception phrases, word pairs in which a term is harmless. The weights
of matched words that no exception covers are added up and normalised by length; a logistic
model of the sum and of its share turns them into a score between 0 and 1.

The lexicon is learnt: terms are weighed by the smoothed log odds of their document counts
over the labelled rows that may be learnt from, and those whose odds are surely high are kept.
Exceptions are pairs with a term that are at home in harmless texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import is_training_row, small_batches
from pagelens.session import written

TRAINING = 200_000  # labelled rows the lexicon is learnt from, at most; picked by the hash of the id
MIN_DOCS = 4  # toxic texts a term, or harmless ones a phrase, must occur in
SURE = 2.5  # standard errors by which a term's log odds must exceed LEAST_ODDS
LEAST_ODDS = 0.25
PRIOR = 1.0  # harmless texts every term is taken to occur in besides
MIN_ODDS = 2.5  # smoothed log odds a term must have
PREFIXES = range(4, 8)  # lengths of beginnings of words
FLUSH = 200_000  # counts a task holds at most before it passes them on
CALIBRATION = 12_000  # labelled rows at most for the logistic model

# Letters of other scripts that look like Latin ones, and signs in words.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏԛԝвкмнтгӕαεοριυνκτχγωıɡ",
        "aeopcyxijsdhlqwbkmhtræaeopiuvktxywig",
        strict=True,
    )
)
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
_FOLD = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE, ""))
_FOLDED = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}]")
_WIDE = re.compile("[\uff00-\uff5e\U0001d400-\U0001d7ff]")  # full-width and mathematical forms
_SIGNS = re.compile(r"[0134578@$!€]+")
_LETTER_OF = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W\d_]+")


def _letters(m: re.Match) -> str:
    """Signs between letters, and one sign before a word, as the letters they stand for."""
    (start, end), text, signs = m.span(), m.string, m.group()
    if end < len(text) and text[end].isalpha():
        before = text[start - 1] if start else " "
        first = len(signs) == 1 and signs != "!" and not (before.isalnum() or before == "_")
        if before.isalpha() or first:
            return signs.translate(_LETTER_OF)
    return signs


def fold(text: str | None) -> str:
    """Folded words, each after a blank, with a blank at the end; "" if there is none."""
    low = (text or "").lower()
    if not low.isascii():
        if _WIDE.search(low):
            low = unicodedata.normalize("NFKC", low).lower()
        if _FOLDED.search(low):
            low = low.translate(_FOLD)
    words = " ".join(_WORD.findall(_SIGNS.sub(_letters, low)))
    return f" {words} " if words else ""


# -- learning the lexicon ----------------------------------------------------------


def terms_of(folded: str) -> set[str]:
    """Candidate terms: " word " and " beginning"."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        for n in PREFIXES:
            if len(word) > n:
                out.add(f" {word[:n]}")
    return out


def _counted(tally: Counter, name: str) -> pa.RecordBatch:
    keys = list({k for k, _ in tally})
    columns = [
        pa.array(keys, pa.string()),
        pa.array([tally.get((k, 1), 0) for k in keys], pa.int64()),
        pa.array([tally.get((k, 0), 0) for k in keys], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [name, "toxic", "other"])


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            tally.update((t, label) for t in terms_of(fold(text.as_py())))
            if len(tally) >= FLUSH:
                yield _counted(tally, "term")
                tally = Counter()
    if tally:
        yield _counted(tally, "term")


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, text) of all labelled rows that may be learnt from. Rows without a
    label are left out; of repeated labels of a doc_id the greatest counts."""
    known = (
        labels.filter(is_training_row() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING), "labels")
    # At most TRAINING rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Term -> weight: every term whose log odds of occurring in toxic texts are high, and
    surely above LEAST_ODDS, by the standard error of their counts. The rule is the same for
    any number of texts and cuts no term off by rank; the labelled rows bound how many there
    are. A term that only repeats what a shorter beginning says is left out when it is
    matched: of the terms of a word the greatest weight counts."""
    small_batches(rows.sparkSession)
    (toxic, other) = rows.agg(
        F.sum((F.col("label") == 1).cast("long")), F.sum((F.col("label") != 1).cast("long"))
    ).first()
    if not toxic or not other:
        return {}
    counted = rows.mapInArrow(_term_batches, "term string, toxic long, other long")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log(
        (F.col("other") + PRIOR) / F.lit(other + 2 * PRIOR)
    )
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + PRIOR))
    weighed = counted.filter(F.col("toxic") >= MIN_DOCS).withColumn("weight", odds)
    best = weighed.filter((F.col("weight") >= MIN_ODDS) & (odds - SURE * error >= LEAST_ODDS))
    return {r["term"]: r["weight"] for r in best.collect()}


# -- matching ----------------------------------------------------------------------


class Matcher:
    """The automaton of a lexicon and its exceptions."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (term, weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (phrase, None))
        self.ready = len(weights) > 0
        if self.ready:
            self.automaton.make_automaton()

    def words(self, folded: str) -> dict[int, float]:
        """Where a matched word starts -> its greatest weight; words that lie in an
        exception phrase are left out."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if self.ready:
            for end, (term, weight) in self.automaton.iter(folded):
                start = end - len(term) + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > found.get(start, 0.0):
                    found[start] = weight
        if not spared or not found:
            return found
        starts, reach = [], []  # of the phrases by their start: the furthest end so far
        for start, end in sorted(spared):
            starts.append(start)
            reach.append(max(end, reach[-1] if reach else end))

        def inside(at: int) -> bool:
            before = bisect_right(starts, at)
            return before > 0 and at < reach[before - 1]

        return {at: weight for at, weight in found.items() if not inside(at)}


def _pair_batches(weights: dict[str, float]):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, tally = Matcher(weights, []), Counter()
        for batch in rows:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                folded, seen = fold(text.as_py()), set()
                for start in matcher.words(folded):
                    end = folded.index(" ", start + 1)
                    before = folded.rfind(" ", 0, start)
                    after = folded.find(" ", end + 1)
                    if before >= 0:
                        seen.add(folded[before : end + 1])
                    if after >= 0:
                        seen.add(folded[start : after + 1])
                tally.update((pair, label) for pair in seen)
                if len(tally) >= FLUSH:
                    yield _counted(tally, "pair")
                    tally = Counter()
        if tally:
            yield _counted(tally, "pair")

    return batches


def exceptions(rows: DataFrame, weights: dict[str, float]) -> list[str]:
    """Word pairs with a term that occur in at least MIN_DOCS texts, hardly any of them
    toxic."""
    if not weights:
        return []
    pairs = rows.mapInArrow(_pair_batches(weights), "pair string, toxic long, other long")
    pairs = pairs.groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    harmless = pairs.filter((F.col("other") >= MIN_DOCS) & (F.col("other") >= 9 * F.col("toxic")))
    return [r["pair"] for r in harmless.select("pair").collect()]


# -- scoring -----------------------------------------------------------------------


def measures(folded: str, matcher: Matcher) -> tuple[float, float]:
    """Logarithms of the matched weight and of the weight per 100 words."""
    total = sum(matcher.words(folded).values())
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> list[float]:
    """Offset and slopes by Newton's method with a small L2 penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w.tolist()


def _measure_batches(weights: dict[str, float], spared: list[str]):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, spared)
        for batch in rows:
            found = [measures(fold(t.as_py()), matcher) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([a for a, _ in found], pa.float64()),
                    pa.array([b for _, b in found], pa.float64()),
                ],
                ["doc_id", "label", "total", "share"],
            )

    return batches


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple:
    """(weights, exceptions, coefficients). Without rows of both classes the lexicon is
    empty and every text gets the share of toxic rows (one half without any)."""
    rows = written(labelled(docs, labels, label), "toxic-rows")
    weights = lexicon(rows)
    spared = exceptions(rows, weights)
    order = F.xxhash64("doc_id")
    last = rows.select(order.alias("h")).orderBy("h").limit(CALIBRATION).agg(F.max("h")).first()[0]
    chosen = rows.filter(order <= last) if last is not None else rows
    measured = chosen.mapInArrow(
        _measure_batches(weights, spared), "doc_id long, label int, total double, share double"
    )
    found = sorted(tuple(r) for r in measured.collect())  # about CALIBRATION rows of numbers
    y = np.array([r[1] for r in found], float)
    if not weights:
        sure = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        return weights, spared, [math.log(sure / (1 - sure)), 0.0, 0.0]
    return weights, spared, logistic(np.array([r[2:] for r in found], float), y)


def scored(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score, n_terms) of every row; null and empty texts hold no term."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, spared, (offset, by_total, by_share) = shared.value
        matcher = Matcher(weights, spared)
        for batch in rows:
            scores, counts = [], []
            for text in batch.column("text"):
                folded = fold(text.as_py())
                total, share = measures(folded, matcher)
                z = offset + by_total * total + by_share * share
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                counts.append(len(matcher.words(folded)) if total else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                ["doc_id", "score", "n_terms"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        batches, "doc_id long, score double, n_terms long"
    )
