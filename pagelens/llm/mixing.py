"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target amount of words. Documents are taken as often as the whole part of
target / source size, and once more with the fractional part as probability. Which ones, the
cube method settles: in the flight phase the vector of probabilities moves through the null
space of the constraints (number of documents, number of words), until all but a few are 0
or 1; every move keeps the expected totals of both exactly. The few that are left are flown
again together with those of other blocks, until one small landing problem per source
remains (at most LANDING + KEEP documents), which takes the rounding nearest to the totals.

A block holds a bounded number of documents, chosen by a hash of the document, so a source
of any size is spread over tasks. Random choices are drawn from the block's name: reruns
agree.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import numbered
from pagelens.session import small_side, written

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
SHARE = 1.5  # of all words the mix takes
MOST_TIMES = 2  # a document is taken
BLOCK = 512
KEEP = 2  # constraints: documents and words
LANDING = 12  # open units that are landed without a flight, besides the KEEP it leaves
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, target) from rows of (source, size).

    Sources in code point order, null last, weigh WEIGHTS in turn. What a target has above
    MOST_TIMES its source's size is shared anew by weight among the others, until none is
    above. The rounds add up single numbers; the table of sources stays in Spark."""
    totals = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
    )
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked = numbered(totals, order, "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    most = F.col("source_size") * float(MOST_TIMES)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= most if level else F.lit(False)
        got = ranked.agg(
            F.sum(F.when(full, most).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if not got["open"] or got["n"] == capped:
            break
        capped = got["n"]
        level = (SHARE * total - got["used"]) / got["open"]
    target = F.least(most, F.col("weight") * level)
    return ranked.select("source", "n_docs", "source_size", target.alias("target"))


# -- the cube method ---------------------------------------------------------------


def _null_vector(rows: list[tuple[float, float]]) -> tuple[float, float, float]:
    """A vector orthogonal to both constraints over three documents (their cross product)."""
    (a1, a2), (b1, b2), (c1, c2) = rows
    u = (b1 * c2 - c1 * b2, c1 * a2 - a1 * c2, a1 * b2 - b1 * a2)
    if not any(u):  # all alike
        return (1.0, -1.0, 0.0)
    return u


def _move(p: list[float], u: tuple[float, ...], draw: random.Random) -> list[float]:
    """Move p along +u or -u to the side of the cube, with chances that keep its mean."""
    up = min(((1 - x) / v if v > 0 else x / -v) for x, v in zip(p, u, strict=True) if v)
    down = min((x / v if v > 0 else (1 - x) / -v) for x, v in zip(p, u, strict=True) if v)
    step = up if draw.random() * (up + down) < down else -down
    return [min(1.0, max(0.0, x + step * v)) for x, v in zip(p, u, strict=True)]


EDGE = 1e-9


def flight(units: list[tuple[float, float]], draw: random.Random) -> list[float]:
    """Probabilities after the flight phase; units are (probability, size), and at most
    KEEP of the results are neither 0 nor 1."""
    result = [p for p, _ in units]
    window: list[int] = []
    for i, p in enumerate(result):
        if EDGE < p < 1 - EDGE:
            window.append(i)
        else:
            result[i] = round(p)
        while len(window) == KEEP + 1:
            moved = _move(
                [result[j] for j in window], _null_vector([(1.0, units[j][1]) for j in window]), draw
            )
            for j, x in zip(window, moved, strict=True):
                result[j] = float(round(x)) if x <= EDGE or x >= 1 - EDGE else x
            window = [j for j in window if 0 < result[j] < 1]
    return result


def landing(units: list[tuple[float, float]]) -> list[float]:
    """The rounding of a few units that comes nearest to their expected words, then to
    their expected number. All 2**len(units) roundings are compared."""
    if not units:
        return []
    p, size = np.array(units).T
    choices = np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1
    misses = np.abs(choices @ size - p @ size), np.abs(choices.sum(1) - p.sum())
    return choices[np.lexsort((misses[1], np.round(misses[0], 6)))[0]].astype(float).tolist()


def _seed(*names: object) -> random.Random:
    return random.Random(zlib.crc32(repr(names).encode("utf-8", "surrogatepass")))


def _fly(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Fly a block; large documents go first. In one block of a stratum open units of all
    sizes stay on the ground at every level, so that the landing, where the stratum has this
    block only, can come close."""
    last = frame["blocks"].iloc[0] == 1
    frame = frame.sort_values(["size", "doc_id", "copy"], ascending=[False, True, True], kind="stable")
    units = list(zip(frame["p"].tolist(), frame["size"].astype(float).tolist(), strict=True))
    open_ = [i for i, (p, _) in enumerate(units) if EDGE < p < 1 - EDGE]
    ground = {open_[len(open_) * k // LANDING] for k in range(LANDING)} if key[1] == 0 and open_ else set()
    flown = [i for i in range(len(units)) if i not in ground]
    result = [p for p, _ in units]
    for i, p in zip(flown, flight([units[i] for i in flown], _seed(*key)), strict=True):
        result[i] = p
    if last:
        open_ = [i for i, p in enumerate(result) if EDGE < p < 1 - EDGE]
        for i, p in zip(open_, landing([(result[i], units[i][1]) for i in open_]), strict=True):
            result[i] = p
    return frame.assign(p=result)


UNITS = "stratum long, block long, blocks long, doc_id long, copy long, size long, p double"


def sample(units: DataFrame) -> DataFrame:
    """(doc_id, copy, p) with p 0 or 1, from (stratum, n, doc_id, copy, size, p); n is the
    number of units of the stratum.

    Level by level: blocks are flown, their open units gather in fewer blocks, until a
    stratum has one block, which is landed: each at its own level, whatever the others."""

    def level(number: int):
        def fly(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return _fly((int(key[0]), int(key[1]), number), frame)

        return fly

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    here = units.withColumn("blocks", blocks)
    most = here.agg(F.max("blocks")).first()[0] or 0
    rows = here.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy"), "blocks")).select(
        "stratum", "block", "blocks", "doc_id", "copy", "size", "p"
    )
    done, number, meet = None, 0, BLOCK // KEEP
    while most:
        flown = written(rows.groupBy("stratum", "block").applyInPandas(level(number), UNITS), "flown")
        settled = flown if most == 1 else flown.filter("p = 0 or p = 1")
        done = settled if done is None else done.union(settled)
        if most == 1:
            break
        # Each block leaves at most KEEP open units, so these of `meet` blocks fill one; the
        # grounded ones come on top in block 0.
        most, number = -(-most // meet), number + 1
        rows = flown.filter("p > 0 and p < 1").withColumns(
            {name: f(F.col(name) / meet).cast("long") for name, f in (("block", F.floor), ("blocks", F.ceil))}
        )
    return (rows if done is None else done).select("doc_id", "copy", "p")


def _placed(rows: DataFrame) -> DataFrame:
    """Add `copy`, the place of a row of (doc_id, size, source, mark) among those of its
    doc_id; rows that tie are equal in all that matters."""
    order = Window.partitionBy("doc_id").orderBy("size", "source", "mark")
    return rows.withColumn("copy", F.row_number().over(order).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, source, size, source_size, target, times, taken) for rows of (doc_id,
    source, text): how often the mix takes a row, and the words that makes.

    A text without words, null included, is not taken. Repeated rows are documents of
    their own. An empty table gives an empty result."""
    measured = docs.select("doc_id", "source", sizes(docs).alias("size"), F.xxhash64("text").alias("mark"))
    sized = written(_placed(measured).drop("mark"), "sized")
    wanted = small_side(targets(sized).withColumn("stratum", F.xxhash64("source")), "targets")
    joined = sized.join(
        wanted.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).drop("__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.least(ratio, F.lit(float(MOST_TIMES)))
    joined = joined.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.col("whole"))
    open_ = joined.filter("size > 0").select(
        "stratum", F.col("n_docs").alias("n"), "doc_id", "copy", "size", "p"
    )
    drawn = sample(open_).withColumnRenamed("p", "drawn")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.copy") == F.col("b.copy"))
    found = joined.alias("a").join(drawn.alias("b"), same, "left")
    times = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("drawn", F.lit(0.0))).otherwise(0.0)
    return found.select(
        "a.doc_id", "a.copy", "source", "size", "source_size", "target", times.cast("long").alias("times")
    ).withColumn("taken", F.col("size") * F.col("times"))


def repeat(docs: DataFrame) -> DataFrame:
    """Rows of `docs` as often as the mix takes them, with the columns of `docs`.

    Texts are moved once, to meet what is drawn for their doc_id. Only rows that share a
    doc_id with others are told apart by their place among them first."""
    drawn = written(
        mix(docs.select("doc_id", "source", "text")).select(F.col("doc_id").alias("__id"), "copy", "times"),
        "drawn",
    )
    shared = written(
        drawn.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__id"), "shared-ids"
    )
    several = not shared.isEmpty()
    other = shared.withColumnRenamed("__id", "__shared")
    once = drawn
    if several:
        once = drawn.join(other, F.col("__id").eqNullSafe(F.col("__shared")), "left_anti")
    # What is drawn grows with the table: it is never sent to all tasks.
    once = once.filter("times > 0").select("__id", F.col("times").alias("__times")).hint("merge")
    taken = docs.join(once, F.col("doc_id").eqNullSafe(F.col("__id")))
    rows = taken.select(F.struct(*docs.columns).alias("row"), "__times")
    if several:
        own = docs.join(other, F.col("doc_id").eqNullSafe(F.col("__shared")))
        own = own.select(
            F.struct(*docs.columns).alias("row"), "doc_id", "source",
            sizes(docs).alias("size"), F.xxhash64("text").alias("mark"),
        )
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("a.copy") == F.col("b.copy"))
        met = _placed(own).alias("a").join(drawn.filter("times > 0").alias("b"), same)
        rows = rows.union(met.select("row", "times"))
    again = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return again.select(*[F.col("row")[c].alias(c) for c in docs.columns])
