"""Approximate nearest neighbours by an inverted multi-index, with measured recall.

Unit vectors are cut into two halves, and each half has a codebook of its own. A vector
lies in the cell of its two nearest codewords, so two small codebooks of k words name
k x k cells. With k near the cube root of the number of vectors, cells grow in number as
n^(2/3) and in size as n^(1/3), and the work of a search over all vectors as n^(4/3).

A query visits cells by growing distance from its two halves. How many it needs depends on
the data, so it is measured: for a bounded set of trial queries the exact neighbours among
all vectors are found, and the number of cells is the one that reaches the wanted share of
them. On vectors without any clusters that is a large part of the cells, on clustered ones few.
Candidates are compared by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.vectors import unit
from pagelens.operators.vector_join import Block, Nearest, _batch, _block_count, _kinds, _matrix, _table
from pagelens.session import written

FIT_SAMPLE = 20_000  # vectors the codebooks are fitted on, at most
TRIALS = 200  # queries the number of visited cells is measured on, at most
MAX_WORDS = 1_024  # codewords of a half, at most
ROUNDS = 8
BLOCK = 4_000  # rows, and queries, that an exact comparison holds at once
SLICE = 1_000  # rows of a batch that are compared with codewords at once


@dataclass
class Index:
    """Codebooks of both halves, how many cells a query visits, and the placed vectors."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int
    placed: DataFrame  # cell, id, unit


# -- codebooks ---------------------------------------------------------------------


def _squares(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    both = (rows**2).sum(1)[:, None] + (words**2).sum(1)[None, :]
    return np.maximum(both - 2.0 * rows @ words.T, 0.0)


def codebook(rows: np.ndarray, k: int) -> np.ndarray:
    """k codewords: rows far from those chosen before, then rounds of means."""
    rows = np.unique(rows, axis=0)
    k = min(k, len(rows))
    draw = np.random.default_rng(k)
    chosen = [int(draw.integers(len(rows)))]
    far = _squares(rows, rows[chosen])[:, 0]
    while len(chosen) < k:
        share = far / far.sum() if far.sum() > 0 else None
        chosen.append(int(draw.choice(len(rows), p=share)))
        far = np.minimum(far, _squares(rows, rows[chosen[-1:]])[:, 0])
    words = rows[chosen]
    for _ in range(ROUNDS):
        near = _squares(rows, words).argmin(1)
        sums, counts = np.zeros_like(words), np.bincount(near, minlength=k)
        np.add.at(sums, near, rows)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def _halves(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = units.shape[1] // 2
    return units[:, :at], units[:, at:]


def cells_of(units: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell each vector lies in."""
    first, second = (_squares(h, b).argmin(1) for h, b in zip(_halves(units), books, strict=True))
    return first * len(books[1]) + second


def visited(units: np.ndarray, books: tuple[np.ndarray, np.ndarray], count: int) -> np.ndarray:
    """The `count` cells nearest to each vector, nearest first.

    The i-th nearest word of one half with the j-th of the other is among the `count` best
    only if (i + 1) (j + 1) <= count, so no more than those pairs are ranked."""
    count = min(count, len(books[0]) * len(books[1]))
    far = [_squares(h, b) for h, b in zip(_halves(units), books, strict=True)]
    order = [np.argsort(f, axis=1, kind="stable") for f in far]
    ranked = [np.take_along_axis(f, o, 1) for f, o in zip(far, order, strict=True)]
    i, j = np.indices((len(books[0]), len(books[1])))
    kept = (i + 1) * (j + 1) <= count
    i, j = i[kept], j[kept]
    sums = ranked[0][:, i] + ranked[1][:, j]
    best = np.argsort(sums, axis=1, kind="stable")[:, :count]
    cells = order[0][:, i] * len(books[1]) + order[1][:, j]
    return np.take_along_axis(cells, best, 1)


# -- the index ---------------------------------------------------------------------


def _sample(units: DataFrame, count: int) -> DataFrame:
    """A bounded sample by the hash of the id, the same at every run."""
    return units.orderBy(F.xxhash64("id"), "id").limit(count)


def _as_matrix(rows: list) -> np.ndarray:
    return np.array([row.unit for row in rows], dtype=float)


def fit(vectors: DataFrame, k: int = 15, recall: float = 0.97) -> Index:
    """Index of all rows of (id, vector) for searches of the k nearest others.

    `recall` is the share of neighbours the trial queries must reach. Null and zero vectors have
    no direction and are left out; repeated vectors are rows of their own. The codebooks are fitted
    on a sample of FIT_SAMPLE vectors and the visits on TRIALS queries, both on the driver: so
    many vectors, and k more for each trial, come back at most. An empty table gives an empty
    index.
    """
    kept = vectors.select("id", unit(F.col("vector")).alias("unit")).where("unit is not null")
    units = written(kept, "index-units")
    n = units.count()
    sample = _as_matrix(_sample(units, FIT_SAMPLE).select("unit").collect()) if n else np.zeros((0, 2))
    words = max(2, min(MAX_WORDS, round(n ** (1 / 3)), len(sample) // 4))
    books = tuple(codebook(h, words) if n else h for h in _halves(sample))
    visits = _visits_needed(units, books, k, recall) if n else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                cells = pa.array(cells_of(_matrix(batch.column(1)), books), pa.int32())
                yield pa.RecordBatch.from_arrays([cells, *batch.columns], ["cell", "id", "unit"])

    id_type = units.schema["id"].dataType.simpleString()
    placed = units.mapInArrow(place, f"cell int, id {id_type}, unit array<double>")
    return Index(books, visits, written(placed, "index"))


def _visits_needed(units: DataFrame, books: tuple, k: int, recall: float) -> int:
    """Cells to visit so that `recall` of the trial queries' exact neighbours lie in them."""
    trials = _sample(units, TRIALS).collect()
    queries = _as_matrix(trials)
    own = np.array([t.id for t in trials])

    def best_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids, rows = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                scores = np.where(own[:, None] == ids[None, :], -np.inf, queries @ rows.T)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                trial = np.repeat(np.arange(len(queries)), best.shape[1])
                flat = best.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trial), pa.array(scores[trial, flat]), pa.array(cells_of(rows, books)[flat])],
                    ["trial", "score", "cell"],
                )

    found = units.select("id", "unit").mapInArrow(best_of_batch, "trial long, score double, cell long")
    order = W.partitionBy("trial").orderBy(F.desc("score"))
    nearest = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    every = visited(queries, books, len(books[0]) * len(books[1]))
    place = np.empty_like(every)
    np.put_along_axis(place, every, np.arange(every.shape[1])[None, :], 1)
    ranks = [place[r.trial, r.cell] for r in nearest.where("score > -2").select("trial", "cell").collect()]
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else 1


def search(index: Index, queries: DataFrame, k: int = 15) -> DataFrame:
    """(id, neighbour, similarity, rank): the k nearest others found for each row of
    queries(id, vector). Ties stand by id.

    Cells are dealt over blocks, queries likewise; a query is sent once to each block that holds
    cells it visits, with their numbers, and compared there with the rows of those cells."""
    books, visits = index.books, index.visits
    row_blocks = _block_count(index.placed.count())
    asked = queries.select("id", unit(F.col("vector")).alias("unit")).where("unit is not null")
    query_blocks = _block_count(asked.count())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, SLICE * 100 // visits)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                cells = np.sort(visited(_matrix(batch.column(1)), books, visits), axis=1)
                order = np.argsort(cells % row_blocks, axis=1, kind="stable")
                cells = np.take_along_axis(cells, order, 1)
                blocks = cells % row_blocks
                row, at_cell = np.nonzero(np.diff(blocks, axis=1, prepend=-1))
                starts = row * cells.shape[1] + at_cell
                offsets = pa.array(np.r_[starts, cells.size], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(cells.ravel(), pa.int32()))
                block = pa.array(blocks[row, at_cell], pa.int32())
                rows = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([block, lists, *rows.columns], ["row", "cells", "id", "unit"])

    id_type = asked.schema["id"].dataType.simpleString()
    sent = asked.mapInArrow(probe, f"row int, cells array<int>, id {id_type}, unit array<double>")
    number = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("query")
    sent = sent.select(F.lit(True).alias("asked"), "row", number, "cells", "id", "unit")
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query")
    held = index.placed.select(
        F.lit(False).alias("asked"), F.pmod("cell", F.lit(row_blocks)).alias("row"), every,
        F.array("cell").alias("cells"), "id", "unit",
    )
    schema = f"id {id_type}, neighbour {id_type}, similarity double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        kinds = _kinds(schema, table.schema.field("id").type)
        wanted, rows = _sides(table)
        lists = table.column("cells").combine_chunks().filter(table.column("asked").combine_chunks())
        of_row = table.column("cells").combine_chunks().filter(pa.compute.invert(table.column("asked").combine_chunks()))
        cells = of_row.flatten().to_numpy()
        order = np.argsort(cells, kind="stable")
        rows, cells = rows.rows(order), cells[order]
        known = np.unique(cells)
        lengths = lists.value_lengths().to_numpy()
        one, two = np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy()
        real = np.isin(two, known)
        visits_known = np.zeros((len(lengths), len(known)), bool)
        visits_known[one[real], np.searchsorted(known, two[real])] = True
        at_cell = np.searchsorted(known, cells)
        for start in range(0, len(wanted.ids), SLICE):
            part = slice(start, start + SLICE)
            best = Nearest(wanted.rows(part), k)
            for cut in range(0, len(rows.ids), BLOCK):
                tile = rows.rows(slice(cut, cut + BLOCK))
                seen = visits_known[part][:, at_cell[cut:cut + BLOCK]]
                if seen.any():
                    best.take(np.where(seen, _others(best.tile, tile), -np.inf), tile.ids)
            if len(best.row):
                yield _batch((best.tile.ids[best.row], best.near, best.score), kinds)

    return _best(held.unionByName(sent).groupBy("row", "query").applyInArrow(compare, schema), k)


def _sides(table: pa.Table) -> tuple[Block, Block]:
    """The queries and the rows of a group."""
    asked = table.column("asked").to_numpy()
    units = _matrix(table.column("unit"))
    every = Block(table.column("id").to_numpy(), units, units[:, :0], np.ones(len(asked), bool))
    return every.rows(asked), every.rows(~asked)


def _others(queries: Block, rows: Block) -> np.ndarray:
    """Cosines of queries with rows; no query finds itself."""
    scores = queries.units @ rows.units.T
    _, mine, own = np.intersect1d(queries.ids, rows.ids, return_indices=True)
    scores[mine, own] = -np.inf
    return scores


def exact(vectors: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """What `search` finds at best: queries against all rows, a block of each in a task."""

    def units(table: DataFrame, asked: bool) -> DataFrame:
        row = table.select(F.lit(asked).alias("asked"), "id", unit(F.col("vector")).alias("unit"))
        return row.where("unit is not null")

    rows, wanted = units(vectors, False), units(queries, True)
    id_type = rows.schema["id"].dataType.simpleString()
    row_blocks = max(1, -(-rows.count() // BLOCK))
    query_blocks = max(1, -(-wanted.count() // BLOCK))

    def spread(table: DataFrame, own: str, own_blocks: int, other: str, others: int) -> DataFrame:
        """Each row in a block of its own table, once for every block of the other one."""
        block = F.pmod(F.xxhash64("id"), F.lit(own_blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return table.withColumn(own, block).withColumn(other, every)

    met = spread(rows, "row", row_blocks, "query", query_blocks).unionByName(
        spread(wanted, "query", query_blocks, "row", row_blocks)
    )

    schema = f"id {id_type}, neighbour {id_type}, similarity double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        kinds = _kinds(schema, table.schema.field("id").type)
        wanted, rows = _sides(table)
        for start in range(0, len(wanted.ids) if len(rows.ids) else 0, SLICE):
            best = Nearest(wanted.rows(slice(start, start + SLICE)), k)
            best.take(_others(best.tile, rows), rows.ids)
            if len(best.row):
                yield _batch((best.tile.ids[best.row], best.near, best.score), kinds)

    return _best(met.groupBy("row", "query").applyInArrow(compare, schema), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= k)


def recall(found: DataFrame, best: DataFrame) -> DataFrame:
    """One row: queries, neighbours there are, and the share of them that was found. A found
    neighbour as near as the last of the best counts (ties)."""
    # Read twice, and the search behind it is the dearer part.
    last = written(
        best.groupBy("id").agg(F.min("similarity").alias("least"), F.count("*").alias("wanted")), "last"
    )
    hits = found.join(last, "id").groupBy("id").agg(F.count_if(F.col("similarity") >= F.col("least")).alias("hits"))
    return last.join(hits, "id", "left").agg(
        F.count("*").alias("queries"),
        F.sum("wanted").alias("neighbours"),
        (F.sum(F.least(F.coalesce("hits", F.lit(0)), "wanted")) / F.sum("wanted")).alias("recall"),
    )
