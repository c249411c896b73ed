"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is estimated as n + n*n/QUADRATIC: the linear layers and
the attention within the piece. Documents are cut into full sequences as long as they fill
one; what remains of each goes, in descending length, to the sequence of least cost that
still has room for it. What fits nowhere whole is cut over the sequences of least cost with
room left.

Packing is done in blocks of documents, in the task that tokenizes them, so there is no
shuffle and a task holds one block. The sequences of a block have as much room in sum as
the block has tokens: as many full ones as the tokens fill, and for the rest sequences of
powers of two, which need no padding either.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import small_batches

CAPACITY = 2048
END = 1  # id that closes each document
QUADRATIC = 1024.0  # length at which attention costs as much as the linear layers
BLOCK_TOKENS = 1 << 20
CACHED = 300_000
SPECIAL = "<|endoftext|>"
_OPEN_SPACE = re.compile(r" (?:\s|\Z)")  # a space that may belong to a longer token
VOCABULARY = "byte_bpe_50k"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


# -- tokens ------------------------------------------------------------------------


class Parts(dict):
    """Ids by part of a text, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        got = self.encode(" " + part)
        if len(self) >= CACHED:
            self.clear()
        if len(part) <= 64:
            self[part] = got
        return got


class Tokens:
    """Ids of texts under the byte-level vocabulary, equal to those of its tokenizers file.

    No token spans a space that is followed by a character other than white space, so texts
    are cut there and the ids of the parts are kept in a bounded table: running text repeats
    its words.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            VOCABULARY, pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)}
        )
        self.parts = Parts(self._encode)

    def _encode(self, text: str) -> bytes:
        if SPECIAL in text:
            ids = self.encoding.encode(text, allowed_special="all")
        else:
            ids = self.encoding.encode_ordinary(text)
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if _OPEN_SPACE.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self.parts.__getitem__, rest))


@lru_cache(maxsize=1)
def tokens(ranks_path: str | None = None) -> Tokens:
    """The tokenizer of a task; the path of the vocabulary is a parameter."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path(f"{VOCABULARY}.tiktoken")
    return Tokens(path, public_tokenizers.PATTERN)


# -- packing -----------------------------------------------------------------------


def cost(length: int) -> float:
    return length + length * length / QUADRATIC


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Rooms that sum up to `total`: full sequences, then powers of two."""
    rest = total % capacity
    powers = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    return [capacity] * (total // capacity) + powers


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a block's documents."""
    full = [n // capacity for n in lengths]
    pieces = []
    sequence = 0
    for doc, count in enumerate(full):
        for i in range(count):
            pieces.append((doc, i * capacity, capacity, sequence, 0))
            sequence += 1
    rest = sorted(
        ((n % capacity, doc) for doc, n in enumerate(lengths) if n % capacity),
        key=lambda x: (-x[0], x[1]),
    )
    room = capacities(sum(n for n, _ in rest), capacity)
    costs, left = np.zeros(len(room)), np.array(room, np.int64)

    def put(doc: int, start: int, length: int, at: int) -> None:
        pieces.append((doc, start, length, sequence + at, room[at] - int(left[at])))
        left[at] -= length
        costs[at] += cost(length)

    cut = []
    for n, doc in rest:
        open_costs = np.where(left >= n, costs, np.inf)
        at = int(open_costs.argmin())
        if open_costs[at] == np.inf:
            cut.append((n, doc))
        else:
            put(doc, lengths[doc] - n, n, at)
    heap = [(float(costs[s]), s) for s in range(len(room)) if left[s]]
    heapq.heapify(heap)
    for n, doc in cut:
        start = lengths[doc] - n
        while n:
            _, at = heapq.heappop(heap)
            length = min(n, int(left[at]))
            put(doc, start, length, at)
            start, n = start + length, n - length
            if left[at]:
                heapq.heappush(heap, (float(costs[at]), at))
    return pieces


def _pack_block(docs: list[tuple[int | None, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
    lengths = [len(ids) // 4 for _, ids in docs]
    pieces = sorted(pack(lengths), key=lambda p: (p[3], p[4]))
    rows: list[list] = [[] for _ in range(8)]
    for doc, start, length, sequence, offset in pieces:
        key, ids = docs[doc]
        part = ids[4 * start : 4 * (start + length)]
        for column, value in zip(
            rows,
            (key, start, length, zlib.crc32(part), lengths[doc], first + sequence, offset, part),
            strict=True,
        ):
            column.append(value)
    arrays = [pa.array(c, pa.int64()) for c in rows[:7]] + [pa.array(rows[7], pa.binary())]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays(arrays, names), 1 + max(p[3] for p in pieces)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 40
    encode, end = tokens(), np.array([END], "<u4").tobytes()
    block, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = encode.ids(text.as_py() or "") + end
            block.append((key, ids))
            size += len(ids) // 4
            if size >= BLOCK_TOKENS:
                out, used = _pack_block(block, first)
                first, block, size = first + used, [], 0
                yield out
    if block:
        yield _pack_block(block, first)[0]


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all rows of (doc_id, text): where each lies, in which sequence, its ids.

    Every row is a document, repeated ones too; a null or empty text is its closing id
    alone. Sequence numbers are unique and tell the partition; an unchanged input in
    unchanged splits is packed alike. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pack_batches, PIECES
    )
