"""Best-fit packing of whole documents, by bin completion branch and bound.

Documents longer than a sequence are cut into full ones; the piece left over, or a shorter
document, is an item that stays whole. A block of documents is packed in the task that
tokenizes it, so there is no shuffle.

Within a block the largest item left opens a sequence, and the branches are the ways to
complete it: sets of items that fit beside it. A set is dominated, and left out, if its items
can be spread over the items of another one (that one leaves smaller items for later at no
loss; a best-fit trial shows most such cases). Sets come by the room they waste, least first, and of equal waste those of larger items
first, so that a set comes after all that dominate it. They are drawn one at a time, guided by
the sums that the items left can make.

Bounds prune. The first incumbent is the best-fit-decreasing packing. To beat an incumbent of
N sequences, a packing must not waste more than (N - 1) * capacity - tokens, so a branch ends
where what it wasted so far, and what the items left must waste, exceed that. What they must
waste follows from the items that are too large to meet each other. An incumbent that meets
the lower bound is a best packing.

The tree of thousands of items cannot be searched to its end, so a large block keeps its
best-fit packing and the search works on parts of it: the sequences that waste most, enough of
them to save one, with others drawn beside them. A part that can do with fewer sequences
is replaced, until PATIENCE parts in a row cannot. A part's search ends after it looked at
SEARCH sets for each of its items; a block small enough to be one part is packed at best, if the search
reaches its end before that. These limits choose between packings: every item is in each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import small_batches
from pagelens.llm.packing import tokens

CAPACITY = 1024
END = 2  # id that closes each document
BLOCK_TOKENS = 1 << 24
OUT_PIECES = 2_000  # pieces in a batch that a task hands on
SEARCH = 4  # sets looked at for each item of a part
PARTS = (20, 60, 200)  # sequences drawn to the wasteful ones of a part, in turn
PATIENCE = 12
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
    "offset long, ids binary"
)


# -- bounds ------------------------------------------------------------------------


def least_waste(counts: np.ndarray) -> int:
    """Room that any packing of the items must waste (counts[n] items of n tokens), besides
    what is left over in its last sequence.

    Items above capacity - k cannot meet items of k and more. For each k these large items
    have a sequence of their own each, filled at best by all items below k.
    """
    capacity = len(counts) - 1
    sizes, most = np.arange(capacity + 1), capacity // 2
    below = (counts[:most] * sizes[:most]).cumsum()  # tokens of items below k, for k from 1
    beside = (counts * sizes[::-1])[:most:-1].cumsum()[: len(below)]  # room beside those above
    return max(0, int((beside - below[: len(beside)]).max(initial=0)))


def least_sequences(counts: np.ndarray) -> int:
    """Lower bound on the sequences of a packing: items and what they must waste."""
    capacity = len(counts) - 1
    total = int((counts * np.arange(capacity + 1)).sum())
    return -(-(total + least_waste(counts)) // capacity)


# -- packings of item lengths ------------------------------------------------------


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing packing: each item to the fullest sequence with room for it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, sequence), in order
    for item in sorted(items, reverse=True):
        at = bisect_left(rooms, (item, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = capacity, len(bins)
            bins.append([])
        bins[number].append(item)
        if room > item:
            insort(rooms, (room - item, number))
    return bins


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the items of `other` can be seen to fit into the items of `one` (both descend):
    each into the smallest that has room for it."""
    rooms = list(one)
    for item in other:
        fitting = [i for i, room in enumerate(rooms) if room >= item]
        if not fitting:
            return False
        rooms[min(fitting, key=rooms.__getitem__)] -= item
    return True


def _sets(sizes: list[int], counts: np.ndarray, least: int, most: int) -> Iterator[tuple[int, ...]]:
    """Multisets of items with a sum of `most` down to `least`, larger items first within a
    sum. `sizes` descends. Bit s of reach[j] tells whether items from the j-th size on make s."""
    mask = (1 << (most + 1)) - 1
    reach = [1] * (len(sizes) + 1)
    for j in range(len(sizes) - 1, -1, -1):
        bits, size = reach[j + 1], sizes[j]
        for _ in range(min(int(counts[size]), most // size)):
            bits |= (bits << size) & mask
        reach[j] = bits
        if bits == mask:  # all sums can be made, with larger items as well
            reach[:j] = [mask] * j
            break

    def make(j: int, left: int) -> Iterator[tuple[int, ...]]:
        """Sets of sum `left` of sizes from j on; as deep as a set has different sizes."""
        if not left:
            yield ()
        while left and reach[j] >> left & 1:
            size = sizes[j]
            for taken in range(min(int(counts[size]), left // size), 0, -1):
                if reach[j + 1] >> (left - taken * size) & 1:
                    for rest in make(j + 1, left - taken * size):
                        yield (size,) * taken + rest
            j += 1

    for total in range(most, least - 1, -1):
        if reach[0] >> total & 1:
            yield from make(0, total)


def completions(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated sets of the items in `counts` that fit into `room`, least waste first; None
    for a set that was looked at and left out.

    The largest single item that fits dominates every set of no greater sum."""
    sizes = (np.flatnonzero(counts[: room + 1])[::-1]).tolist()
    if not sizes:
        yield ()
        return
    if sizes[0] == room:
        yield (room,)
        return
    known: list[tuple[int, ...]] = []
    for found in _sets(sizes, counts, sizes[0] + 1, room):
        if any(dominates(one, found) for one in known):
            yield None
        else:
            known.append(found)
            yield found
    single = (sizes[0],)
    if not any(dominates(one, single) for one in known):
        yield single


def pack(items: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """A packing of item lengths (each of 1 to capacity) into few sequences."""
    bins = best_fit(items, capacity)
    bound = least_sequences(np.bincount(items, minlength=capacity + 1)) if items else 0
    draw, failed = np.random.default_rng(len(items)), 0
    while len(bins) > bound and failed < PATIENCE:
        bins.sort(key=lambda b: (sum(b), b))
        waste = np.cumsum([capacity - sum(b) for b in bins])
        wasteful = int(np.searchsorted(waste, capacity)) + 1
        drawn = draw.permutation(np.arange(wasteful, len(bins)))[: PARTS[failed % len(PARTS)]]
        part = set(range(min(wasteful, len(bins)))) | set(drawn.tolist())
        before = [bins[i] for i in sorted(part)]
        after = complete(before, capacity)
        if len(after) < len(before):
            bins, failed = [b for i, b in enumerate(bins) if i not in part] + after, 0
        elif len(part) == len(bins):
            break
        else:
            failed += 1
    return bins


def complete(incumbent: list[list[int]], capacity: int = CAPACITY) -> list[list[int]]:
    """A packing of the items of `incumbent`, which is returned if no better one is found."""
    items = [size for held in incumbent for size in held]
    counts = np.bincount(items, minlength=capacity + 1)
    total, bound = sum(items), least_sequences(counts)
    spare = (len(incumbent) - 1) * capacity - total  # waste that still beats the incumbent
    left, wasted, budget = len(items), 0, SEARCH * len(items) + 1_000
    patience = tries = max(200, len(items) // 8)
    depth = 16
    # One entry for each open sequence: its largest item, its completions, the one in place.
    path: list[list] = []

    def open_next() -> None:
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        path.append([largest, completions(counts.copy(), capacity - largest), None])

    def take_back() -> None:
        nonlocal wasted, left
        largest, _, placed = path[-1]
        if placed is not None:
            wasted -= capacity - largest - sum(placed)
            left += 1 + len(placed)
            for size in placed:
                counts[size] += 1
            path[-1][2] = None

    if len(incumbent) > bound:
        open_next()
    while path and budget > 0:
        take_back()
        if tries <= 0:  # nothing better near the end: go on further up
            tries, keep = patience, len(path) - max(1, len(path) // depth)
            depth = depth // 2 if depth > 2 else 16
            while len(path) > max(1, keep):
                counts[path.pop()[0]] += 1
                take_back()
        top = path[-1]
        largest, options, _ = top
        chosen = None
        for chosen in options:
            budget, tries = budget - 1, tries - 1
            if chosen is not None or budget <= 0:
                break
        if chosen is None:
            counts[largest] += 1
            path.pop()
            continue
        for size in chosen:
            counts[size] -= 1
        left -= 1 + len(chosen)
        wasted += capacity - largest - sum(chosen)
        top[2] = chosen
        if not left:
            if len(path) < len(incumbent):
                incumbent = [[step[0], *step[2]] for step in path]
                if len(incumbent) <= bound:
                    break
                spare = (len(incumbent) - 1) * capacity - total
        elif len(path) < len(incumbent) - 1 and wasted <= spare:
            # What the items left must waste changes slowly, and is asked for now and then.
            if len(path) % 8 or wasted + least_waste(counts) <= spare:
                open_next()
    return incumbent


# -- documents ---------------------------------------------------------------------


def place(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(document, piece, start, length, sequence, offset) of every piece of a block.

    The first piece of a document takes what full ones leave of it, if anything."""
    pieces, sequence = [], 0
    by_length: dict[int, list[int]] = {}
    for doc, n in enumerate(lengths):
        first = n % capacity
        if first:
            by_length.setdefault(first, []).append(doc)
        for i in range(n // capacity):
            pieces.append((doc, i + (first > 0), first + i * capacity, capacity, sequence, 0))
            sequence += 1
    items = [n for n, held in by_length.items() for _ in held]
    for found in pack(items, capacity):
        offset = 0
        for n in found:
            pieces.append((by_length[n].pop(), 0, 0, n, sequence, offset))
            offset += n
        sequence += 1
    return pieces


def _packed_block(docs: list[tuple[int | None, bytes]], first: int) -> Iterator[pa.RecordBatch]:
    """Batches of the pieces of a block; its sequences are numbered from `first`."""
    names, kinds = zip(*(c.split() for c in PIECES.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]
    pieces = place([len(ids) // 4 for _, ids in docs])
    for cut in range(0, len(pieces), OUT_PIECES):
        rows = []
        for doc, piece, start, length, sequence, offset in pieces[cut : cut + OUT_PIECES]:
            key, ids = docs[doc]
            part = ids[4 * start : 4 * (start + length)]
            rows.append((key, piece, start, length, zlib.crc32(part), first + sequence, offset, part))
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 40  # a block has fewer sequences than tokens
    encode, end = tokens(), np.array([END], "<u4").tobytes()
    block, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = encode.ids(text.as_py() or "") + end
            block.append((key, ids))
            size += len(ids) // 4
            if size >= BLOCK_TOKENS:
                yield from _packed_block(block, first)
                first, block, size = first + size, [], 0
    if block:
        yield from _packed_block(block, first)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all rows of (doc_id, text): where each lies, in which sequence, its ids.

    Every row is a document, repeated ones too, and a null doc_id stays null; a null or empty
    text is its closing id alone. Documents of equal length are interchangeable: which of them
    goes where follows their order in the block. A very long text is full sequences and one
    item; a block ends with the text that fills it, so a task holds one block of
    BLOCK_TOKENS tokens and one text. Sequence numbers are unique and tell the partition; an
    unchanged input in unchanged splits is packed alike. An empty table gives an empty result.
    Columns other than these two are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pack_batches, PIECES
    )
