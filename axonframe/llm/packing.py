"""Best-fit packing by bin completion: branch and bound over undominated fillings.

Documents are cut only where they exceed a sequence. Full pieces are sequences by themselves;
the others are dealt out by a hash, so that every group sees the same mixture of lengths, and
packed in blocks of ``block`` pieces. There are as many groups as whole blocks, whatever the
session's partitions: the packing depends on the documents alone.

1. best-fit decreasing gives the incumbent;
2. the waste bound: total space of one sequence fewer than the incumbent, less the tokens to
   place, is the waste a better packing may have; if it is negative the incumbent is optimal;
3. else sequences are completed one by one around the largest piece left. The fillings of the
   space beside it are enumerated by length (equal lengths are one choice), those dominated by
   another (a larger piece would fit in place of a smaller one) left out, the fullest first, and
   a branch ends as soon as its waste exceeds what is left. ``nodes`` bounds the search, not the
   result: the incumbent is always a whole packing.

A block's emptiest sequences are taken up again with the next block of the group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import arrow_batches, written
from axonframe.llm.tokens import encoder, ids_crc32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def best_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Indices per sequence; each piece goes where it leaves the least space."""
    spaces: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(spaces, (lengths[i], -1))
        if at == len(spaces):
            bins.append([i])
            insort(spaces, (room - lengths[i], len(bins) - 1))
        else:
            space, b = spaces.pop(at)
            bins[b].append(i)
            insort(spaces, (space - lengths[i], b))
    return bins


class Lengths:
    """Counts of the lengths left, and which of them there are, in order."""

    def __init__(self, lengths: list[int]) -> None:
        self.counts = Counter(lengths)
        self.sizes = sorted(self.counts)

    def take(self, filling: tuple[int, ...]) -> None:
        for n in filling:
            self.counts[n] -= 1
            if not self.counts[n]:
                del self.sizes[bisect_left(self.sizes, n)]

    def put_back(self, filling: tuple[int, ...]) -> None:
        for n in filling:
            if not self.counts[n]:
                insort(self.sizes, n)
            self.counts[n] += 1


def fillings(space: int, left: Lengths, limit: int) -> list[tuple[int, ...]]:
    """Undominated multisets of the lengths left that fit into ``space``, fullest first."""
    counts, sizes = left.counts, left.sizes
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 8 * limit

    def grow(below: int, rest: int, taken: dict[int, int]) -> bool:
        """Fillings of lengths under ``below``; True once nothing better can come or the steps are used up."""
        nonlocal steps
        steps -= 1
        for k in range(bisect_right(sizes, min(rest, below - 1)) - 1, -1, -1):
            size = sizes[k]
            for m in range(min(counts[size], rest // size), 0, -1):
                if grow(size, rest - m * size, {**taken, size: m}):
                    return True
        if undominated(taken, rest):
            found.append((rest, tuple(s for s, m in taken.items() for _ in range(m))))
        # A filling without waste dominates the others as far as space goes.
        return len(found) >= limit or rest == 0 or steps <= 0

    def undominated(taken: dict[int, int], rest: int) -> bool:
        # No unused piece fits as well, neither added nor in place of a smaller one.
        for s in [0, *taken]:
            for k in range(bisect_right(sizes, s + rest) - 1, -1, -1):
                if sizes[k] <= s:
                    break
                if taken.get(sizes[k], 0) < counts[sizes[k]]:
                    return False
        return True

    grow(space + 1, space, {})
    return [taken for _, taken in sorted(found, key=lambda f: (f[0], [-s for s in f[1]]))]


def complete(lengths: list[int], room: int, nodes: int = 3000, choices: int = 24) -> list[list[int]]:
    """Indices per sequence, never more sequences than best-fit decreasing makes."""
    incumbent = best_fit_decreasing(lengths, room)
    spare = (len(incumbent) - 1) * room - sum(lengths)
    if not lengths or spare < 0:
        return incumbent
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    left = Lengths(lengths)

    def options() -> Iterator[tuple[int, ...]]:
        largest = (left.sizes[-1],)
        left.take(largest)
        beside = fillings(room - largest[0], left, choices)
        left.put_back(largest)
        return iter([largest + f for f in beside or [()]])

    # Depth first without recursion: each level holds the fillings yet to try and the waste so far.
    levels, chosen = [(options(), 0)], []
    while levels and nodes:
        filling = next(levels[-1][0], None)
        if filling is None:
            levels.pop()
            if chosen:
                left.put_back(chosen.pop())
            continue
        nodes -= 1
        waste = levels[-1][1] + room - sum(filling)
        if waste > spare:
            continue
        left.take(filling)
        chosen.append(filling)
        if not left.sizes:
            return [[by_length[n].pop() for n in filling] for filling in chosen]
        levels.append((options(), waste))
    return incumbent


def cut(docs: DataFrame, vocabulary: str, room: int, end_id: int) -> DataFrame:
    """Pieces of at most ``room`` tokens; no text moves."""
    arrow_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        stop = enc.one(end_id)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, own in zip(batch["doc_id"].to_pylist(), enc.encode_all(batch["text"].to_pylist()), strict=True):
                ids = np.frombuffer(own + stop, enc.dtype)
                for k, at in enumerate(range(0, len(ids), room)):
                    part = ids[at : at + room]
                    out.append((doc_id, k, at, len(part), ids_crc32(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 0, block: int = 4096, nodes: int = 3000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the end id. Rows are packed each for itself, equal
    or null doc_ids too. An empty table gives an empty result.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple] = []

        def placed(last: bool) -> pa.RecordBatch:
            nonlocal held, number
            full = [i for i, row in enumerate(held) if row[3] == room]
            rest = [i for i, row in enumerate(held) if row[3] < room]
            bins = [[rest[i] for i in b] for b in complete([held[i][3] for i in rest], room, nodes)]
            keep: list[tuple] = []
            if not last:
                bins.sort(key=lambda b: -sum(held[i][3] for i in b))
                later = bins[len(bins) - len(bins) // 8 :]
                bins = bins[: len(bins) - len(later)]
                keep = [held[i] for b in later for i in b]
            out = []
            for b in [[i] for i in full] + bins:
                at = 0
                for i in b:
                    out.append((*held[i], number, at))
                    at += held[i][3]
                number += 1
            held = keep
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            while len(held) >= 2 * block:
                rows, held = held[block:], held[:block]
                yield placed(False)
                held += rows
        if held:
            yield placed(True)

    # Written once, small rows: their count gives the number of groups, a block's pieces or more in each.
    pieces = written(cut(docs, vocabulary, room, end_id), "pieces")
    groups = max(1, pieces.filter(F.col("length") < room).count() // block)
    # The order inside a group follows a hash too: the same after a lost task, mixed lengths in a block.
    dealt = F.xxhash64("doc_id", "piece", "ids_crc32")
    place = F.pmod(F.xxhash64(dealt), F.lit(groups)).cast("int")
    return pieces.repartitionById(groups, place).sortWithinPartitions(dealt, "doc_id", "piece", "length").mapInArrow(packed, PACKED)
