"""Packing by minimum bin slack: each window gets the multiset of remaining lengths that fills it closest.

A document's ids and its end id are cut into full windows and a rest. Rests are packed by length: the longest opens a
window, and a subset-sum dynamic programme over the lengths left, one bit for each sum, finds what comes closest to
its end; the counts are backtracked and the same multiset is used as often as the lengths last. Where nothing fits
exactly, the slack is filled by cutting a further rest, so a window is never padded; what is left of a partition at its
end, less than a window, goes into sequences of power-of-two lengths. Each partition is packed on its own.

Defined cases: a null or empty text is its end id alone; rows that repeat are packed as often as they come; a null id
is kept as it is; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import settle
from orderpulse.llm.tokens import encoder, slices, with_end

CAPACITY = 1024
#: Rests that a task holds before it packs what it can; a rest is less than a window.
HELD = 20_000

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, seq long, offset long, ids binary"


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length (`lengths` falling) sum as close to `room` as can be without passing it."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, copies = min(counts[n], room // n), 1
        while left > 0:
            copies = min(copies, left)
            layers.append((n, copies, reach))
            reach |= (reach << (n * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for n, copies, before in reversed(layers):
        if not before >> total & 1:
            chosen[n] += copies
            total -= n * copies
    return dict(chosen)


class Packer:
    """Packs rests (row, start, ids) of one partition; finished pieces are (row, start, ids, seq, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.seq, self.total = capacity, 0, 0
        self.rests: dict[int, deque] = defaultdict(deque)
        self.done: list[tuple] = []

    def add(self, row: tuple, start: int, ids: np.ndarray) -> None:
        self.rests[len(ids)].append((row, start, ids))
        self.total += len(ids)

    def full(self, row: tuple, start: int, ids: np.ndarray) -> None:
        self.done.append((row, start, ids, self.seq, 0))
        self.seq += 1

    def _take(self, n: int) -> tuple:
        rest = self.rests[n].popleft()
        if not self.rests[n]:
            del self.rests[n]
        self.total -= n
        return rest

    def _cut(self, size: int) -> tuple:
        """The first `size` ids of the longest rest; the others stay a rest."""
        n = max(self.rests)
        row, start, ids = self._take(n)
        if n > size:
            self.add(row, start + size, ids[size:])
        return row, start, ids[:size]

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for row, start, ids in pieces:
            self.done.append((row, start, ids, self.seq, offset))
            offset += len(ids)
        self.seq += 1

    def pack(self, keep: int = 0) -> None:
        """Full windows until less than one, or fewer than `keep` rests, is left."""
        while self.total >= self.capacity and sum(map(len, self.rests.values())) >= keep:
            order = sorted(self.rests, reverse=True)
            first = order[0]
            counts = {n: len(self.rests[n]) - (n == first) for n in order}
            chosen = best_fill(order, counts, self.capacity - first)
            slack = self.capacity - first - sum(n * k for n, k in chosen.items())
            use = dict(chosen)
            use[first] = use.get(first, 0) + 1
            for _ in range(min(len(self.rests[n]) // k for n, k in use.items()) if not slack else 1):
                pieces = [self._take(n) for n, k in use.items() for _ in range(k)]
                left = slack
                while left:
                    pieces.append(self._cut(min(left, max(self.rests))))
                    left -= len(pieces[-1][2])
                self._place(pieces)

    def finish(self) -> None:
        self.pack()
        while self.total:
            size = 1 << (self.total.bit_length() - 1)
            pieces, left = [], size
            while left:
                pieces.append(self._cut(min(left, max(self.rests))))
                left -= len(pieces[-1][2])
            self._place(pieces)


def pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, with_ids: bool = False, prefixed: bool = True) -> DataFrame:
    """Rows of `_SCHEMA` for each piece: part and seq name its sequence, ids are little-endian 32-bit numbers if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, part = encoder(path, prefixed), Packer(capacity), TaskContext.get().partitionId()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset", "ids"]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def out() -> pa.RecordBatch:
            cols = [[] for _ in range(9)]
            for (doc, tokens), start, ids, seq, offset in packer.done:
                raw = ids.astype("<u4").tobytes()
                for c, x in zip(cols, (doc, start, len(ids), zlib.crc32(raw), tokens, part, seq, offset, raw if with_ids else None), strict=True):
                    c.append(x)
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        held = 0
        for batch in slices(batches):
            flat, lengths = with_end(*enc.encode(batch.column("text")), end)
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist(), strict=True):
                ids, row = flat[at:at + n], (doc, n)
                at += n
                for k in range(0, n - n % capacity, capacity):
                    packer.full(row, k, ids[k:k + capacity])
                if n % capacity:
                    packer.add(row, n - n % capacity, ids[n - n % capacity:].copy())
                    held += 1
                if held >= HELD:
                    packer.pack(HELD // 10)
                    held = sum(map(len, packer.rests.values()))
                    yield out()
            yield out()
        packer.finish()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(work, _SCHEMA)


def pack(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, with_ids: bool = False, prefixed: bool = True) -> DataFrame:
    """The pieces with sequence_id, numbered over all partitions; the pieces are written once and read again."""
    found = settle(pieces(docs, path, end, capacity, with_ids, prefixed), "pieces")
    # One row for each task that made pieces.
    sizes = found.groupBy("part").agg((F.max("seq") + 1).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = found.join(before, "part")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("seq")).alias("sequence_id"), "offset", *["ids"] * with_ids)
