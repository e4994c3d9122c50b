"""Token-ID files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

For each id, what last followed the two ids before it (order 2) and the one before it (order 1) is predicted. How sure
both are, and whether they agree, picks the adaptive odds of order 2 being right, of order 1 being right, and of
neither; in the last case order 0 codes the id itself by its share of the segment's ids. Those shares are the segment's
table, written once in front of its blocks with a checksum of its own. All that drives one 64-bit range coder. A block
starts from the table alone and keeps its own state, so blocks are coded side by side, one id of each at a time, in
numpy arrays; a block can be read alone and its checksum tells whether it is whole.

Defined cases: a null or empty text is its end id alone; documents of equal id are in order of their texts; null ids
come first; an empty table gives an empty file; other columns are ignored, whatever their names; a table of shares or a
block whose ids don't fit its checksum raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import settle
from orderpulse.llm.tokens import encoder, slices, with_end

#: Ids of a block, blocks coded side by side, and ids after which a segment ends with its document.
BLOCK, LANES = 4096, 2048
SEGMENT = BLOCK * LANES
#: Ids must be below this bound: a range of 2^32 then still parts the rarest id, as order 0 has 64 of 4096 shares at least.
BOUND = 1 << 19
_U, _I = np.uint64, np.int64
_SLOTS1, _SLOTS2 = 1024, 2048
#: Bits of the sum of a table's shares: the fewest, the most, and those beyond the number of its ids.
_LEAST_BITS, _MOST_BITS, _MORE_BITS = 16, 21, 5
_ONE = 4096
#: The odds approach these bounds, never 0 or 1, so that every case keeps a share of the range.
_SELDOM, _OFTEN2, _OFTEN1 = 32, 3840, 3072
_LEAST, _LOW = _U(1 << 32), _U((1 << 32) - 1)
_12, _32 = _U(12), _U(32)
#: By order: slots, bits of a place that are dropped, and what its odds approach when it is right.
_MASKS, _SHIFTS = np.array([[_SLOTS1 - 1], [_SLOTS2 - 1]]), np.array([[4], [3]])
_OFTEN = np.array([[_OFTEN1], [_OFTEN2]])
#: Rows of a matrix whose places in the tables are found at once.
_ROWS = 64


class Table:
    """Order 0: the share of each id, an integer of at least 1 for those that occur; the shares sum to 2^bits."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, bits: int):
        self.ids, self.shares, self.bits = ids.astype(_I), shares.astype(_I), bits
        bound = int(self.ids[-1]) + 1 if len(ids) else 0
        self.share, self.below = np.zeros(bound, _I), np.zeros(bound, _I)
        self.share[self.ids], self.below[self.ids] = self.shares, np.cumsum(self.shares) - self.shares

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        """Shares in proportion to counts; `ids` ascend."""
        bits = min(max(len(ids).bit_length() + _MORE_BITS, _LEAST_BITS), _MOST_BITS)
        counts = counts.astype(np.float64)
        shares = 1 + (counts * (((1 << bits) - len(ids)) / counts.sum())).astype(_I)
        shares[np.argmax(shares)] += (1 << bits) - shares.sum()
        return cls(ids, shares, bits)

    @classmethod
    def plain(cls) -> Table:
        """Shares for ids of which nothing is known: every id can be coded, those of 16 bits are likelier."""
        ids = np.arange(BOUND)
        return cls.of(ids, np.where(ids < 1 << 16, 1.0, 0.001))

    def dump(self) -> bytes:
        """Steps between ids, then shares, byte planes apart."""
        both = np.concatenate([np.diff(self.ids, prepend=0), self.shares]).astype("<u4")
        return bytes([self.bits]) + zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 9)

    @classmethod
    def load(cls, raw: bytes) -> Table:
        planes = np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(4, -1)
        both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(_I)
        half = len(both) // 2
        return cls(np.cumsum(both[:half]), both[half:], raw[0])


class Model:
    """The adaptive state of `lanes` blocks; row 0 of a pair of rows is order 1, row 1 order 2."""

    def __init__(self, lanes: int):
        rows = np.arange(lanes)
        self.slot, self.state = np.stack([rows * _SLOTS1, lanes * _SLOTS1 + rows * _SLOTS2]), (rows * 32).astype(np.int32)
        # Where both orders predict the same.
        self.agreed = self.state + np.int32(16)
        # What followed: (id + 1) * 4 + confidence.
        self.after = np.zeros(lanes * (_SLOTS1 + _SLOTS2), np.int32)
        self.odds, self.part = np.full(lanes * 64, _ONE // 4, _I), np.array([[0], [lanes * 32]], np.int32)

    def places(self, last1: np.ndarray, last2: np.ndarray) -> np.ndarray:
        """Where the tables hold what followed the last id and the last two, of the first lanes or of rows of them."""
        at = np.empty((*last1.shape[:-1], 2, last1.shape[-1]), _I)
        np.multiply(last1, 40503, out=at[..., 0, :])
        np.multiply(last2, 25717, out=at[..., 1, :])
        at[..., 1, :] += at[..., 0, :]
        at >>= _SHIFTS
        at &= _MASKS
        at += self.slot[:, :last1.shape[-1]]
        return at

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictions of the first k lanes, both orders; the share f2 of order 2 and f2 + f1 of both."""
        k = at.shape[1]
        self.at, self.e = at, self.after[at]
        e1, e2 = self.e
        self.c = self.e & 3
        mixed = self.c[1] << 2
        mixed += self.c[0]
        mixed += np.where((e1 ^ e2) < 4, self.agreed[:k], self.state[:k])
        self.here = np.add(self.part, mixed, dtype=_I)
        self.f = self.odds[self.here]
        f2 = self.f[1]
        both = _ONE - f2
        both *= self.f[0]
        both >>= 12
        both += f2
        return self.e, f2, both

    def update(self, coded: np.ndarray, same: np.ndarray) -> None:
        """coded: (id + 1) * 4; same: which ids the orders predicted."""
        step = np.where(same, _OFTEN, _SELDOM)
        step -= self.f
        step >>= 5
        # Order 1 has no say where order 2 is right.
        step[0] *= ~same[1]
        step += self.f
        self.odds[self.here] = step
        sure = self.c > 0
        self.after[self.at] = np.where(same, self.e + (self.c < 3), np.where(sure, self.e - 1, coded))


def _settle(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes whose upper word is decided, or whose range must be cut to decide it; their lower ends and widths."""
    go = (width < _LEAST).nonzero()[0]
    l, w = low[go], width[go]
    cut = ((l ^ (l + w)) >= _LEAST).nonzero()[0]
    if len(cut):
        w[cut] = (~l[cut] + _U(1)) & _LOW
    return go, l, w


def encode(blocks: list[np.ndarray], table: Table | None = None) -> list[bytes]:
    """Each block of ids as bytes, by the shares of a table that knows all of them."""
    table = table or Table.plain()
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    found: list[bytes] = [b""] * len(blocks)
    for a in range(0, len(order), LANES):
        mine = order[a:a + LANES]
        for k, raw in zip(mine, _encode([blocks[k] for k in mine], table), strict=True):
            found[k] = raw
    return found


def _matrix(blocks: list[np.ndarray], longest: int) -> np.ndarray:
    """Row t holds the ids at place t of all blocks."""
    ids = np.zeros((len(blocks), longest), np.int32)
    for k, b in enumerate(blocks):
        if len(b) and int(b.max()) >= BOUND:
            raise ValueError(f"ids must be below {BOUND}")
        ids[k, :len(b)] = b
    return np.ascontiguousarray(ids.T)


def _encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Blocks of falling lengths."""
    lanes, longest = len(blocks), len(blocks[0])
    sizes = np.array([len(b) for b in blocks])
    ids = _matrix(blocks, longest)
    lacks = table.share == 0
    if any(len(b) and (int(b.max()) >= len(lacks) or lacks[b].any()) for b in blocks):
        raise ValueError("the table of shares lacks an id")
    model, shift = Model(lanes), _U(table.bits)
    share0, below0 = table.share.view(_U), table.below.view(_U)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    space = longest * 3 // 2 + 8
    out, end = np.zeros(lanes * space, np.uint32), np.arange(lanes) * space
    before = np.zeros((2, lanes), np.int32)
    for first in range(0, longest, _ROWS):
        rows = ids[first:first + _ROWS]
        past = np.concatenate([before, rows])
        before = past[-2:]
        # Past a block's end stands 0, which the table may lack.
        places, shares, belows, codes = model.places(past[1:-1], past[:-2]), share0[rows], below0[rows], (rows + 1) * 4
        for t, at, coded, s0, b0 in zip(range(first, longest), places, codes, shares, belows):
            if sizes[-1] <= t:
                k = int(np.searchsorted(-sizes, -t))
                at, coded, s0, b0 = at[:, :k], coded[:k], s0[:k], b0[:k]
            k = len(coded)
            e, f2, both = model.predict(at)
            same = (e ^ coded) < 4
            same1, same2 = same
            begin = np.where(same2, 0, np.where(same1, f2, both))
            share = np.where(same2, f2, np.where(same1, both, _ONE))
            share -= begin
            w = width[:k] >> _12
            l = w * begin.view(_U)
            l += low[:k]
            w *= share.view(_U)
            plain = ~(same1 | same2)
            part = w >> shift
            w = np.where(plain, part * s0, w)
            part *= b0
            part *= plain
            l += part
            go, lg, wg = _settle(l, w)
            to = end[go]
            out[to] = lg >> _32
            end[go] = to + 1
            l[go], w[go] = lg << _32, wg << _32
            low[:k], width[:k] = l, w
            model.update(coded, same)
    out[end], out[end + 1] = low >> _32, low & _LOW
    return [out[k * space:end[k] + 2].astype("<u4").tobytes() for k in range(lanes)]


def decode(blocks: list[bytes], sizes: list[int], table: Table | None = None) -> list[np.ndarray]:
    """The ids of each block, by the table it was coded with."""
    table = table or Table.plain()
    order = sorted(range(len(blocks)), key=lambda k: -sizes[k])
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for a in range(0, len(order), LANES):
        mine = order[a:a + LANES]
        for k, ids in zip(mine, _decode([blocks[k] for k in mine], np.array([sizes[k] for k in mine]), table), strict=True):
            found[k] = ids
    return found


def _decode(blocks: list[bytes], sizes: np.ndarray, table: Table) -> list[np.ndarray]:
    lanes, longest = len(blocks), int(sizes[0])
    space = max(len(b) for b in blocks) // 4 + 3
    data = np.zeros((lanes, space), np.uint32)
    for k, b in enumerate(blocks):
        data[k, :len(b) // 4] = np.frombuffer(b, "<u4")
    data, at = data.ravel(), np.arange(lanes) * space
    last = at + space - 1
    ids = np.zeros((longest, lanes), np.int32)
    model, shift = Model(lanes), _U(table.bits)
    both0, most = (table.below << 32 | table.share).view(_U), _U((1 << table.bits) - 1)
    owner = np.repeat(table.ids.astype(np.min_scalar_type(len(table.share))), table.shares)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    value = data[at].astype(_U) << _32 | data[at + 1].astype(_U)
    at = at + 2
    last1 = last2 = np.zeros(lanes, _I)
    for t in range(longest):
        k = lanes if sizes[-1] > t else int(np.searchsorted(-sizes, -t))
        e, f2, both = model.predict(model.places(last1[:k], last2[:k]))
        w = width[:k] >> _12
        l, v = low[:k], value[:k]
        off = v - l
        in2, known = off < w * f2.view(_U), off < w * both.view(_U)
        begin = np.where(in2, 0, np.where(known, f2, both))
        share = np.where(in2, f2, np.where(known, both, _ONE))
        share -= begin
        l = l + w * begin.view(_U)
        w *= share.view(_U)
        x = (np.where(in2, e[1], e[0]) >> 2) - 1
        plain = (~known).nonzero()[0]
        lp, part = l[plain], w[plain] >> shift
        y = owner[np.minimum((v[plain] - lp) // part, most).view(_I)]
        own = both0[y]
        l[plain], w[plain], x[plain] = lp + part * (own >> _32), part * (own & _LOW), y
        go, lg, wg = _settle(l, w)
        here = at[go]
        value[go] = value[go] << _32 | data[np.minimum(here, last[go])]
        at[go] = here + 1
        l[go], w[go] = lg << _32, wg << _32
        low[:k], width[:k] = l, w
        ids[t, :k] = x
        coded = (x + 1) << 2
        model.update(coded, (e ^ coded) < 4)
        last1, last2 = x, last1
    ids = np.ascontiguousarray(ids.T).astype(np.uint32)
    return [ids[k, :n].copy() for k, n in enumerate(sizes)]


_FILE = "file int, segment long, first long, doc_ids array<long>, sizes array<long>, head struct<crc:long,data:binary>, blocks array<struct<n:int,crc:long,data:binary>>"


def write(docs: DataFrame, path: str, end: int, prefixed: bool = False) -> DataFrame:
    """The token files of the documents in ascending order of doc_id, written once: rows of `_FILE`, one per segment."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = keyed.select("doc_id", "text", order[1].alias("_h"), order[2].alias("_i")).repartitionByRange("doc_id", "_h", "_i").sortWithinPartitions("doc_id", "_h", "_i")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, segment = encoder(path, prefixed), TaskContext.get().partitionId(), 0
        ids, sizes, held, total, before = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(held)
            blocks = [flat[k:k + BLOCK] for k in range(0, len(flat), BLOCK)]
            counts = np.bincount(flat)
            table = Table.of(known := counts.nonzero()[0], counts[known])
            head = table.dump()
            coded = [{"n": len(b), "crc": zlib.crc32(b.astype("<u4").tobytes()), "data": d} for b, d in zip(blocks, encode(blocks, table), strict=True)]
            kind = pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("data", pa.binary())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([segment], pa.int64()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([{"crc": zlib.crc32(head), "data": head}], pa.struct([("crc", pa.int64()), ("data", pa.binary())])), pa.array([coded], kind)],
                ["file", "segment", "first", "doc_ids", "sizes", "head", "blocks"],
            )

        for batch in slices(batches):
            flat, lengths = with_end(*enc.encode(batch.column("text")), end)
            names, at = batch.column("doc_id").to_pylist(), np.concatenate([[0], np.cumsum(lengths)])
            first = 0
            while first < len(names):
                # As many documents as fill the segment, one at least.
                last = max(first + 1, int(np.searchsorted(at, at[first] + SEGMENT - total, side="left")))
                last = min(last, len(names))
                held.append(flat[at[first]:at[last]].copy())
                ids += names[first:last]
                sizes += lengths[first:last].tolist()
                total += int(at[last] - at[first])
                first = last
                if total >= SEGMENT:
                    yield row()
                    segment, before, ids, sizes, held, total = segment + 1, before + total, [], [], [], 0
        if ids:
            yield row()

    return settle(dealt.select("doc_id", "text").mapInArrow(work, _FILE), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Rows (file, segment, place, doc_id, start, n_tokens, ids): every document, start counted over all files."""
    totals = files.select("file", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    # One row for each task that wrote a file.
    begin = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("begin"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                file, segment, names, sizes, head, blocks = (row.column(c)[0] for c in ("file", "segment", "doc_ids", "sizes", "head", "blocks"))
                first = row.column("first")[0].as_py()
                parts, head = blocks.values, head.as_py()
                if zlib.crc32(head["data"]) != head["crc"]:
                    raise ValueError(f"file {file}, segment {segment}: the table of shares doesn't fit its checksum")
                found = decode([d.as_buffer().to_pybytes() for d in parts.field("data")], parts.field("n").to_pylist(), Table.load(head["data"]))
                for number, (ids, crc) in enumerate(zip(found, parts.field("crc").to_pylist(), strict=True)):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                        raise ValueError(f"file {file}, segment {segment}, block {number}: the ids don't fit the checksum")
                flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
                n = np.array(sizes.as_py(), np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                raw = flat.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * len(n), pa.int32()), pa.array([segment.as_py()] * len(n), pa.int64()), names.values, pa.array(at[:-1] + first), pa.array(n), pa.array([raw[4 * a:4 * z] for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["file", "segment", "doc_id", "place", "n_tokens", "ids"],
                )

    decoded = files.select("file", "segment", "first", "doc_ids", "sizes", "head", "blocks").mapInArrow(work, "file int, segment long, doc_id long, place long, n_tokens long, ids binary")
    return decoded.join(F.broadcast(begin), "file").select("file", "segment", "doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids")
