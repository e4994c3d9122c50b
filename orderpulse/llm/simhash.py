"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared exactly tile by tile.

Words are the runs of characters other than ASCII white space after A-Z is lower-cased; a shingle is `size`
consecutive words joined by a space (fewer words: the whole sequence). A bit of the fingerprint is set if it is set in
over half of the shingles' XXH64 values.

Defined cases: a null or empty text has no shingles and the fingerprint zero, linked like any other; rows that repeat
each get a row; a null id is returned but is never the least id of a component unless it has only null ids (then
null); an empty table gives no rows; other columns are ignored by `fingerprints` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import components, forest, free_name, narrow, settle

RADIUS = 3
SEED = 42
#: Fingerprints in a tile, about; a tile is 128 kB and a pair of tiles is one task's unit of work.
TILE = 16384
#: Pairs of id and fingerprint that `dedup` may broadcast: about 100 bytes each, thus some 200 MB; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Shingles whose bits are counted at once.
_STEP = 65536


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    pairs = list(zip(starts, ends[size - 1:], strict=False)) if len(words) >= size else [(0, len(joined) + 1)]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, len(pairs), _STEP):
        raw = b"".join([digest(joined[a:z - 1], SEED) for a, z in pairs[k:k + _STEP]])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(pairs)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", size: int = 3) -> DataFrame:
    """All columns and the fingerprint in the long column `name`."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.withColumn(name, fp(F.col(text)))


def _counts(a: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts, high to low."""
    return np.stack([np.bitwise_count((a >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int16)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tile sorted by its parts' counts, the runs' bounds, and the counts of each run."""
    counts = _counts(a)
    order = np.lexsort(counts.T[::-1])
    a, counts = a[order], counts[order]
    new = np.flatnonzero(np.any(np.diff(counts, axis=0) != 0, axis=1)) + 1
    bounds = np.concatenate([[0], new, [len(a)]])
    return a, bounds, counts[bounds[:-1]]


def linked(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all pairs of the two tiles that differ in at most `radius` bits.

    Bits differ in at least as many places as population counts do, so runs whose counts differ by more are skipped.
    """
    a, at, ca = _runs(left)
    b, bt, cb = _runs(right)
    us, vs, held = [], [], 0
    for i in range(len(ca)):
        near = np.flatnonzero(np.abs(cb - ca[i]).sum(axis=1) <= radius)
        if not len(near):
            continue
        some = a[at[i]:at[i + 1]]
        other = np.concatenate([b[bt[j]:bt[j + 1]] for j in near])
        for k in range(0, len(some), max(1, 4_000_000 // len(other))):
            part = some[k:k + max(1, 4_000_000 // len(other))]
            x, y = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
            u, v = part[x], other[y]
            us.append(u[u != v])
            vs.append(v[u != v])
            held += len(us[-1])
            if held > 2_000_000:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], 0
    if not us:
        return a[:0], a[:0]
    return forest(np.concatenate(us), np.concatenate(vs))


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints (column fp) within the radius.

    Fingerprints fall into cells by the population counts of their halves, cells are cut into tiles by a hash, and
    every tile meets itself and the tiles of each cell near enough.
    """
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = fps.select("fp", high.alias("p"), low.alias("q"))
    count = cells.groupBy("p", "q").agg(F.ceil(F.count("*") / F.lit(tile)).alias("n"))
    # At most 33 x 33 cells.
    cut = cells.join(F.broadcast(count), ["p", "q"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("n")))
    tiles = settle(cut.groupBy("p", "q", "t").agg(F.collect_list("fp").alias("fps")), "tiles")
    names = tiles.select("p", "q", "t")
    steps = [(d, e) for d in range(radius + 1) for e in range(-radius, radius + 1) if abs(d) + abs(e) <= radius and (d, e) >= (0, 0)]
    near = F.explode(F.array(*[F.struct((F.col("p") + d).alias("p"), (F.col("q") + e).alias("q")) for d, e in steps]))
    ways = names.select(*[F.col(c).alias(f"{c}1") for c in "pqt"], near.alias("x")).select("p1", "q1", "t1", F.col("x.p").alias("p"), F.col("x.q").alias("q"))
    pairs = ways.join(names, ["p", "q"]).where("p1 <> p or q1 <> q or t1 <= t")
    full = pairs.join(tiles.select(*[F.col(c).alias(f"{c}1") for c in "pqt"], F.col("fps").alias("left")), ["p1", "q1", "t1"])
    full = full.join(tiles.withColumnRenamed("fps", "right"), ["p", "q", "t"])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for left, right in zip(frame["left"], frame["right"], strict=True):
                a, b = linked(np.asarray(left, np.int64).view(np.uint64), np.asarray(right, np.int64).view(np.uint64), radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return full.select("left", "right").mapInPandas(work, "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id", fp: str = "fp") -> DataFrame:
    """Rows (fp, component_id): the least id that links reach from a fingerprint's documents."""
    per = settle(docs.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least")), "fingerprints")
    found = components(links(per, radius, tile))
    named = per.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def dedup(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id") -> DataFrame:
    """One document of each group, that of the least id, with the columns of `docs`.

    A null id comes after all others; in a group of null ids only, each fingerprint keeps one. Of rows that share the
    least id the first by all columns stays. Which rows go is decided on ids and fingerprints; a text moves only where
    several rows share the least id, or where more than `BROADCAST_ROWS` pairs of id and fingerprint go.
    """
    fp, tied, rank = (free_name([*docs.columns, "_i", "_f"], x) for x in ("fp", "tied", "rank"))
    marked = settle(fingerprints(docs, name=fp), "fingerprinted")
    found = groups(marked, radius, tile, id_col, fp).toDF("f", "g")
    per = marked.groupBy(F.col(id_col).alias("i"), F.col(fp).alias("f")).agg(F.count("*").alias("n"))
    pairs = settle(per.join(found, "f").select("i", "f", F.when(F.col("i").isNull(), F.col("f")).alias("k"), "n", F.col("i").eqNullSafe(F.col("g")).alias("first")), "pairs")
    shared = pairs.where("first").groupBy("i", "k").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("i").alias("i2"), F.col("k").alias("k2"))
    ties = pairs.where("first").join(shared, F.col("i").eqNullSafe(F.col("i2")) & F.col("k").eqNullSafe(F.col("k2")), "left_semi")
    told = pairs.where("not first").unionAll(ties).select(F.col("i").alias("_i"), F.col("f").alias("_f"), F.col("first").alias(tied))
    told = narrow(settle(told, "told"), BROADCAST_ROWS)
    every = marked.join(told, marked[id_col].eqNullSafe(F.col("_i")) & (marked[fp] == F.col("_f")), "left")
    order = Window.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.col(fp))).orderBy(*[F.col(c) for c in docs.columns])
    chosen = every.where(F.col(tied)).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return every.where(F.col(tied).isNull()).select(*docs.columns).unionAll(chosen.select(*docs.columns))
