"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines inside the buckets.

Vectors are scaled to length one, so that a cosine c is the distance sqrt(2 - 2c). Each of `tables` tables concatenates
`projections` numbers floor((a.x + b) / width) with normal a and uniform b. With the defaults, a pair at cosine 0.98
(distance 0.2) shares a bucket of at least one table with probability 0.9998, closer pairs with more; orthogonal ones
meet in a table with probability 4e-5. Buckets of one class are dropped before vectors move, larger ones than `BLOCK`
are cut into blocks that meet pairwise; a pair that meets in several tables counts in the first.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without label or id, link
with nothing; vectors of different lengths don't link; equal vectors of a label are one class and link with each other;
rows that repeat count as further vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import components, forest, settle

COSINE = 0.98
PROJECTIONS, TABLES, WIDTH, SEED = 14, 24, 2.0, 17
#: Classes of a bucket that meet in one block, at most about.
BLOCK = 4096
#: Rows of a block whose cosines with the other block are held at once.
_ROWS = 256


def hyperplanes(dim: int, projections: int = PROJECTIONS, tables: int = TABLES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and the odd numbers that fold a table's projections into one."""
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, projections * tables)), rng.uniform(0, width, projections * tables), rng.integers(1, 1 << 63, projections, dtype=np.int64) | 1


def signatures(units: np.ndarray, projections: int = PROJECTIONS, tables: int = TABLES, width: float = WIDTH) -> np.ndarray:
    """A bucket number for each row and table."""
    a, b, odd = hyperplanes(units.shape[1], projections, tables, width)
    cells = np.floor((units @ a + b) / width).astype(np.int64).reshape(len(units), tables, projections)
    return (cells * odd).sum(axis=2)


def classes(vectors: DataFrame) -> DataFrame:
    """Equal usable vectors of a label: class_id, label, embedding, least, size; written once, so that ids stay."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.exists(x, lambda v: v != 0)
    usable &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    same = vectors.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    return settle(same.withColumn("class_id", F.monotonically_increasing_id()), "classes")


def signed(found: DataFrame) -> DataFrame:
    """class_id, label, size, dim, unit (the scaled vector) and sig (a bucket number for each table)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            dims = np.diff(np.asarray(lists.offsets))
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                rows = batch.take(pa.array(some))
                x = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("class_id"), rows.column("label").cast(pa.int64()), rows.column("size"), pa.array(np.full(len(some), dim, np.int32)), _lists(x, pa.float64()), _lists(signatures(x), pa.int64())],
                    ["class_id", "label", "size", "dim", "unit", "sig"],
                )

    return settle(found.select("class_id", "label", "size", "embedding").mapInArrow(work, "class_id long, label long, size long, dim int, unit array<double>, sig array<long>"), "signed")


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def meet(ids: np.ndarray, units: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows `left` and `right` that met in no earlier table: id, vectors linked, an id of its group."""
    same = left is right
    links, us, vs = np.zeros(len(ids), np.int64), [], []
    for k in range(0, len(left), _ROWS):
        rows = left[k:k + _ROWS]
        x, y = np.nonzero(units[rows] @ units[right].T >= cosine)
        u, v = rows[x], right[y]
        keep = u < v if same else u != v
        u, v = u[keep], v[keep]
        for t in range(table):
            if not len(u):
                break
            new = sigs[u, t] != sigs[v, t]
            u, v = u[new], v[new]
        np.add.at(links, u, sizes[v])
        np.add.at(links, v, sizes[u])
        if len(u):
            a, b = forest(u, v)
            us.append(a)
            vs.append(b)
    if not us:
        return ids[:0], links[:0], ids[:0]
    a, b = forest(np.concatenate(us), np.concatenate(vs))
    root = np.arange(len(ids))
    root[a] = b
    some = np.flatnonzero(links)
    return ids[some], links[some], ids[root[some]]


def links(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Rows (class_id, n, peer): vectors newly linked to a class in one block, and a class of its group there."""
    met = rows.select("class_id", "label", "dim", F.posexplode("sig").alias("t", "bucket"))
    key = ["label", "dim", "t", "bucket"]
    shared = met.groupBy(*key).count().where("count > 1")
    slim = met.join(shared, key).withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    # A block meets itself and every other one; both sides of a meeting get the same name (lower, upper).
    dealt = slim.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "class_id", "t", "bucket", "own", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"))
    name = ["label", "t", "bucket", "lower", "upper"]
    full = dealt.join(rows, "class_id").select("dim", *name, "own", "class_id", "size", "unit", "sig")
    placed = full.repartition("dim", *name).sortWithinPartitions("dim", *name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group: pa.Table) -> pa.RecordBatch:
            group = group.combine_chunks()
            n = group.num_rows
            column = lambda c: group.column(c).combine_chunks()
            flat = lambda c: column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            own, lower, upper = column("own").to_numpy(), column("lower")[0].as_py(), column("upper")[0].as_py()
            left = np.flatnonzero(own == lower)
            right = left if lower == upper else np.flatnonzero(own == upper)
            got = meet(column("class_id").to_numpy(), flat("unit"), flat("sig"), column("size").to_numpy(), left, right, column("t")[0].as_py(), cosine)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["class_id", "n", "peer"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", *name)])
            cuts = [0, *(np.flatnonzero(np.any(np.diff(keys, axis=1) != 0, axis=0)) + 1), batch.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(keys[:, a])
                if held and here != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, z - a))
                last = here
        if held:
            yield solve(pa.Table.from_batches(held))

    return placed.mapInArrow(work, "class_id long, n long, peer long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id."""
    same = classes(vectors.select("vec_id", "embedding", "label"))
    found = settle(links(signed(same), cosine, block), "links")
    counted = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "class_id")
    named = same.join(counted, "class_id", "left").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    done = named.join(least, "root").select("label", "embedding", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = vectors.select("vec_id", "label", "embedding").join(done, ["label", "embedding"], "left")
    alone = F.col("vec_id").isNull()
    return joined.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(~alone, F.coalesce("component_id", "vec_id")).alias("component_id"))
