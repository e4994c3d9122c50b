"""Token counts by separator scan: documents of flat unindexed token files, found by their end id.

A file is nothing but ids of fixed width, cut into blocks by its size alone. Tasks read the bytes of their blocks, each
of which is searched at once; what is left over at its bounds
is stitched by a prefix scan over the blocks' sums (ids, ends, last end), first inside groups of blocks, then over the
groups, so that no task holds a file's blocks. Every end closes a document; ids after the last end of a file are a
document that is not ended.

Defined cases: an empty text is its end alone; null texts count as empty; a file without ids has no documents; ids that
are no whole number at a file's end raise an error; rows that repeat are documents of their own; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import settle, shared_path
from orderpulse.llm.tokens import encoder, slices, with_end

#: Ids of a block, and blocks of a group of the scan.
BLOCK, GROUP = 1 << 18, 1024


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:/x or file:///x, hdfs://, s3a://, ...), and its own path."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def write_flat(docs: DataFrame, path: str, end: int, block: int = BLOCK, prefixed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Flat token files of the documents in the shared folder, one for each partition: blocks (file, block, ids) as
    `read_flat` finds them there, and the documents' names (file, ordinal, doc_id) in their order.

    The files hold little-endian ids and nothing else. Special tokens in a text are ordinary text, so that only document
    ends give the end id. What an attempt of a task left that didn't finish is not read.
    """
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_path(spark, "flat"))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = store.makeQualified(folder)
    store.mkdirs(folder)
    target = folder.toString()
    width = 2 if max(encoder(path, prefixed, True).dtype(0).itemsize * 8, end.bit_length()) <= 16 else 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc, file, ordinal, out = encoder(path, prefixed, True), task.partitionId(), 0, None
        name = f"{file}-{task.taskAttemptId()}.bin"
        kind = pa.schema([("file", pa.int32()), ("at", pa.int64()), ("name", pa.string()), ("doc_id", pa.int64())])
        store, at = _filesystem(f"{target}/{name}")
        for batch in slices(batches):
            out = out or store.open_output_stream(at)
            flat, lengths = enc.encode(batch.column("text"))
            flat, _ = with_end(flat.astype(f"<u{width}", copy=False), lengths, end)
            out.write(np.ascontiguousarray(flat))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int32()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.nulls(n, pa.string()), batch.column("doc_id")], schema=kind)
            ordinal += n
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([0], pa.int64()), pa.array([name]), pa.nulls(1, pa.int64())], schema=kind)

    written = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "file int, at long, name string, doc_id long"), "names")
    done = written.where("name is not null").select(F.col("file").cast("string").alias("file"), "name")
    files = flat_files(spark, target).withColumn("name", F.element_at(F.split("path", "/"), -1)).join(done, "name").select("file", "path", "length")
    return scan_flat(files, width, block), written.where("name is null").select(F.col("file").cast("string").alias("file"), F.col("at").alias("ordinal"), "doc_id")


def flat_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows (path, length) of files of any size; nothing of their content is read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")


def scan_flat(files: DataFrame, width: int = 4, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, ids) of flat files (file, path, length) of little-endian ids of `width` bytes. Blocks are
    dealt to all tasks, and each task reads the bytes of its own blocks only."""
    step = block * width
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = files.select("file", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            for file, path, length, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{path} holds {length} bytes, no whole number of ids of {width} bytes")
                if path != opened:
                    if source is not None:
                        source.close()
                    store, at = _filesystem(path)
                    opened, source = path, store.open_input_file(at)
                size = min(step, length - number * step)
                raw = source.read_at(size, number * step)
                if len(raw) != size:
                    raise ValueError(f"{path} gave {len(raw)} bytes of {size} at {number * step}")
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4", copy=False)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["file", "block", "ids"])
        if source is not None:
            source.close()

    return each.repartition(spread, "path", "block").sortWithinPartitions("path", "block").mapInArrow(work, "file string, block long, ids binary")


def read_flat(spark: SparkSession, paths: list[str] | str, width: int = 4, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, ids) of flat binary files of little-endian ids of `width` bytes, of any size."""
    return scan_flat(flat_files(spark, paths).select(F.col("path").alias("file"), "path", "length"), width, block)


def documents(blocks: DataFrame, end: int) -> DataFrame:
    """Rows (file, ordinal, start, n_tokens, ended) of all documents of the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                found.append(np.flatnonzero(ids == end))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["file", "block", "size", "ends"])

    found = settle(blocks.select("file", "block", "ids").mapInArrow(work, "file string, block long, size long, ends array<long>"), "ends")
    sums = found.select("file", "block", "size", F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    sums = sums.withColumn("part", F.floor(F.col("block") / GROUP))
    before = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ids0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inner = inner.withColumn("last", F.col("ids0") + F.col("last"))
    inner = inner.withColumn("last0", F.max("last").over(before))
    parts = inner.groupBy("file", "part").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max("last").alias("last"))
    ahead = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    outer = parts.select("file", "part", "last", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ids1"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n1"))
    outer = outer.withColumn("last1", F.max(F.col("ids1") + F.col("last")).over(ahead)).drop("last")
    placed = inner.join(outer, ["file", "part"]).select(
        "file", "block", (F.col("ids0") + F.col("ids1")).alias("at"), (F.col("n0") + F.col("n1")).alias("first"),
        F.coalesce(F.col("last0") + F.col("ids1"), F.col("last1"), F.lit(-1)).alias("previous"),
    )
    each = found.join(placed, ["file", "block"]).select("file", "at", "first", "previous", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") > 0, F.col("at") + F.get("ends", F.col("k") - 1)).otherwise(F.col("previous")) + 1
    ended = each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), begin.alias("start"), (F.col("at") + F.col("end") + 1 - begin).alias("n_tokens"), F.lit(True).alias("ended"))
    files = parts.groupBy("file").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    last = outer.join(parts.select("file", "part", "last"), ["file", "part"]).groupBy("file").agg(F.max(F.coalesce(F.col("ids1") + F.col("last"), F.lit(-1))).alias("last"))
    rest = files.join(last, "file").where("last + 1 < size").select("file", F.col("n").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)
