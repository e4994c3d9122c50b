"""Session settings that hold from local[8] to a large cluster."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Reliable checkpoints are compressed, and removed once nothing refers to them.
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "orderpulse", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder shared by all executors; a private one is made only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    local = spark.sparkContext.getCheckpointDir()
    if local:
        return local
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="orderpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))


#: Spark removes the shuffle files of an execution when it ends; else they stay until the driver collects its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of input files for each slice of a large frame, and the most slices: every slice reads the input again.
SLICE_BYTES, MOST_SLICES = 64 << 20, 4


@contextmanager
def sweeping(spark: SparkSession) -> Iterator[None]:
    """Frames made and written inside remove their shuffle files when they have run."""
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def cut_lineage(df):
    """Reliable checkpoint: survives the loss of executors, and nothing of its shuffles is left on disk."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    with sweeping(spark):
        df = df.select("*")
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, by their statistics; a table read twice counts twice."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for x in map(leaves.apply, range(leaves.size())) if x.nodeName() == "LogicalRelation"]
    return sum(int(x.stats().sizeInBytes()) for x in files)


def slices(df: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """A frame that reads large files as parts by the hash of its keys, to be run one after the other.

    Every row is in one part, null keys among them; rows of one key are in the same part.
    """
    n = min(MOST_SLICES, math.ceil(input_bytes(df) / SLICE_BYTES))
    if n < 2:
        return [df]
    part = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [df.where(part == k) for k in range(n)]


def stored(frames: Iterable[DataFrame], spark: SparkSession) -> tuple[DataFrame, str]:
    """Frames of one schema written one after the other to a Parquet folder that all executors share, and its path."""
    path, schema = f"{checkpoint_dir(spark).rstrip('/')}/orderpulse/rows-{uuid.uuid4().hex}", None
    for df in frames:
        schema = schema or df.schema
        with sweeping(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that `stored` has made."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
