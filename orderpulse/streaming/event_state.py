"""Detector hits as a stream: watermark deduplication and keyed counters per entity."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orderpulse.session import checkpoint_dir

#: Days of an entity with their detectors, and how often rows were issued.
STATE_SCHEMA = "days string, revision long"


def output_schema(keys: Sequence[str]) -> str:
    return (
        ", ".join(f"{k} string" for k in keys)
        + ", observation_date string, current_detector_count long, current_detector_ids string,"
        " cumulative_hit_count long, cumulative_hit_day_count long, historical_detector_ids string,"
        " first_hit_date string, last_hit_date string, revision long"
    )


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge the hits of this micro-batch into the entity's days and issue the days they change.

    A part of a day, whenever it comes, joins that day; the day and those after it are issued again under a higher
    revision, so no hit is lost and `latest_rows` gives what one batch over all hits gives. The state holds the names
    of the detectors of each hit day: the calendar and the number of rules bound it.
    """
    days, revision = state.get if state.exists else ("{}", 0)
    held = {day: set(ids) for day, ids in json.loads(days).items()}
    changed = None
    for pdf in frames:
        for day, ids in pdf.groupby("observation_date")["detector_id"]:
            day, new = str(day), set(ids.unique())
            if not new <= held.get(day, set()):
                held.setdefault(day, set()).update(new)
                changed = day if changed is None else min(day, changed)
    rows = []
    if changed is not None:
        revision, hits, seen, order = revision + 1, 0, set(), sorted(held)
        for number, day in enumerate(order, 1):
            hits += len(held[day])
            seen |= held[day]
            if day >= changed:
                rows.append((*key, day, len(held[day]), "|".join(sorted(held[day])), hits, number, "|".join(sorted(seen)), order[0], day, revision))
        state.update((json.dumps({day: sorted(ids) for day, ids in held.items()}), revision))
    yield pd.DataFrame(rows)


def _advance_named(columns: list[str]):
    def run(key, frames, state):
        for out in _advance(key, frames, state):
            out = out if len(out) else pd.DataFrame(columns=range(len(columns)))
            out.columns = columns
            yield out

    return run


def hit_stream(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Hits with the duplicates of (entity, day, detector) that arrive within the watermark removed."""
    return (
        stream.where(F.coalesce(F.col("hit_flag"), F.lit(False)))
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([*keys, "observation_date", "detector_id"])
    )


def aggregate_stream(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per entity and hit day, issued again whenever a hit changes them; `latest_rows` keeps the valid ones."""
    columns = [*keys, "observation_date", *[c.split()[0] for c in output_schema([]).strip(", ").split(", ")[1:]]]
    narrow = hits.where(F.coalesce(F.col("hit_flag"), F.lit(False))).select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        F.col("observation_date").cast("string").alias("observation_date"), "detector_id",
    )
    return narrow.groupBy(*keys).applyInPandasWithState(
        _advance_named(columns), output_schema(keys), STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def latest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the highest revision for each entity and day."""
    rest = [c for c in rows.columns if c not in (*keys, "observation_date", "revision")]
    best = rows.groupBy(*keys, "observation_date").agg(F.max(F.struct("revision", *rest)).alias("best"))
    return best.select(*keys, "observation_date", *[F.col(f"best.{c}").alias(c) for c in rest])


def run_available(stream: DataFrame, mode: str = "append", work: str | None = None) -> DataFrame:
    """Process all waiting input into a Parquet table below `work`, by default beside the checkpoints, and read it back."""
    spark: SparkSession = stream.sparkSession
    work = work or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{work}/table")
        .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/table")
