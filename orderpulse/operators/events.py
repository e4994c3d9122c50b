"""Aggregates of detector hits across days, in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.exprs import labels_where
from orderpulse.schemas import ORDER_ENTITY

DAY = "observation_date"


def normalize_hits(results: DataFrame, keys: Sequence[str] = ORDER_ENTITY) -> DataFrame:
    """Hits only, non-blank keys, one row per entity, day and detector."""
    ok = F.coalesce(F.col("hit_flag"), F.lit(False))
    for c in [*keys, "detector_id"]:
        ok &= F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    return results.where(ok & F.col(DAY).isNotNull()).select(*keys, DAY, "detector_id").dropDuplicates()


def event_aggregates(results: DataFrame, keys: Sequence[str] = ORDER_ENTITY) -> DataFrame:
    """One row per entity and hit day with current and cumulative counts and the set of detectors seen so far.

    The windows run over entity days (bounded by the calendar), not over single hits.
    """
    days = normalize_hits(results, keys).groupBy(*keys, DAY).agg(
        F.array_sort(F.collect_set("detector_id")).alias("ids")
    )
    so_far = Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return days.select(
        F.concat_ws("|", F.col(DAY).cast("string"), *keys).alias("detector_event_aggregate_id"),
        DAY,
        *keys,
        F.size("ids").alias("current_detector_count"),
        F.array_join("ids", "|").alias("current_detector_ids"),
        F.sum(F.size("ids")).over(so_far).alias("cumulative_hit_count"),
        F.count(F.lit(1)).over(so_far).alias("cumulative_hit_day_count"),
        # The running set holds detector names only: at most one entry per rule.
        F.array_join(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids").over(so_far)))), "|"
        ).alias("historical_detector_ids"),
        F.min(DAY).over(whole).alias("first_hit_date"),
        F.col(DAY).alias("last_hit_date"),
    )


def aggregate_range(results: DataFrame, start: str, end: str, keys: Sequence[str] = ORDER_ENTITY, detectors: Sequence[str] | None = None) -> DataFrame:
    """Aggregates over a range of days from published components: of each (day, detector) only the newest batch counts."""
    inside = results.where(F.col(DAY).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if detectors:
        inside = inside.where(F.col("detector_id").isin(list(detectors)))
    newest = inside.groupBy(DAY, "detector_id").agg(F.max("batch_id").alias("batch_id"))
    return event_aggregates(inside.join(newest, [DAY, "detector_id", "batch_id"], "left_semi"), keys)


def validate_aggregates(agg: DataFrame, keys: Sequence[str] = ORDER_ENTITY) -> DataFrame:
    """Counts of broken invariants: duplicate keys, wrong set sizes, history gaps, falling counters."""
    order = Window.partitionBy(*keys).orderBy(DAY)
    current, history = F.split("current_detector_ids", r"\|"), F.split("historical_detector_ids", r"\|")
    marked = agg.select(
        *keys, DAY, "current_detector_count",
        (F.size(current) != F.col("current_detector_count")).alias("_size"),
        (F.size(F.array_except(current, history)) > 0).alias("_subset"),
        *[
            F.coalesce(F.col(c) < F.lag(c).over(order), F.lit(False)).alias(f"_fall_{c}")
            for c in ("cumulative_hit_count", "cumulative_hit_day_count")
        ],
        "cumulative_hit_count",
    )
    duplicate = agg.groupBy(*keys, DAY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)))
    out = marked.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(*keys).alias("entity_count"),
        F.countDistinct(DAY).alias("observation_date_count"),
        F.sum("current_detector_count").alias("event_count"),
        F.max("cumulative_hit_count").alias("max_cumulative_hit_count"),
        F.count_if("_size").alias("wrong_current_count"),
        F.count_if("_subset").alias("current_not_in_history"),
        F.count_if(F.col("_fall_cumulative_hit_count") | F.col("_fall_cumulative_hit_day_count")).alias("falling_counters"),
    ).withColumn("duplicate_keys", duplicate.scalar())
    bad = ["wrong_current_count", "current_not_in_history", "falling_counters", "duplicate_keys"]
    return out.withColumn("failed_checks", F.array_join(labels_where([(F.col(c) > 0, c) for c in bad]), ","))


def filter_history(agg: DataFrame, detector: str, day: str, page: int = 1, size: int = 20) -> DataFrame:
    """Entities of a day whose history holds exactly this detector name, sorted and cut to one page."""
    member = F.array_contains(F.split("historical_detector_ids", r"\|"), detector)
    hits = agg.where(member & (F.col(DAY) == F.to_date(F.lit(day))))
    order = [F.desc("cumulative_hit_count"), F.asc("detector_event_aggregate_id")]
    return hits.orderBy(*order).offset((page - 1) * size).limit(size)


def merge_state(state: DataFrame | None, hits: DataFrame, keys: Sequence[str] = ORDER_ENTITY) -> DataFrame:
    """Entity counters after adding one day of hits; the batch form of the stream's keyed state."""
    day = normalize_hits(hits, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_hits"), F.collect_set("detector_id").alias("_ids"), F.max(DAY).alias("_day")
    )
    if state is None:
        return day.selectExpr(
            *keys, "_hits as cumulative_hit_count", "1L as cumulative_hit_day_count", "_ids as historical_ids",
            "_day as first_hit_date", "_day as last_hit_date",
        )
    joined = state.join(day, list(keys), "full")
    return joined.selectExpr(
        *keys,
        "coalesce(cumulative_hit_count, 0L) + coalesce(_hits, 0L) as cumulative_hit_count",
        "coalesce(cumulative_hit_day_count, 0L) + if(_day is null, 0L, 1L) as cumulative_hit_day_count",
        "array_union(coalesce(historical_ids, array()), coalesce(_ids, array())) as historical_ids",
        "coalesce(first_hit_date, _day) as first_hit_date", "coalesce(_day, last_hit_date) as last_hit_date",
    )
