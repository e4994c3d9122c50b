"""Labels, label closure, temporal splits and training frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.exprs import add_months_end, case, date_array, explode_dates, null_safe_join
from orderpulse.schemas import ENTITY, HORIZONS

KEY = [*ENTITY, "cutoff_month"]


def alive_labels(candidates: DataFrame, events: DataFrame, cutoffs: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Alive when the entity buys in any month of (cutoff, cutoff + H].

    The first purchase month after each cutoff decides all horizons; months are repeated only for the cutoffs
    whose longest window can see them.
    """
    longest = max(horizons)
    months = events.select(*ENTITY, "purchase_month").distinct()
    near = F.filter(
        date_array(cutoffs), lambda c: (c < F.col("purchase_month")) & (F.col("purchase_month") <= F.last_day(F.add_months(c, longest)))
    )
    nxt = months.withColumn("cutoff_month", F.explode(near)).groupBy(*KEY).agg(F.min("purchase_month").alias("_next"))
    joined = null_safe_join(candidates, nxt, KEY)
    out = {}
    for h in horizons:
        alive = F.coalesce((F.col("_next") <= add_months_end("cutoff_month", h)).cast("int"), F.lit(0))
        out[f"label_alive_H{h}"] = alive
        out[f"label_die_H{h}"] = 1 - alive
    return joined.withColumns(out).drop("_next")


def with_closure(labels: DataFrame, events: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """A label counts only when its whole window lies inside the observed months."""
    last = events.agg(F.max("purchase_month")).scalar()
    staged = labels.withColumn("_last", last)
    return staged.withColumns(
        {f"label_window_closed_H{h}": add_months_end("cutoff_month", h) <= F.col("_last") for h in horizons}
    ).drop("_last")


def closure_audit(labels: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for h in horizons:
        closed, die = F.col(f"label_window_closed_H{h}"), F.col(f"label_die_H{h}")
        aggs += [F.count_if(closed).alias(f"c{h}"), F.sum(F.when(closed, die)).alias(f"d{h}")]
    rows = [
        F.struct(
            F.lit(f"H{h}").alias("horizon"), F.col("n").alias("row_count"), F.col(f"c{h}").alias("closed_label_rows"),
            F.coalesce(f"d{h}", F.lit(0)).alias("die_count_closed"),
            (F.col(f"d{h}") / F.nullif(F.col(f"c{h}"), F.lit(0))).alias("positive_rate_closed"),
        )
        for h in horizons
    ]
    return labels.agg(*aggs).select(F.inline(F.array(*rows)))


def long_labels(wide: DataFrame, keep: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per entity, cutoff and horizon with label and closure flag."""
    rows = [
        F.struct(
            F.lit(f"H{h}").alias("horizon"), F.col(f"label_alive_H{h}").alias("label_alive"),
            F.col(f"label_die_H{h}").alias("label_die"), F.col(f"label_window_closed_H{h}").alias("label_window_closed"),
        )
        for h in horizons
    ]
    return wide.select(*keep, F.inline(F.array(*rows)))


def churn_in_days(orders: DataFrame, origins: Sequence[str], days: int, unit: Sequence[str], max_date: str | None = None) -> DataFrame:
    """1 when a unit seen by the origin buys nothing in the next `days`; unknown when the window is not complete."""
    eff = orders.where("purchase_qty > 0 and coalesce(void_qty, 0) = 0").dropna(subset=list(unit))
    per_day = eff.groupBy(*unit, "order_date").agg(F.count(F.lit(1)).alias("n"))
    # A purchase serves the origins before it as future and the origins after it as history.
    marked = per_day.withColumn("origin_date", F.explode(date_array(origins)))
    future = f"order_date > origin_date and order_date <= date_add(origin_date, {days})"
    agg = marked.groupBy("origin_date", *unit).agg(
        F.expr("count_if(order_date <= origin_date) as seen"), F.expr(f"coalesce(sum(if({future}, n, null)), 0) as future_purchase_count")
    ).where("seen > 0")
    last = F.to_date(F.lit(max_date)) if max_date else orders.agg(F.max("order_date")).scalar()
    known = F.date_add("origin_date", days) <= F.col("_last")
    return agg.withColumn("_last", last).withColumns(
        {
            "label_churn_H": F.when(known, F.when(F.col("future_purchase_count") > 0, 0).otherwise(1)),
            "label_status": F.when(known, "known").otherwise("label_unknown"),
        }
    ).drop("_last", "seen")


def first_purchase_samples(events: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """First purchase per entity, second purchase time, repeat labels and delivery rates."""
    days = events.groupBy(*ENTITY, "purchase_time").agg(
        F.min(
            F.struct(
                "order_detail_id", "row_uid", "raw_sensitive_purchase_quantity", "raw_sensitive_purchase_amount",
                "raw_sensitive_delivery_quantity", "raw_sensitive_arrival_quantity", "drug_category_code", "province_code",
                "hospital_level_code",
            )
        ).alias("row")
    )
    # Days per entity are bounded by the calendar; the second day is the lead of the first.
    w = Window.partitionBy(*ENTITY).orderBy("purchase_time")
    first = days.select(
        *ENTITY, "purchase_time", "row", F.row_number().over(w).alias("_i"), F.lead("purchase_time").over(w).alias("second_purchase_time")
    ).where("_i = 1")
    out = first.selectExpr(
        *ENTITY, "purchase_time as first_purchase_time", "last_day(purchase_time) as first_purchase_month", "second_purchase_time",
        "row.raw_sensitive_purchase_quantity as first_purchase_quantity", "row.raw_sensitive_purchase_amount as first_purchase_amount",
        "row.drug_category_code", "row.province_code", "row.hospital_level_code",
        "row.raw_sensitive_delivery_quantity / nullif(row.raw_sensitive_purchase_quantity, 0D) as delivery_rate",
        "row.raw_sensitive_arrival_quantity / nullif(row.raw_sensitive_purchase_quantity, 0D) as arrival_rate",
        "greatest(row.raw_sensitive_delivery_quantity - row.raw_sensitive_arrival_quantity, 0D) as return_quantity",
    )
    last = events.agg(F.max("purchase_time")).scalar()
    out = out.withColumn("_last", last)
    cols: dict[str, Column] = {}
    for h in horizons:
        end = F.add_months("first_purchase_time", h)
        closed = end <= F.col("_last")
        cols[f"label_window_end_H{h}"] = end
        cols[f"label_window_closed_H{h}"] = closed
        cols[f"label_repeat_H{h}"] = F.when(closed, F.coalesce((F.col("second_purchase_time") <= end).cast("int"), F.lit(0)))
    return out.withColumns(cols).drop("_last")


def purged_split(
    labels: DataFrame, train_end: str, valid_end: str, test_end: str, horizon: Column | str = "horizon",
) -> DataFrame:
    """train / valid / test by cutoff month, with the months whose label window crosses a border set aside."""
    h = F.substring(F.col(horizon) if isinstance(horizon, str) else horizon, 2, 3).cast("int")
    cutoff, window_end = F.col("cutoff_month"), F.last_day(F.add_months("cutoff_month", h))
    t, v, e = (F.to_date(F.lit(x)) for x in (train_end, valid_end, test_end))
    return labels.withColumn(
        "split",
        case(
            [
                (window_end <= t, "train"), (cutoff <= t, "purge"), (window_end <= v, "valid"), (cutoff <= v, "purge"),
                (cutoff <= e, "test"),
            ],
            "unused",
        ),
    )


def split_audit(split: DataFrame) -> DataFrame:
    return split.groupBy("horizon", "split").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("cutoff_month").alias("cutoff_count"),
        F.countDistinct("entity_id").alias("entity_count"), F.sum("label_die").alias("positive_count"),
        F.min("cutoff_month").alias("cutoff_min"), F.max("cutoff_month").alias("cutoff_max"),
    )


def split_by_month(samples: DataFrame, month: str, train_end: str, fallback: float = 0.75) -> DataFrame:
    """Train through a month; if one side would be empty, cut at the 75% point of the sorted months."""
    months = samples.select(F.col(month).alias("_m")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("_m")
    ordered = months.withColumns({"_i": F.row_number().over(w), "_k": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    picked = ordered.agg(
        F.expr(f"max(if(_i = greatest(1, cast(floor(_k * {fallback}) as int)), _m, null))").alias("cut"),
        F.expr(f"count_if(_m <= date'{train_end}')").alias("before"), F.expr(f"count_if(_m > date'{train_end}')").alias("after"),
    )
    border = picked.select(F.expr(f"if(before > 0 and after > 0, date'{train_end}', cut)")).scalar()
    return samples.withColumn("_border", border).withColumn(
        "split", F.when(F.col(month) <= F.col("_border"), "train").otherwise("test")
    ).drop("_border")


def holdout_window(cutoff: str, horizon_months: int, grace_months: int = 0) -> dict[str, Column]:
    """Bounds of the evaluation window after a cutoff, as expressions."""
    c = F.to_date(F.lit(cutoff))
    return {
        "train_end": c,
        "holdout_start": F.date_add(F.add_months(c, grace_months), 1),
        "holdout_end": F.add_months(c, grace_months + horizon_months),
    }


def walk_forward_dates(spark, start: str, end: str, step_days: int) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {step_days} days)")).alias("origin_date")
    )


def training_frame(features: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Origin features with their known labels."""
    return features.join(labels.where("label_status = 'known'").select(*on, "label_churn_H"), list(on))


def label_key_check(features: DataFrame, labels: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """Rows on one side only; both counts must be zero."""
    f, lab = features.select(*on).distinct(), labels.select(*on).distinct()
    a = f.join(lab, list(on), "left_anti").agg(F.count(F.lit(1)).alias("features_without_label"))
    b = lab.join(f, list(on), "left_anti").agg(F.count(F.lit(1)))
    return a.withColumn("labels_without_features", b.scalar())


def scope_flags(features: DataFrame, min_count: int = 3, min_active: int = 2) -> DataFrame:
    n, a = F.col("purchase_count_asof_cutoff"), F.col("active_month_count_asof_cutoff")
    return features.withColumn(
        "scope", case([((n >= min_count) & (a >= min_active), "recurring"), (n == 1, "one_shot")], "low_history")
    )


def trainability(labels: DataFrame, split: dict[str, Sequence[str]], min_rows: int = 100, min_positive: int = 20) -> DataFrame:
    """Rows, entities and positives per horizon and split; missing cutoffs; gate."""
    wanted = [(s, c) for s, cs in split.items() for c in cs]
    spark = labels.sparkSession
    rows = ", ".join(f"named_struct('split', '{s}', 'cutoff_month', date'{c}')" for s, c in wanted)
    dim = spark.range(1).selectExpr(f"inline(array({rows}))")
    joined = labels.where("label_window_closed").join(dim, "cutoff_month")
    agg = joined.groupBy("horizon", "split").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("entity_id").alias("entity_count"),
        F.sum("label_die").alias("positive_count"), F.countDistinct("cutoff_month").alias("cutoffs_present"),
    )
    need = F.element_at(F.create_map(*[F.lit(x) for s, cs in split.items() for x in (s, len(cs))]), F.col("split"))
    return agg.withColumn("cutoffs_missing", need - F.col("cutoffs_present")).withColumn(
        "gate",
        F.when(
            (F.col("cutoffs_missing") == 0) & (F.col("row_count") >= min_rows) & (F.col("positive_count") >= min_positive), "trainable"
        ).otherwise("blocked"),
    )


def definition_stress(long: DataFrame) -> DataFrame:
    """Label counts and rates per shape and horizon under four policies of what to leave out."""
    policies = {
        "current": "true",
        "exclude_lumpy": "demand_shape_label <> 'lumpy'",
        "exclude_intermittent_short_horizon": "not (demand_shape_label = 'intermittent' and horizon = 'H3')",
        "exclude_low_history": "purchase_count_asof_cutoff >= 3",
    }
    closed = long.where("label_window_closed")
    aggs = []
    for name, cond in policies.items():
        aggs += [F.expr(f"count_if({cond}) as n_{name}"), F.expr(f"sum(if({cond}, label_die, 0)) as d_{name}")]
    wide = closed.groupBy("demand_shape_label", "horizon").agg(F.count(F.lit(1)).alias("total"), *aggs)
    rows = ", ".join(
        f"""named_struct('policy', '{p}', 'kept_rows', n_{p}, 'affected_rows', total - n_{p}, 'positive_count', d_{p},
            'die_rate', d_{p} / nullif(n_{p}, 0))"""
        for p in policies
    )
    return wide.selectExpr("demand_shape_label", "horizon", f"inline(array({rows}))")
