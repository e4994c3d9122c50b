"""Purchase events, entity-month facts, purchase sequences and monthly entity bases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.exprs import case, entity_id, explode_horizons, month_end, null_safe_join
from orderpulse.operators.cleaning import failure_flag, terminal_flag
from orderpulse.schemas import DAYS_PER_MONTH, ENTITY, HORIZONS, STATIC_COLUMNS
from orderpulse.session import cut_lineage, slices

STATUS = ["order_phase_code", "delivery_state_code", "order_failure_flag"]


def purchase_events(orders: DataFrame, drug_group: str = "drug_code") -> DataFrame:
    """One row per valid purchase: non-null time and non-blank id; zero quantities stay."""
    have = set(orders.columns)

    def number(*names: str) -> Column:
        for n in names:
            if n in have:
                return F.expr(f"try_cast({n} as double)")
        return F.lit(None).cast("double")

    valid = F.col("order_date").isNotNull() & (F.length(F.coalesce(F.col("order_id"), F.lit(""))) > 0)
    return orders.where(valid).select(
        F.col("row_uid") if "row_uid" in have else F.col("order_id").alias("row_uid"),
        F.col("order_id").alias("order_detail_id"),
        "manufacturer_code",
        "hospital_code",
        "drug_code",
        F.col(drug_group).cast("string").alias("drug_group"),
        F.lit(drug_group).alias("drug_group_source"),
        *[
            F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c)
            for c in STATIC_COLUMNS
        ],
        F.col("order_date").alias("purchase_time"),
        month_end("order_date").alias("purchase_month"),
        number("raw_sensitive_purchase_quantity", "order_quantity").alias("raw_sensitive_purchase_quantity"),
        number("raw_sensitive_purchase_amount", "order_amount").alias("raw_sensitive_purchase_amount"),
        number("raw_sensitive_delivery_quantity", "delivery_quantity").alias("raw_sensitive_delivery_quantity"),
        number("raw_sensitive_arrival_quantity", "arrival_quantity").alias("raw_sensitive_arrival_quantity"),
        number("order_phase_code", "order_status").alias("order_phase_code"),
        number("delivery_state_code", "delivery_status").alias("delivery_state_code"),
        failure_flag(orders).alias("order_failure_flag"),
        terminal_flag(orders).alias("order_terminal_flag"),
    )


def entity_month(events: DataFrame) -> DataFrame:
    """Counts, sums, status counts, first static attributes and last status per entity and month.

    Every column is an aggregate with a map-side partial, so a hot entity is reduced before the shuffle.
    """
    return _read_structs(_month_parts(events))


def settled_entity_month(events: DataFrame, attributes: bool = True) -> DataFrame:
    """`entity_month` written once, for frames that read it several times.

    Events of large files are reduced in slices of orders, one after the other, and the months of the slices put
    together: the disk holds the shuffles of one slice. Without `attributes`, for readers of counts and sums alone, no
    static attribute or status is looked for: they are null.
    """
    left_out = [] if attributes else [*STATIC_COLUMNS, "_last"]
    parts = [cut_lineage(_month_parts(part).drop(*left_out)) for part in slices(events, ["order_detail_id"])]
    months = parts[0] if len(parts) == 1 else cut_lineage(_merged_months(reduce(DataFrame.unionByName, parts)))
    types = _month_parts(events).schema
    return _read_structs(months.withColumns({c: F.lit(None).cast(types[c].dataType) for c in left_out}))


def _read_structs(grouped: DataFrame) -> DataFrame:
    kept = [c for c in grouped.columns if c not in (*STATIC_COLUMNS, "_last")]
    return grouped.selectExpr(*kept, *[f"{c}.{c} as {c}" for c in STATIC_COLUMNS], *[f"_last.{c} as last_{c}_in_month" for c in STATUS])


def _month_parts(events: DataFrame) -> DataFrame:
    order = "purchase_time, row_uid"
    first = [f"min(if({c} is null, null, struct({order}, {c}))) as {c}" for c in STATIC_COLUMNS]
    return _entity_month(events, first, f"max(struct({order}, {', '.join(STATUS)})) as _last")


def _merged_months(parts: DataFrame) -> DataFrame:
    """Months of several slices as one row per entity and month."""
    def merged(name: str) -> Column:
        if name in ("has_purchase", "last_purchase_time_in_month", "_last"):
            return F.max(name)
        return F.min(name) if name in STATIC_COLUMNS else F.sum(name)

    keys = [*ENTITY, "purchase_month"]
    return parts.groupBy(*keys).agg(*[merged(c).alias(c) for c in parts.columns if c not in keys])


def _entity_month(events: DataFrame, first: Sequence[str], last: str) -> DataFrame:
    return events.groupBy(*ENTITY, "purchase_month").agg(
        F.count("order_detail_id").alias("order_count"),
        F.max(F.when(F.col("order_detail_id").isNotNull(), 1).otherwise(0)).alias("has_purchase"),
        F.max("purchase_time").alias("last_purchase_time_in_month"),
        F.sum("raw_sensitive_purchase_quantity").alias("purchase_quantity_sum"),
        F.sum("raw_sensitive_purchase_amount").alias("purchase_amount_sum"),
        F.sum("raw_sensitive_delivery_quantity").alias("delivery_quantity_sum"),
        F.sum("raw_sensitive_arrival_quantity").alias("arrival_quantity_sum"),
        F.count_if(F.col("order_failure_flag") == 1).alias("failed_count"),
        F.count_if(F.col("delivery_state_code") == 5).alias("received_count"),
        F.count_if(F.col("order_terminal_flag") == 1).alias("terminal_count"),
        *[F.expr(e) for e in first],
        F.expr(last),
    )


def purchase_sequence(events: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Event index, previous purchase time and gap days.

    Index and previous time come from the day level (days per entity are bounded by the calendar), so that no
    window holds all events of a hot entity.
    """
    days = events.groupBy(*keys, "purchase_time").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("purchase_time")
    days = days.select(
        *keys,
        "purchase_time",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("purchase_time").over(w).alias("_earlier_day"),
    )
    inside = Window.partitionBy(*keys, "purchase_time").orderBy("order_detail_id", "row_uid")
    numbered = events.withColumn("_i", F.row_number().over(inside))
    joined = null_safe_join(numbered, days, [*keys, "purchase_time"], "inner")
    previous = F.when(F.col("_i") > 1, F.col("purchase_time")).otherwise(F.col("_earlier_day"))
    return joined.withColumns(
        {
            "sequence_index": F.col("_before") + F.col("_i"),
            "previous_purchase_time": previous,
            "gap_days_since_previous_purchase": F.datediff("purchase_time", previous),
        }
    ).drop("_i", "_before", "_earlier_day")


def with_product_line_group(orders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Drug group = mapped product line, else the drug code."""
    m = mapping.groupBy("drug_code").agg(F.min("product_line_code").alias("_line"))
    joined = orders.join(m, "drug_code", "left")
    has = F.coalesce(F.col("_line"), F.lit("")) != ""
    return joined.withColumns(
        {
            "drug_group": F.when(has, F.col("_line")).otherwise(F.col("drug_code").cast("string")),
            "drug_group_source": F.when(has, F.lit("product_line_mapping")).otherwise(F.lit("drug_code")),
        }
    ).drop("_line")


def monthly_entities(
    orders: DataFrame, cutoff_date: str, report_month: str, hospitals: DataFrame | None = None,
    drugs: DataFrame | None = None, mapping: DataFrame | None = None, horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """Entity totals as of the cutoff, with the last three months, history flag, dimensions and horizons."""
    cutoff = F.to_date(F.lit(cutoff_date))
    df = orders.where(F.col("order_date") <= cutoff)
    if mapping is not None:
        df = with_product_line_group(df, mapping)
    else:
        df = df.withColumns(
            {"drug_group": F.col("drug_code").cast("string"), "drug_group_source": F.lit("drug_code")}
        )
    recent = F.col("order_date") > F.add_months(cutoff, -3)
    base = df.groupBy(*ENTITY, "drug_group_source").agg(
        F.min("order_date").alias("first_purchase_date"),
        F.max("order_date").alias("last_purchase_date"),
        F.count("order_id").alias("purchase_count_total"),
        F.sum("order_quantity").alias("purchase_quantity_total"),
        F.sum("order_amount").alias("order_amount_total"),
        F.count(F.when(recent, F.col("order_id"))).alias("purchase_count_recent"),
        F.coalesce(F.sum(F.when(recent, F.col("order_quantity"))), F.lit(0.0)).alias("purchase_quantity_recent"),
        F.coalesce(F.sum(F.when(recent, F.col("order_amount"))), F.lit(0.0)).alias("order_amount_recent"),
    )
    months = F.round(F.greatest(F.datediff(cutoff, "first_purchase_date") / DAYS_PER_MONTH, F.lit(0.0)), 2)
    base = base.withColumns(
        {
            "cutoff_month": F.lit(report_month),
            "cutoff_date": F.lit(cutoff_date),
            "history_months": months,
            "is_one_shot": F.col("purchase_count_total") <= 1,
        }
    ).withColumn("history_sufficiency_flag", history_flag())
    if hospitals is not None:
        base = base.join(
            hospitals.select("hospital_code", "hospital_name", "region_code", "region_name", "hospital_level"),
            "hospital_code", "left",
        ).withColumns(
            {
                "hospital_display_name": F.coalesce("hospital_name", "hospital_code"),
                "region_display_name": F.coalesce("region_name", F.lit("")),
            }
        ).drop("hospital_name", "region_name")
    if drugs is not None:
        base = base.join(
            drugs.select(
                F.col("drug_code").alias("drug_group"), "drug_name", "drug_category", "product_line_code",
                "product_line_name",
            ),
            "drug_group", "left",
        ).withColumns(
            {
                "drug_display_name": F.coalesce("drug_name", "drug_group"),
                "product_line_display_name": F.coalesce("product_line_name", F.lit("")),
            }
        ).drop("drug_name", "product_line_name")
    return explode_horizons(base.withColumn("entity_id", entity_id(ENTITY)), horizons)


def history_flag() -> Column:
    return case(
        [
            (F.col("is_one_shot") | (F.col("history_months") < 3), "history_insufficient"),
            ((F.col("history_months") < 12) | (F.col("purchase_count_total") < 4), "history_medium"),
        ],
        "history_sufficient",
    )


def fill_from_master(orders: DataFrame, meta: DataFrame, columns: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Blank order attributes take the entity's master value."""
    m = meta.groupBy(*on).agg(*[F.min(c).alias(f"{c}_entity") for c in columns])
    joined = null_safe_join(orders, m, on)
    filled = {}
    for c in columns:
        alt = F.col(f"{c}_entity")
        if c in orders.columns:
            own = F.col(c).cast("string")
            filled[c] = F.when(own.isNotNull() & (own != ""), own).otherwise(alt)
        else:
            filled[c] = alt
    return joined.withColumns(filled).drop(*[f"{c}_entity" for c in columns])
