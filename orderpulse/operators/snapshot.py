"""Detector input per entity as of one or many observation dates.

Order rows shrink to entity days first, then to one array of days per entity. Totals, windows, gap statistics
and demand shape of every observation date are read from that array without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.exprs import date_array, entity_id, null_safe_join
from orderpulse.operators.ranking import quantiles
from orderpulse.schemas import ORDER_ENTITY
from orderpulse.session import cut_lineage, remove, slices, stored

OBS = "observation_date"
RECENT_DAYS = 90
BASELINE_DAYS = 365
MARKET_QUANTILE = 0.05


def prepared(orders: DataFrame) -> DataFrame:
    """Typed, day-precise, trimmed order rows."""
    uid = "row_uid" if "row_uid" in orders.columns else "order_id as row_uid"
    return orders.where("order_date is not null").selectExpr(
        *ORDER_ENTITY, "order_id", uid, "to_date(order_date) as order_date",
        "cast(order_quantity as double) as order_quantity", "cast(order_amount as double) as order_amount",
        "cast(purchase_unit_price as double) as purchase_unit_price", "trim(purchase_unit) as purchase_unit",
    )


def entity_days(rows: DataFrame) -> DataFrame:
    """One row per entity and purchase day; the map-side partial keeps a hot entity small."""
    return rows.groupBy(*ORDER_ENTITY, "order_date").agg(
        *[
            F.expr(e)
            for e in (
                "coalesce(sum(order_quantity), 0D) as quantity",
                "coalesce(sum(order_amount), 0D) as amount",
                # First and last known values of the day by order id.
                "min(struct(order_id, row_uid)).order_id as first_id",
                "min(if(order_quantity is null, null, struct(order_id, row_uid, order_quantity))).order_quantity as first_quantity",
                "min(if(order_amount is null, null, struct(order_id, row_uid, order_amount))).order_amount as first_amount",
                "max(if(purchase_unit is null, null, struct(order_id, row_uid, purchase_unit))).purchase_unit as last_unit",
                "collect_set(purchase_unit) as units",
            )
        ]
    )


def _median(array: str) -> str:
    n = f"size({array})"
    return (
        f"case when {n} > 0 then ({array}[cast(floor(({n} - 1) / 2) as int)] "
        f"+ {array}[cast(ceil(({n} - 1) / 2) as int)]) / 2 else 0D end"
    )


# Running fold over days in date order: months seen, total and sum of squares of the monthly quantities.
_MONTHS = """aggregate(h, named_struct('m', cast(null as date), 's', 0D, 'n', 0, 't', 0D, 'q', 0D),
    (a, x) -> if(a.m <=> to_date(trunc(x.order_date, 'month')),
      named_struct('m', a.m, 's', a.s + x.quantity, 'n', a.n, 't', a.t, 'q', a.q),
      named_struct('m', to_date(trunc(x.order_date, 'month')), 's', x.quantity, 'n', a.n + 1, 't', a.t + a.s, 'q', a.q + a.s * a.s)),
    a -> named_struct('n', a.n, 't', a.t + a.s, 'q', a.q + a.s * a.s))"""


def base_snapshot(rows: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Totals, windows, current and first purchase facts, gap median and MAD, demand shape.

    The purchase days of an entity (at most one entry per calendar day) are gathered once; every observation
    date then reads its own prefix of that array, so no row is repeated per date before the last projection.
    """
    lists = entity_days(rows).groupBy(*ORDER_ENTITY).agg(
        F.expr("array_sort(collect_list(struct(order_date, quantity, amount, first_id, first_quantity, first_amount, last_unit, units))) as days")
    )
    seen = lists.withColumn(OBS, F.explode(date_array(dates))).selectExpr(
        OBS, *ORDER_ENTITY, f"filter(days, x -> x.order_date <= {OBS}) as h"
    ).where("size(h) > 0")

    def total(field: str, cond: str) -> str:
        return f"aggregate(filter(h, x -> {cond}), 0D, (a, x) -> a + x.{field})"

    recent = f"x.order_date > date_sub({OBS}, {RECENT_DAYS})"
    baseline = f"x.order_date > date_sub({OBS}, {BASELINE_DAYS}) and x.order_date <= date_sub({OBS}, {RECENT_DAYS})"
    staged = seen.selectExpr(
        OBS, *ORDER_ENTITY, "h", f"{_MONTHS} as mo", "h[size(h) - 1] as last", "h[0] as first",
        f"if(h[size(h) - 1].order_date = {OBS}, h[size(h) - 1], null) as today",
        "array_sort(slice(transform(h, (x, i) -> if(i = 0, null, datediff(x.order_date, h[i - 1].order_date))), 2, size(h))) as gaps",
        "filter(h, x -> x.last_unit is not null) as with_unit",
    )
    staged = staged.selectExpr(
        "*", f"{_median('gaps')} as historical_interval_median",
        "mo.t / mo.n as q_mean",
        "if(mo.n > 1, greatest(mo.q - mo.t * mo.t / mo.n, 0D) / (mo.n - 1), 0D) as q_var",
    )
    facts = staged.selectExpr(
        OBS, *ORDER_ENTITY,
        "get(with_unit, size(with_unit) - 1).last_unit as purchase_unit",
        "size(array_distinct(flatten(transform(with_unit, x -> x.units)))) as entity_purchase_unit_count",
        "size(h) as purchase_count_total", "first.order_date as first_purchase_date", "last.order_date as last_purchase",
        "if(today is null, last.order_date, if(size(h) > 1, h[size(h) - 2].order_date, null)) as previous_purchase_date",
        f"datediff({OBS}, last.order_date) as days_since_last_purchase",
        "historical_interval_median",
        "array_sort(transform(gaps, g -> abs(g - historical_interval_median))) as deviations",
        *[f"{total(c, cond)} as {w}_{c}" for w, cond in (("recent", recent), ("baseline", baseline)) for c in ("quantity", "amount")],
        f"size(filter(h, x -> {recent})) as recent_order_count", f"size(filter(h, x -> {baseline})) as baseline_order_count",
        f"date_sub({OBS}, {RECENT_DAYS}) as recent_window_start", f"{OBS} as recent_window_end",
        f"date_sub({OBS}, {BASELINE_DAYS}) as baseline_window_start", f"date_sub({OBS}, {RECENT_DAYS}) as baseline_window_end",
        "today is not null as current_purchase_flag", "today.first_id as current_order_id",
        "today.quantity as current_purchase_quantity", "today.amount as current_purchase_amount",
        "first.first_id as first_order_id",
        "get(filter(h, x -> x.first_quantity is not null), 0).first_quantity as first_purchase_quantity",
        "get(filter(h, x -> x.first_amount is not null), 0).first_amount as first_purchase_amount",
        "mo.n as active_month_count",
        f"(year({OBS}) - year(first.order_date)) * 12 + month({OBS}) - month(first.order_date) + 1 as months_observed",
        "if(q_mean > 0, q_var / (q_mean * q_mean), 0D) as cv2_quantity",
    )
    return facts.selectExpr(
        "* except (deviations)", f"{_median('deviations')} as historical_interval_mad",
        f"datediff({OBS}, previous_purchase_date) as silence_days",
        "recent_order_count / 3D as recent_frequency", "baseline_order_count / 9D as purchase_frequency_baseline",
        "recent_quantity / 3D / if(baseline_quantity > 0, baseline_quantity / 9D, null) as quantity_ratio",
        "recent_amount / 3D / if(baseline_amount > 0, baseline_amount / 9D, null) as amount_ratio",
        "recent_order_count / 3D / if(baseline_order_count > 0, baseline_order_count / 9D, null) as frequency_ratio",
        "months_observed / active_month_count as adi",
        """case when months_observed / active_month_count < 1.32 and cv2_quantity < 0.49 then 'smooth'
           when months_observed / active_month_count < 1.32 then 'erratic' when cv2_quantity < 0.49 then 'intermittent'
           else 'lumpy' end as demand_shape_label""",
    )


def current_facts(rows: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Distinct orders and median unit price of each entity on the observation dates.

    The median reads price -> count maps: their size is the number of price points of one drug at one hospital.
    """
    on_day = rows.where(F.array_contains(date_array(dates), F.col("order_date"))).withColumnRenamed("order_date", OBS)
    return on_day.groupBy(OBS, *ORDER_ENTITY).agg(
        F.countDistinct("order_id").alias("current_order_count"),
        F.percentile("purchase_unit_price", 0.5).alias("current_unit_price"),
    )


def priced(rows: DataFrame) -> DataFrame:
    return rows.where("purchase_unit_price > 0 and purchase_unit is not null")


def own_price_evidence(rows: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Recent and baseline price statistics per entity and unit."""
    near = priced(rows).withColumn(
        OBS,
        F.explode(
            F.filter(
                date_array(dates),
                lambda d: (d >= F.col("order_date")) & (F.date_sub(d, BASELINE_DAYS) < F.col("order_date")),
            )
        ),
    ).withColumn("recent", F.expr(f"order_date > date_sub({OBS}, {RECENT_DAYS})"))
    keys = [OBS, *ORDER_ENTITY, "purchase_unit"]
    sides = near.groupBy(*keys, "recent").agg(
        F.countDistinct("order_id").alias("n"), F.percentile("purchase_unit_price", 0.5).alias("mid"),
        F.min("purchase_unit_price").alias("low"), F.max("purchase_unit_price").alias("high"),
    )
    wide = sides.groupBy(*keys).agg(
        *[
            F.expr(f"max(if({'recent' if w == 'recent' else 'not recent'}, {c}, null)) as {w}_{c}")
            for w in ("recent", "baseline") for c in ("n", "mid", "low", "high")
        ]
    )
    return wide.selectExpr(
        *keys, "recent_n as price_recent_order_count", "baseline_n as price_baseline_order_count",
        "recent_mid as recent_price", "baseline_mid as baseline_price", "recent_mid as median_price",
        "recent_low as min_price", "recent_high as max_price",
        "recent_high / if(recent_low > 0, recent_low, null) as price_spread_ratio",
        "recent_mid / if(baseline_mid > 0, baseline_mid, null) as price_ratio",
    )


def market_reference(rows: DataFrame, dates: Sequence[str], quantile: float = MARKET_QUANTILE) -> DataFrame:
    """Low price quantile, distinct orders and hospitals per drug and unit before each date.

    Orders and hospitals count from the day they first appear, so the repeat per date works on day counts.
    """
    base = priced(rows)
    keys = ["drug_code", "purchase_unit"]
    after = F.filter(date_array(dates), lambda d: d > F.col("day"))

    def first_seen(what: str, name: str) -> DataFrame:
        first = base.groupBy(*keys, what).agg(F.min("order_date").alias("day"))
        per_day = first.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
        return per_day.withColumn(OBS, F.explode(after)).groupBy(OBS, *keys).agg(F.sum("n").alias(name))

    per_price = base.groupBy(*keys, "purchase_unit_price", F.col("order_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    low = quantiles(
        per_price.withColumn(OBS, F.explode(after)), [OBS, *keys], "purchase_unit_price",
        {"market_reference_price": quantile}, weight="n",
    )
    return low.join(first_seen("order_id", "reference_order_count"), [OBS, *keys], "left").join(
        first_seen("hospital_code", "reference_hospital_count"), [OBS, *keys], "left"
    )


def detector_snapshot(orders: DataFrame, dates: Sequence[str]) -> DataFrame:
    """One row per entity and observation date with everything the rules read.

    Eight branches read the prepared rows; they are written once, so that the source is scanned and joined once. Large
    input is joined in slices of orders and reduced in slices of entities: the disk holds the shuffles of one slice.
    """
    spark = orders.sparkSession
    rows, path = stored((prepared(part) for part in slices(orders, ["order_id"])), spark)

    def of_entities(part: DataFrame) -> DataFrame:
        out = base_snapshot(part, dates).join(current_facts(part, dates), [OBS, *ORDER_ENTITY], "left")
        return null_safe_join(out, own_price_evidence(part, dates), [OBS, *ORDER_ENTITY, "purchase_unit"])

    out = reduce(DataFrame.unionByName, [cut_lineage(of_entities(part)) for part in slices(rows, ORDER_ENTITY)])
    out = null_safe_join(out, cut_lineage(market_reference(rows, dates)), [OBS, "drug_code", "purchase_unit"])
    start = rows.agg(F.min("order_date")).first()[0]
    remove(spark, path)
    return out.withColumns(
        {
            "entity_id": entity_id(ORDER_ENTITY),
            "drug_group": F.col("drug_code"),
            "tenant_id": F.lit("default_tenant"),
            "data_history_start": F.lit(start).cast("date"),
            "current_order_count": F.coalesce("current_order_count", F.lit(0)),
        }
    )
