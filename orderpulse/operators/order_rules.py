"""Rules on order rows and on (hospital, product line) groups of orders.

Input columns: row_uid, order_id, org_code, product_line_code, drug_code, order_date, purchase_qty, delivery_qty,
purchase_price / comparable_unit_price, conversion_factor, delivery_date, order_status, province_code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.operators.ranking import first_rows, quantiles

UNIT = ["org_code", "product_line_code"]
# Status words that mean a refused or failed delivery.
REFUSAL = (
    "部分退货|过期配送|经营企业拒绝|拒绝|拒绝配送|拒绝确认|拒绝入库|拒绝收货|拒绝响应|配送企业无法配送|企业拒绝配送|"
    "企业配送撤废|全部退货|缺货|退货|未及时配送|无法配送|已驳回|已拒绝|异议撤单|拒收"
)


def _price_limit(default: float | None, overrides: Mapping[str, float]) -> Column:
    """Override by product line, then by drug, then the default."""
    keys = [F.col("product_line_code"), F.col("drug_code")]
    parts = [F.lit(default).cast("double")]
    if overrides:
        table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in (kv[0], float(kv[1]))])
        parts = [F.try_element_at(table, k) for k in keys] + parts
    return F.coalesce(*parts)


def low_price_orders(orders: DataFrame, default: float | None, overrides: Mapping[str, float] | None = None) -> DataFrame:
    priced = orders.withColumn("warning_price", _price_limit(default, overrides or {}))
    return priced.where("comparable_unit_price < warning_price").withColumns(
        {
            "severity": F.expr(
                "greatest(35D, least(100D, (warning_price - comparable_unit_price) / greatest(warning_price, 0.01D) * 100))"
            ),
            "reason_code": F.lit("LOW_PRICE_BELOW_WARNING_PRICE"),
        }
    )


def price_spread_groups(orders: DataFrame, threshold: float = 1.8, by: Sequence[str] = UNIT, samples: int = 5) -> DataFrame:
    """Groups whose dearest price is at least `threshold` times the cheapest, with the cheapest orders as samples."""
    known = orders.where("comparable_unit_price is not null").dropna(subset=list(by))
    spread = known.groupBy(*by).agg(
        F.min("comparable_unit_price").alias("min_price"), F.max("comparable_unit_price").alias("max_price")
    ).withColumn("spread_ratio", F.expr("max_price / if(min_price > 0, min_price, null)"))
    flagged = spread.where(f"min_price <= 0 or spread_ratio >= {float(threshold)}").withColumns(
        {
            "hit": F.col("min_price") > 0,
            "reason_code": F.expr(
                "if(min_price > 0, 'PRICE_SPREAD_RATIO_EXCEEDED', 'PRICE_SPREAD_MIN_PRICE_NOT_POSITIVE')"
            ),
            "severity": F.expr(
                f"if(min_price > 0, least(100D, greatest(45D, (spread_ratio / {float(threshold)}D - 1) * 80 + 45)), 0D)"
            ),
        }
    )
    cheapest = first_rows(known, by, [F.col("comparable_unit_price"), F.col("row_uid")], samples)
    cheapest = cheapest.groupBy(*by).agg(
        F.expr("transform(array_sort(collect_list(struct(comparable_unit_price, row_uid))), x -> x.row_uid)").alias("samples")
    )
    return flagged.join(cheapest, list(by), "left")


def delivery_refusals(orders: DataFrame, status: str = "order_status", pattern: str = REFUSAL) -> DataFrame:
    """Refused orders per unit with the count of every matched status."""
    hit = orders.where(F.coalesce(F.col(status), F.lit("")).rlike(pattern))
    per = hit.groupBy(*UNIT, status).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*UNIT).agg(
        F.sum("n").alias("matched_order_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), F.col("n"))))).alias("matched_statuses"),
    )


def low_delivery_rate_groups(orders: DataFrame, threshold: float = 0.8) -> DataFrame:
    agg = orders.groupBy(*UNIT).agg(F.sum("purchase_qty").alias("purchase_qty"), F.sum("delivery_qty").alias("delivery_qty"))
    rate = agg.where("purchase_qty > 0").withColumn("delivery_rate", F.expr("delivery_qty / purchase_qty"))
    return rate.where(F.col("delivery_rate") < threshold).withColumn(
        "severity", F.expr(f"least(100D, greatest(35D, ({threshold}D - delivery_rate) / {threshold}D * 100))")
    )


def delivery_delay_groups(orders: DataFrame, threshold_days: int = 7) -> DataFrame:
    """Median and maximum delay of the late orders per unit; the median reads day -> count pairs."""
    late = orders.withColumn("delay", F.datediff("delivery_date", "order_date")).where(F.col("delay") > threshold_days)
    days = late.groupBy(*UNIT, "delay").agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy(*UNIT).agg(
        F.sum("n").alias("late_orders"), F.expr("percentile(delay, 0.5D, n)").alias("median_delay_days"),
        F.max("delay").alias("max_delay_days"),
    ).withColumn("severity", F.expr(f"least(100D, greatest(35D, median_delay_days / {threshold_days} * 35))"))


def sales_fluctuation(orders: DataFrame, as_of: str, recent_days: int = 30, ratio: float = 1.8) -> DataFrame:
    """Quantity and frequency spikes and drops: recent daily rate against the three windows before."""
    start, base = f"date_sub(date'{as_of}', {recent_days})", f"date_sub(date'{as_of}', {recent_days * 4})"
    span = recent_days * 3
    agg = orders.dropna(subset=UNIT).groupBy(*UNIT).agg(
        *[
            F.expr(e)
            for e in (
                f"coalesce(sum(if(order_date >= {start}, purchase_qty, null)), 0D) / {recent_days} as rq",
                f"count_if(order_date >= {start}) / {recent_days} as rf",
                f"coalesce(sum(if(order_date >= {base} and order_date < {start}, purchase_qty, null)), 0D) / {span} as bq",
                f"count_if(order_date >= {base} and order_date < {start}) / {span} as bf",
            )
        ]
    ).where("bf > 0")
    checks = [
        ("purchase_qty_spike", "rq", "bq", "SALES_QTY_SPIKE"), ("purchase_qty_drop", "bq", "rq", "SALES_QTY_DROP"),
        ("purchase_freq_spike", "rf", "bf", "SALES_FREQ_SPIKE"), ("purchase_freq_drop", "bf", "rf", "SALES_FREQ_DROP"),
    ]
    rows = ", ".join(
        f"named_struct('detector_id', '{d}', 'numerator', {n}, 'denominator', {m}, 'reason', '{r}')" for d, n, m, r in checks
    )
    long = agg.selectExpr(*UNIT, f"inline(array({rows}))").withColumn(
        "ratio",
        F.expr(
            f"""case when denominator > 0 then numerator / denominator
                when detector_id like '%_drop' and numerator > 0 then {ratio * 10}D end"""
        ),
    )
    out = long.where(f"ratio is null or ratio >= {ratio}").selectExpr(
        *UNIT, "detector_id", "numerator", "denominator", "ratio", "ratio is not null as hit",
        "if(ratio is null, 'SALES_FLUCTUATION_BASELINE_NOT_POSITIVE', reason) as reason_code",
        f"if(ratio is null, 0D, least(100D, greatest(35D, (ratio / {ratio}D - 1) * 60 + 45))) as severity",
    )
    return out


def low_delivery_rate_orders(orders: DataFrame, default: float = 0.8, by_province: Mapping[str, float] | None = None) -> DataFrame:
    limit = F.lit(float(default))
    if by_province:
        table = F.create_map(*[F.lit(x) for kv in by_province.items() for x in (kv[0], float(kv[1]))])
        limit = F.coalesce(F.try_element_at(table, F.col("province_code")), limit)
    rows = orders.where("purchase_qty is not null and delivery_qty is not null").withColumns(
        {"threshold": limit, "delivery_rate": F.expr("delivery_qty / if(purchase_qty > 0, purchase_qty, null)")}
    )
    return rows.where("purchase_qty <= 0 or delivery_rate < threshold").withColumns(
        {
            "hit": F.col("purchase_qty") > 0,
            "reason_code": F.expr("if(purchase_qty > 0, 'DELIVERY_RATE_BELOW_THRESHOLD', 'PURCHASE_QTY_NOT_POSITIVE')"),
            "severity": F.expr("if(purchase_qty > 0, least(100D, (threshold - delivery_rate) / threshold * 100), 0D)"),
        }
    )


def delivery_delay_orders(orders: DataFrame, threshold_hours: float = 48.0) -> DataFrame:
    hours = F.expr("(unix_seconds(cast(delivery_date as timestamp)) - unix_seconds(cast(order_date as timestamp))) / 3600D")
    return orders.withColumn("delay_hours", hours).where(F.col("delay_hours") > threshold_hours).withColumn(
        "severity", F.expr(f"least(100D, greatest(35D, delay_hours / {threshold_hours}D * 35))")
    )


def rejected_orders(orders: DataFrame, keywords: Sequence[str] | None = None, status: str = "order_status") -> DataFrame:
    pattern = "|".join(keywords) if keywords else REFUSAL
    return orders.where(F.coalesce(F.col(status), F.lit("")).rlike(pattern))


def auto_price_baseline(orders: DataFrame, method: str = "mean_factor", factor: float = 0.9, quantile: float = 0.1) -> DataFrame:
    """One row: the automatic price limit from all positive prices."""
    positive = orders.where("comparable_unit_price > 0")
    if method == "quantile":
        return quantiles(positive, [], "comparable_unit_price", {"threshold": quantile})
    return positive.agg((F.avg("comparable_unit_price") * factor).alias("threshold"))


def low_price_auto(orders: DataFrame, method: str = "mean_factor", **kw) -> DataFrame:
    limit = auto_price_baseline(orders, method, **kw).select("threshold").scalar()
    return orders.withColumn("warning_price", limit).where("comparable_unit_price < warning_price").withColumns(
        {
            "severity": F.expr(
                "least(100D, greatest(35D, (warning_price - comparable_unit_price) / greatest(warning_price, 0.01D) * 100))"
            ),
            "reason_code": F.lit("LOW_PRICE_BELOW_AUTO_BASELINE"),
        }
    )


def _unit_days(orders: DataFrame) -> DataFrame:
    return orders.dropna(subset=UNIT).groupBy(*UNIT, "order_date").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("purchase_qty").alias("qty"), F.count("purchase_qty").alias("qty_n"),
        F.max(F.struct("row_uid", "purchase_qty")).alias("last_row"),
    )


def terminal_lost(orders: DataFrame, as_of: str, multiplier: float = 1.5, min_days: int = 2) -> DataFrame:
    """Silent for longer than the average purchase cycle times the multiplier."""
    w = Window.partitionBy(*UNIT).orderBy("order_date")
    days = _unit_days(orders).withColumn("gap", F.datediff("order_date", F.lag("order_date").over(w)))
    agg = days.groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("days"), F.avg("gap").alias("avg_cycle"), F.count("gap").alias("gaps"),
        F.max("order_date").alias("last_order_date"), F.expr("sum(qty) / sum(qty_n)").alias("avg_purchase_qty"),
    ).where(f"days >= {min_days} and gaps > 0")
    out = agg.withColumns(
        {
            "days_since": F.datediff(F.to_date(F.lit(as_of)), "last_order_date"),
            "threshold": F.col("avg_cycle") * multiplier,
        }
    ).where("days_since > threshold")
    return out.withColumns(
        {
            "severity": F.expr("least(100D, greatest(45D, days_since / greatest(threshold, 1D) * 40))"),
            "confidence": F.expr("if(gaps < 3, 0.55D, 0.75D)"),
        }
    )


def new_terminal_or_comeback(orders: DataFrame, as_of: str, comeback_days: int = 180, min_qty: float = 1.0) -> DataFrame:
    """Latest order within 30 days and no earlier order, or none for `comeback_days`."""
    w = Window.partitionBy(*UNIT).orderBy("order_date")
    days = _unit_days(orders).withColumn("previous", F.lag("order_date").over(w))
    last = days.groupBy(*UNIT).agg(F.max_by(F.struct("order_date", "previous", "last_row"), "order_date").alias("d"))
    out = last.selectExpr(
        *UNIT, "d.order_date as latest_order_date", "d.last_row.purchase_qty as purchase_qty",
        "datediff(d.order_date, d.previous) as days_since_previous",
    ).where(f"latest_order_date >= date_sub(date'{as_of}', 30) and coalesce(days_since_previous, {comeback_days}) >= {comeback_days}")
    return out.withColumns(
        {
            "hit": F.col("purchase_qty") >= min_qty,
            "severity": F.when(F.col("purchase_qty") >= min_qty, 55.0).otherwise(15.0),
            "confidence": F.when(F.col("purchase_qty") >= min_qty, 0.7).otherwise(0.25),
        }
    )


def adjacent_window_fluctuation(orders: DataFrame, as_of: str, days: int, kind: str) -> DataFrame:
    """Change between two equal adjacent windows; `kind` is QTY (sums, spike 3) or FREQ (counts, spike 2)."""
    spike = 3.0 if kind == "QTY" else 2.0
    mid, low = f"date_sub(date'{as_of}', {days})", f"date_sub(date'{as_of}', {2 * days})"
    value = "purchase_qty" if kind == "QTY" else "1D"
    agg = orders.dropna(subset=UNIT).groupBy(*UNIT).agg(
        F.expr(f"coalesce(sum(if(order_date > {mid} and order_date <= date'{as_of}', {value}, null)), 0D) as current_value"),
        F.expr(f"coalesce(sum(if(order_date > {low} and order_date <= {mid}, {value}, null)), 0D) as previous_value"),
    )
    out = agg.withColumns(
        {
            "ratio": F.expr("current_value / if(previous_value > 0, previous_value, null)"),
            "drop_rate": F.expr("(previous_value - current_value) / if(previous_value > 0, previous_value, null)"),
        }
    )
    return out.selectExpr(
        "*",
        f"""case when drop_rate >= 0.5 then 'SALES_{kind}_DROP' when ratio >= {spike} then 'SALES_{kind}_SPIKE'
            when ratio is not null then 'SALES_{kind}_STABLE' when current_value > 0 then 'SALES_{kind}_FROM_ZERO_BASELINE'
            else 'SALES_{kind}_NO_ACTIVITY_BOTH_WINDOWS' end as reason_code""",
        f"""case when drop_rate >= 0.5 then least(100D, greatest(45D, drop_rate * 100)) when ratio >= {spike} then least(100D, greatest(45D, ratio * 20))
            when ratio is null and current_value > 0 then 45D else 0D end as severity""",
        f"coalesce(drop_rate >= 0.5 or ratio >= {spike}, current_value > 0) as hit",
    )
