"""Features and rules of the (hospital, product line) unit as of an origin date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.exprs import explode_dates
from orderpulse.operators.order_rules import UNIT

ORIGIN = "origin_date"
WINDOWS = [30, 60, 90, 180, 365]
REFUSED = "拒绝|退货|无法配送|缺货|驳回"


def units_as_of(orders: DataFrame, as_of: str, grains: Sequence[str] = ("product_line", "sku")) -> DataFrame:
    """Distinct analysis units per grain."""
    target = {"product_line": "product_line_code", "sku": "drug_code"}
    rows = ", ".join(f"named_struct('analysis_grain', '{g}', 'target_code', {target[g]})" for g in grains)
    return (
        orders.where(F.col("order_date") <= F.to_date(F.lit(as_of)))
        .selectExpr("org_code", f"inline(array({rows}))")
        .where("org_code is not null and target_code is not null")
        .distinct()
    )


def unit_snapshot(orders: DataFrame, origins: Sequence[str]) -> DataFrame:
    """Windowed counts, sums, SKU counts, prices, deliveries, interval statistics per unit and origin date.

    Rows become unit days first; a day keeps its set of SKUs only for the one-year windows.
    """
    eff = orders.where("purchase_qty > 0 and coalesce(void_qty, 0) = 0").dropna(subset=UNIT)
    days = eff.groupBy(*UNIT, "order_date").agg(
        *[
            F.expr(e)
            for e in (
                "count(1) as n", "sum(purchase_qty) as qty", "sum(purchase_amount) as amount",
                "sum(comparable_unit_price) as price_sum", "count(comparable_unit_price) as price_n",
                "min(comparable_unit_price) as price_min", "max(comparable_unit_price) as price_max",
                "sum(delivery_qty) as delivered", "sum(receipt_qty) as received",
                f"count_if(coalesce(order_status, '') rlike '{REFUSED}') as refused",
            )
        ]
    )
    w = Window.partitionBy(*UNIT).orderBy("order_date")
    days = days.withColumn("gap", F.datediff("order_date", F.lag("order_date").over(w)))
    d = explode_dates(days, origins, "order_date", ORIGIN)

    def inside(k: int) -> str:
        return f"order_date > date_sub({ORIGIN}, {k})"

    base = f"({inside(365)} and not ({inside(90)}))"
    aggs = ["max(order_date) as last_day", "min(order_date) as first_day", "avg(gap) as mean_interval_days",
            "stddev_samp(gap) as std_interval_days", "percentile(gap, 0.5) as median_interval_days",
            "max_by(gap, order_date) as last_interval_days"]
    for k in WINDOWS:
        aggs += [f"coalesce(sum(if({inside(k)}, n, null)), 0) as purchase_count_{k}d"]
        aggs += [f"coalesce(sum(if({inside(k)}, {c}, null)), 0D) as {c}_{k}d" for c in ("qty", "amount")]
    aggs += [f"count_if({inside(365)}) as active_days_365d"]
    for name, cond in (("recent", inside(90)), ("base", base)):
        aggs += [f"sum(if({cond}, {c}, null)) as {name}_{c}" for c in ("n", "qty", "amount", "price_sum", "price_n")]
    aggs += [f"min(if({inside(90)}, price_min, null)) as min_comparable_unit_price_90d",
             f"max(if({inside(90)}, price_max, null)) as max_comparable_unit_price_90d",
             f"sum(if({inside(90)}, delivered, null)) as delivered_90d", f"sum(if({inside(90)}, received, null)) as received_90d",
             f"coalesce(sum(if({inside(90)}, refused, null)), 0) as refusal_status_count_90d"]
    agg = d.groupBy(ORIGIN, *UNIT).agg(*[F.expr(a) for a in aggs])
    out = agg.selectExpr(
        ORIGIN, *UNIT, f"concat(org_code, '|product_line|', product_line_code) as analysis_unit_id",
        f"datediff({ORIGIN}, last_day) as days_since_last_purchase", f"datediff({ORIGIN}, first_day) as first_purchase_days_ago",
        "median_interval_days", "mean_interval_days", "std_interval_days", "last_interval_days",
        f"(datediff({ORIGIN}, last_day) - mean_interval_days) / nullif(std_interval_days, 0D) as interval_z_score",
        f"datediff({ORIGIN}, last_day) / nullif(median_interval_days, 0D) as overdue_ratio",
        *[f"{c}_{k}d" for k in WINDOWS for c in ("purchase_count", "qty", "amount")],
        "active_days_365d", "refusal_status_count_90d", "min_comparable_unit_price_90d", "max_comparable_unit_price_90d",
        "recent_qty / nullif(base_qty, 0D) as qty_recent_vs_base_ratio",
        "recent_amount / nullif(base_amount, 0D) as amount_recent_vs_base_ratio",
        "recent_n / nullif(base_n, 0) as freq_recent_vs_base_ratio",
        "purchase_count_30d / 30 as freq_30d", "purchase_count_90d / 90 as freq_90d",
        "recent_price_sum / nullif(recent_price_n, 0) as avg_comparable_unit_price_90d",
        "(recent_price_sum / nullif(recent_price_n, 0)) / nullif(base_price_sum / nullif(base_price_n, 0), 0D) as price_recent_vs_base_ratio",
        "delivered_90d / nullif(recent_qty, 0D) as delivery_rate_90d", "received_90d / nullif(recent_qty, 0D) as receipt_rate_90d",
    )
    return out.join(sku_counts(eff, origins), [ORIGIN, *UNIT], "left").withColumns(
        {
            "sku_count_90d": F.coalesce("sku_count_90d", F.lit(0)),
            "sku_count_365d": F.coalesce("sku_count_365d", F.lit(0)),
        }
    ).withColumn("sku_shrink_ratio", F.expr("(sku_count_365d - sku_count_90d) / nullif(sku_count_365d, 0)"))


def sku_counts(orders: DataFrame, origins: Sequence[str]) -> DataFrame:
    """Distinct SKUs in the last 90 and 365 days: the latest purchase day of each SKU decides both."""
    days = orders.select(*UNIT, "sku_code", "order_date").distinct()
    seen = explode_dates(days, origins, "order_date", ORIGIN).where(f"order_date > date_sub({ORIGIN}, 365)")
    last = seen.groupBy(ORIGIN, *UNIT, "sku_code").agg(F.max("order_date").alias("last"))
    return last.groupBy(ORIGIN, *UNIT).agg(
        F.expr(f"count_if(last > date_sub({ORIGIN}, 90)) as sku_count_90d"), F.count(F.lit(1)).alias("sku_count_365d")
    )


def unit_gap_mad(orders: DataFrame, origin: str) -> DataFrame:
    """Median absolute deviation of the purchase gaps; gaps are whole days, so their histogram is small."""
    eff = orders.where((F.col("purchase_qty") > 0) & (F.col("order_date") <= F.to_date(F.lit(origin)))).dropna(subset=UNIT)
    w = Window.partitionBy(*UNIT).orderBy("order_date")
    gaps = eff.select(*UNIT, "order_date").distinct().withColumn(
        "gap", F.datediff("order_date", F.lag("order_date").over(w))
    ).where("gap > 0")
    med = gaps.withColumn("med", F.percentile("gap", 0.5).over(Window.partitionBy(*UNIT)))
    return med.groupBy(*UNIT).agg(
        F.max("med").alias("historical_median_ipi"), F.expr("percentile(abs(gap - med), 0.5)").alias("historical_mad_ipi")
    )


def temporal_window(orders: DataFrame, as_of: str, recent_days: int = 90, baseline_days: int = 275) -> DataFrame:
    """Recent and baseline counts, quantities and SKU counts, inactivity and purchase-gap statistics."""
    past = orders.where((F.col("order_date") <= F.to_date(F.lit(as_of)))).dropna(subset=UNIT)
    r = f"order_date > date_sub(date'{as_of}', {recent_days})"
    b = f"(order_date > date_sub(date'{as_of}', {recent_days + baseline_days}) and not ({r}))"
    agg = past.groupBy(*UNIT, "sku_code").agg(
        *[
            F.expr(e)
            for e in (
                f"count_if({r}) as rn", f"count_if({b}) as bn", f"sum(if({r}, purchase_qty, 0D)) as rq",
                f"sum(if({b}, purchase_qty, 0D)) as bq", "min(order_date) as f", "max(order_date) as l",
            )
        ]
    ).groupBy(*UNIT).agg(
        *[
            F.expr(e)
            for e in (
                "sum(rn) as recent_order_count", "sum(bn) as baseline_order_count", "sum(rq) as recent_qty", "sum(bq) as baseline_qty",
                "count_if(rn > 0) as recent_active_sku_count", "count_if(bn > 0) as baseline_active_sku_count",
                "min(f) as first_order_date", "max(l) as last_order_date",
            )
        ]
    )
    out = agg.join(unit_gap_mad(past, as_of), UNIT, "left")
    return out.withColumns(
        {
            "inactive_days": F.datediff(F.to_date(F.lit(as_of)), "last_order_date").cast("double"),
            "has_recent_order": F.col("recent_order_count") > 0,
            "has_baseline_order": F.col("baseline_order_count") > 0,
        }
    )


def zero_filled_shape(orders: DataFrame, as_of: str, lookback_days: int = 365, min_nonzero: int = 3) -> DataFrame:
    """Demand shape over calendar months, months without purchases counting as zero."""
    start = f"date_sub(date'{as_of}', {lookback_days})"
    near = orders.where(f"order_date > {start} and order_date <= date'{as_of}'").dropna(subset=UNIT)
    months = f"cast(months_between(trunc(date'{as_of}', 'month'), trunc({start}, 'month')) as int) + 1"
    monthly = near.groupBy(*UNIT, F.trunc("order_date", "month").alias("m")).agg(F.sum("purchase_qty").alias("q"))
    agg = monthly.groupBy(*UNIT).agg(
        F.expr("count_if(q > 0) as nonzero"), F.expr("avg(if(q > 0, q, null)) as mean"),
        F.expr("stddev_pop(if(q > 0, q, null)) as sd"),
    ).withColumn("months", F.expr(months))
    ok = f"nonzero >= {min_nonzero}"
    return agg.selectExpr(
        *UNIT, f"if({ok}, months / nonzero, null) as adi", f"if({ok}, coalesce(pow(sd / nullif(mean, 0D), 2), 0D), null) as cv2",
        f"if({ok}, least(1D, 0.45D + nonzero / 12D), 0.2D) as demand_shape_confidence",
    ).withColumn(
        "demand_shape",
        F.expr(
            """case when adi is null then 'unknown' when adi < 1.32 and cv2 < 0.49 then 'smooth' when adi < 1.32 then 'erratic'
               when cv2 < 0.49 then 'intermittent' else 'lumpy' end"""
        ),
    )


def cohort_context(units: DataFrame, orgs: DataFrame) -> DataFrame:
    """Size and median quantities of the units that share region and hospital level."""
    from orderpulse.operators.ranking import quantiles

    joined = units.join(orgs.select(F.col("hospital_code").alias("org_code"), "region_code", "hospital_level"), "org_code", "left")
    joined = joined.withColumn(
        "cohort_key", F.expr("concat(coalesce(region_code, 'UNKNOWN'), '|', coalesce(hospital_level, 'UNKNOWN'))")
    )
    size = joined.groupBy("cohort_key").agg(F.count(F.lit(1)).alias("cohort_size"))
    r = quantiles(joined, ["cohort_key"], "recent_qty", {"cohort_recent_qty_median": 0.5})
    b = quantiles(joined, ["cohort_key"], "baseline_qty", {"cohort_baseline_qty_median": 0.5})
    return joined.join(size.join(r, "cohort_key").join(b, "cohort_key"), "cohort_key", "left")


def drug_grouping(units: DataFrame, mapping: DataFrame) -> DataFrame:
    """Product line name of each unit, or a warning when the code is not mapped."""
    names = mapping.groupBy(F.col("drug_code").alias("target_code")).agg(
        F.min(F.struct("product_line_code", "product_line_name")).alias("_line")
    )
    return units.join(names, "target_code", "left").selectExpr(
        *units.columns, "_line.product_line_code as product_line_code",
        "coalesce(_line.product_line_name, target_code) as product_line_name",
        "if(_line is null, array('MISSING_DRUG_GROUP_MAPPING'), array()) as warnings",
    )


def substitution_features(units: DataFrame, mapping: DataFrame) -> DataFrame:
    """Recent and baseline quantity of the other drugs of the same product line at the hospital."""
    line = mapping.groupBy(F.col("drug_code").alias("product_line_code")).agg(F.min("product_line_code").alias("group_code"))
    joined = units.join(line, "product_line_code", "left")
    group = joined.where("group_code is not null").groupBy("org_code", "group_code").agg(
        F.sum("recent_qty").alias("gr"), F.sum("baseline_qty").alias("gb"), F.count(F.lit(1)).alias("members")
    )
    return joined.join(group, ["org_code", "group_code"], "left").selectExpr(
        *UNIT, "recent_qty as own_recent_qty", "baseline_qty as own_baseline_qty",
        "coalesce(gr, recent_qty) as same_group_recent_qty", "coalesce(gb, baseline_qty) as same_group_baseline_qty",
        "coalesce(members - 1, 0) as substitute_candidate_count",
        "coalesce((gr - recent_qty) - (gb - baseline_qty), 0D) as substitute_qty_delta",
        "if(coalesce(members, 1) > 1, 0.5D, 0.1D) as substitution_feature_confidence",
    )


def seasonality(orders: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Quantity of the last window against the same window a year earlier."""
    a, p = f"date'{as_of}'", f"add_months(date'{as_of}', -12)"
    agg = orders.dropna(subset=UNIT).groupBy(*UNIT).agg(
        F.expr(f"sum(if(order_date > date_sub({a}, {days}) and order_date <= {a}, purchase_qty, 0D)) as current_period_qty"),
        F.expr(f"sum(if(order_date > date_sub({p}, {days}) and order_date <= {p}, purchase_qty, 0D)) as same_period_last_year_qty"),
    )
    return agg.selectExpr("*", "current_period_qty / if(same_period_last_year_qty > 0, same_period_last_year_qty, null) as yoy_qty_ratio")


def cycle_prior(units: DataFrame, priors: DataFrame) -> DataFrame:
    """Attach the typical refill days of the product line, with zero confidence where none is known."""
    return units.join(priors, "product_line_code", "left").withColumn(
        "cycle_prior_confidence", F.expr("if(typical_refill_days is null, 0D, 0.5D)")
    )


# Parameters of the unit rules.
UNIT_RULES = {
    "min_inactive_days": 30.0, "inactive_multiplier": 1.5, "z_hit": 2.0, "z_full": 5.0, "deviation_multiplier": 1.5,
    "min_cycle_confidence": 0.3, "min_base_monthly_orders": 0.5, "drop_threshold": 0.6, "min_base_sku_count": 2.0,
    "shrink_threshold": 0.34, "own_drop_threshold": 0.7, "same_group_stable_threshold": 0.9,
}
FAMILIES = {
    "inactive_terminal": "interval", "ip_interval": "interval", "cycle_deviation": "cycle", "frequency_drop": "frequency",
    "sku_shrink": "portfolio", "new_terminal": "new_terminal", "substitution_risk": "substitution",
}


def unit_rules(units: DataFrame, recent_days: int = 90, baseline_days: int = 275, p: dict | None = None) -> DataFrame:
    """Seven rules per unit from temporal, shape, cycle and substitution columns, as long rows."""
    k = {**UNIT_RULES, **(p or {})}
    tm = "case when demand_shape in ('intermittent', 'lumpy') then 1.35D when demand_shape = 'unknown' then 1.2D else 1D end"
    cm = "case when demand_shape in ('intermittent', 'lumpy') then 0.75D when demand_shape = 'unknown' then 0.65D else 1D end"
    interval = "greatest(coalesce(typical_refill_days, nullif(historical_median_ipi, 0D), adi, 30D), 1D)"
    staged = units.selectExpr(
        "*", f"({tm}) as tm", f"({cm}) as cm", f"greatest({k['min_inactive_days']}D, {interval} * {k['inactive_multiplier']}D * ({tm})) as inactive_limit",
        "(inactive_days - historical_median_ipi) / (1.4826D * greatest(historical_mad_ipi, 1D)) as robust_z",
        f"greatest(typical_refill_days, 1D) * {k['deviation_multiplier']}D as cycle_limit",
        f"baseline_order_count / ({baseline_days} / 30.4375D) as base_rate",
        f"(recent_order_count / ({recent_days} / 30.4375D)) / if(baseline_order_count > 0, baseline_order_count / ({baseline_days} / 30.4375D), null) as rate_ratio",
        "if(baseline_active_sku_count <= 0, 0D, greatest(0D, (baseline_active_sku_count - recent_active_sku_count) / if(baseline_active_sku_count > 0, baseline_active_sku_count, null))) as shrink",
        "if(own_baseline_qty > 0, own_recent_qty / if(own_baseline_qty > 0, own_baseline_qty, null), 1D) as own_ratio",
        "if(same_group_baseline_qty > 0, same_group_recent_qty / if(same_group_baseline_qty > 0, same_group_baseline_qty, null), 1D) as group_ratio",
    )
    zh, zf = f"({k['z_hit']}D * tm)", f"({k['z_full']}D * tm)"
    sub = f"""(own_baseline_qty > 0 and own_ratio < {k['own_drop_threshold']} and group_ratio >= {k['same_group_stable_threshold']}
        and substitution_feature_confidence >= 0.3)"""
    freq = f"(base_rate >= {k['min_base_monthly_orders']} and coalesce(rate_ratio, 1D) < {k['drop_threshold']})"
    shrunk = f"(baseline_active_sku_count >= {k['min_base_sku_count']} and shrink >= {k['shrink_threshold']})"
    rules = {
        # rule: hit, severity when hit, severity otherwise, confidence when hit, confidence otherwise, missing input
        "inactive_terminal": ("inactive_days >= inactive_limit", "least(100D, 45 + (inactive_days / inactive_limit - 1) * 55)",
                              "greatest(0D, inactive_days / inactive_limit * 30)", "0.85D * cm", "0.45D * cm", "false"),
        "ip_interval": (f"robust_z >= {zh}", f"least(100D, 35 + (robust_z - {zh}) / greatest({zf} - {zh}, 1D) * 65)", "0D",
                        "0.8D * cm", "0.45D * cm", "historical_median_ipi is null"),
        "cycle_deviation": (f"inactive_days >= cycle_limit and cycle_prior_confidence >= {k['min_cycle_confidence']}",
                            "least(100D, 50 + (inactive_days / cycle_limit - 1) * 50)", "0D", "0.8D * cycle_prior_confidence",
                            "0.2D * cycle_prior_confidence", "typical_refill_days is null"),
        "frequency_drop": (freq, f"least(100D, (1 - rate_ratio / {k['drop_threshold']}) * 100)", "0D", "0.82D", "0.5D", "false"),
        "sku_shrink": (shrunk, "least(100D, shrink * 100)", "0D", "0.8D", "0.45D", "false"),
        "new_terminal": ("has_recent_order and not has_baseline_order", "42D", "0D", "0.9D", "0.5D", "false"),
        "substitution_risk": (sub, "55D", "0D", "substitution_feature_confidence", "least(substitution_feature_confidence, 0.25D)", "false"),
    }
    rows = ", ".join(
        f"""named_struct('detector_name', '{d}', 'family', '{FAMILIES[d]}', 'missing', {miss}, 'hit', not ({miss}) and coalesce({hit}, false),
            'severity', cast(if({miss}, 0D, if(coalesce({hit}, false), {s1}, {s0})) as double),
            'confidence', cast(if({miss}, 0D, if(coalesce({hit}, false), {c1}, {c0})) as double))"""
        for d, (hit, s1, s0, c1, c0, miss) in rules.items()
    )
    return staged.selectExpr(*UNIT, f"inline(array({rows}))")


def fuse(results: DataFrame, min_confidence: float = 0.4, orange: float = 70.0, yellow: float = 35.0) -> DataFrame:
    """Per unit: best score per family, mean confidence of hits minus a penalty per missing input, level."""
    family = results.groupBy(*UNIT, "family").agg(
        F.expr("max(if(hit, severity, null)) as best"), F.expr("sum(if(hit, confidence, 0D)) as conf_sum"),
        F.expr("count_if(hit) as hits"), F.expr("count_if(missing) as missing_n"),
        F.expr("array_sort(collect_list(if(hit, detector_name, null))) as names"),
    )
    unit = family.groupBy(*UNIT).agg(
        F.expr("coalesce(max(best), 0D) as rule_score"), F.expr("count(best) as family_count"),
        F.expr("sum(conf_sum) / nullif(sum(hits), 0) as mean_confidence"), F.expr("sum(missing_n) as warning_count"),
        F.expr("array_join(array_sort(flatten(collect_list(names))), ',') as triggered_detectors"),
        F.expr("array_join(array_sort(collect_list(if(best is null, null, family))), ',') as triggered_families"),
    )
    out = unit.withColumn(
        "confidence", F.expr("greatest(0D, coalesce(mean_confidence, 0D) - least(0.3D, warning_count * 0.02D))")
    )
    return out.withColumn(
        "risk_level",
        F.expr(
            f"""case when confidence < {min_confidence} or rule_score <= 0 then 'none' when family_count >= 2 or rule_score >= {orange} then 'orange'
                when rule_score >= {yellow} then 'yellow' else 'none' end"""
        ),
    )


def clue_candidates(unit_hits: DataFrame, order_hits: DataFrame, as_of: str, version: str = "v0") -> DataFrame:
    """Union of rule and order evidence per unit: level, families, stable id.

    Both inputs: unit columns, detector_id, category, family, severity, confidence.
    """
    cols = [*UNIT, "detector_id", "category", "family", "severity", "confidence"]
    both = unit_hits.select(*cols).unionByName(order_hits.select(*cols))
    # One row per unit and detector first: a unit with many order hits stays small.
    per = both.groupBy(*UNIT, "detector_id", "category", "family").agg(
        F.max("severity").alias("severity"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")
    )
    unit = per.groupBy(*UNIT).agg(
        F.expr("max(severity) as rule_score"), F.expr("max(confidence) as confidence"), F.sum("n").alias("evidence_count"),
        F.expr("array_sort(collect_set(category)) as categories"), F.expr("array_sort(collect_set(concat(category, '/', family))) as families"),
        F.expr("array_join(array_sort(collect_set(detector_id)), ',') as triggered_detectors"),
    )
    out = unit.withColumn(
        "category", F.expr("if(array_contains(categories, 'price_warning'), 'price_warning', categories[0])")
    )
    out = out.withColumns(
        {
            "family_count": F.size("families"),
            "risk_level": F.expr(
                """case when category in ('price_warning', 'delivery_response') and rule_score >= 85 then 'red'
                   when size(families) >= 2 or rule_score >= 55 then 'orange' else 'yellow' end"""
            ),
            "debug_trace_id": F.substring(
                F.md5(F.concat(F.concat_ws("|", "org_code", F.lit("product_line"), "product_line_code"), F.lit(f"|{as_of}|{version}|"), F.col("category"))), 1, 12
            ),
            "evidence_families": F.array_join("families", ","),
        }
    )
    return out.withColumn("card_id", F.concat(F.lit("RISK-"), F.col("debug_trace_id"))).drop("categories", "families")
