"""As-of-cutoff features: one conditional aggregate over entity months serves all cutoffs and all windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.exprs import (
    add_months_end, case, clip, entity_id, explode_dates, explode_horizons, horizon_number, month_gap,
    null_safe_join, ratio, ratio_pos, zero,
)
from orderpulse.functions.shapes import history_monthly, shape_closed, shape_open
from orderpulse.operators.ranking import exact_rank, pct_rank, pct_ranks, tercile
from orderpulse.schemas import (
    DAYS_PER_MONTH, ENTITY, HORIZONS, MAX_MONITOR_GAP_MONTHS, PAIR, STATIC_COLUMNS,
)

WINDOWS = [1, 3, 6, 12]
WINDOW_MEASURES = {
    "order_count": "order_count",
    "purchase_quantity_sum": "purchase_quantity_sum",
    "purchase_amount_sum": "purchase_amount_sum",
    "failed_count": "failed_count",
    "received_count": "received_count",
    "terminal_count": "terminal_count",
}
KEY = [*ENTITY, "cutoff_month"]


def with_gaps(entity_month: DataFrame) -> DataFrame:
    """Gap in days to the entity's previous purchase month (a window over at most one row per month)."""
    w = Window.partitionBy(*ENTITY).orderBy("purchase_month")
    return entity_month.withColumn(
        "gap_days", F.datediff("purchase_month", F.lag("purchase_month").over(w))
    )


def history(entity_month: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Entity months repeated for every cutoff that may see them."""
    return explode_dates(with_gaps(entity_month), cutoffs, "purchase_month", "cutoff_month")


def in_window(months: int) -> Column:
    return F.col("purchase_month") >= add_months_end("cutoff_month", -(months - 1))


def sample_class(gap: Column | str, active: Column | str, max_gap: int = MAX_MONITOR_GAP_MONTHS) -> Column:
    g = F.col(gap) if isinstance(gap, str) else gap
    a = F.col(active) if isinstance(active, str) else active
    return case(
        [(g > max_gap, "unmonitorable"), (a == 1, "one_shot"), (a >= 2, "recurring")], "data_integrity_error"
    )


def median_deviation(values: Column, median: Column) -> Column:
    """Median absolute deviation of an array from its median; null for an empty one."""
    away = F.array_sort(F.transform(values, lambda g: F.abs(g.cast("double") - median)))
    middle = lambda k: F.get(away, F.floor((F.size(away) - k) / 2).cast("int"))
    return (middle(1) + middle(0)) / 2


def asof_base(entity_month: DataFrame, cutoffs: Sequence[str], max_gap: int = MAX_MONITOR_GAP_MONTHS) -> DataFrame:
    """All seen entities per cutoff: counters, windows, interval and quantity statistics, latest status."""
    hist = history(entity_month, cutoffs)
    month = F.col("purchase_month")
    windows = []
    for m in WINDOWS:
        inside = in_window(m)
        for source, target in WINDOW_MEASURES.items():
            windows.append(zero(F.sum(F.when(inside, F.col(source)))).alias(f"{target}_last_{m}m_asof_cutoff"))
        windows.append(F.count_if(inside).alias(f"active_months_last_{m}m_asof_cutoff"))
    status = {
        "last_order_phase_code_in_month": "last_order_phase_code_asof_cutoff",
        "last_delivery_state_code_in_month": "last_delivery_state_code_asof_cutoff",
        "last_order_failure_flag_in_month": "last_order_failure_flag_asof_cutoff",
    }
    latest = F.max_by(F.struct(*STATIC_COLUMNS, *status), month).alias("_latest")
    agg = hist.groupBy(*KEY).agg(
        F.sum("order_count").alias("purchase_count_asof_cutoff"),
        F.count(F.lit(1)).alias("active_month_count_asof_cutoff"),
        F.min(month).alias("first_purchase_month_asof_cutoff"),
        F.max(month).alias("last_purchase_month_asof_cutoff"),
        *windows,
        F.percentile("gap_days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_gap_q"),
        # One gap per active month: the calendar bounds the list.
        F.collect_list("gap_days").alias("_gaps"),
        F.avg("gap_days").alias("mean_purchase_interval_days_asof_cutoff"),
        F.stddev_samp("gap_days").alias("std_purchase_interval_days_asof_cutoff"),
        F.avg("purchase_quantity_sum").alias("_q_mean"),
        F.stddev_samp("purchase_quantity_sum").alias("_q_std"),
        latest,
    )
    cutoff = F.col("cutoff_month")
    out = agg.withColumns(
        {
            "months_since_last_purchase_asof_cutoff": month_gap(cutoff, "last_purchase_month_asof_cutoff"),
            "months_since_first_purchase_asof_cutoff": month_gap(cutoff, "first_purchase_month_asof_cutoff"),
            "months_observed_asof_cutoff": month_gap(cutoff, "first_purchase_month_asof_cutoff") + 1,
            "median_purchase_interval_days_asof_cutoff": F.col("_gap_q")[1],
            "purchase_interval_iqr_asof_cutoff": F.col("_gap_q")[2] - F.col("_gap_q")[0],
            "purchase_interval_mad_days_asof_cutoff": median_deviation(F.col("_gaps"), F.col("_gap_q")[1]),
            "cv2_quantity_asof_cutoff": F.pow(ratio("_q_std", "_q_mean"), 2),
            **{c: F.col(f"_latest.{c}") for c in STATIC_COLUMNS},
            **{new: F.col(f"_latest.{old}") for old, new in status.items()},
        }
    ).drop("_gap_q", "_gaps", "_q_mean", "_q_std", "_latest")
    return out.withColumn(
        "sample_class",
        sample_class("months_since_last_purchase_asof_cutoff", "active_month_count_asof_cutoff", max_gap),
    )


def scope_report(base: DataFrame) -> DataFrame:
    seen = F.count(F.lit(1))
    unmonitorable = F.count_if(F.col("sample_class") == "unmonitorable")
    return base.groupBy("cutoff_month").agg(
        seen.alias("all_seen_entity_count"),
        (seen - unmonitorable).alias("monitorable_entity_count"),
        unmonitorable.alias("excluded_by_monitor_gap_count"),
        F.count_if(F.col("sample_class") == "one_shot").alias("one_shot_entity_count"),
        F.count_if(F.col("sample_class") == "recurring").alias("recurring_entity_count"),
    )


def unmonitorable_audit(base: DataFrame) -> DataFrame:
    return base.where(F.col("sample_class") == "unmonitorable").select(
        *KEY, "first_purchase_month_asof_cutoff", "last_purchase_month_asof_cutoff", "purchase_count_asof_cutoff",
        "active_month_count_asof_cutoff", "months_since_last_purchase_asof_cutoff", "months_observed_asof_cutoff",
        "sample_class",
    )


def with_demand(base: DataFrame) -> DataFrame:
    n, a = F.col("purchase_count_asof_cutoff"), F.col("active_month_count_asof_cutoff")
    m = F.col("months_observed_asof_cutoff")
    out = base.withColumns(
        {
            "active_month_ratio_asof_cutoff": ratio(a, m),
            "adi_asof_cutoff": ratio(m, a),
            "cold_start_flag": (n < 3) | (a < 2) | (m < 3),
            "confidence_score": F.least(n / 12, F.lit(1.0)),
        }
    )
    shape = shape_closed("adi_asof_cutoff", "cv2_quantity_asof_cutoff", F.col("cold_start_flag"))
    return out.withColumns(
        {
            "demand_pattern_type_asof_cutoff": shape,
            "demand_shape_label": shape,
            "history_sufficiency_flag": history_monthly(n, a, m),
        }
    )


def with_value_at_risk(features: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    out = features.withColumns(
        {
            "historical_avg_monthly_amount_asof_cutoff": zero("purchase_amount_sum_last_12m_asof_cutoff") / 12,
            "historical_avg_monthly_quantity_asof_cutoff": zero("purchase_quantity_sum_last_12m_asof_cutoff") / 12,
        }
    )
    cols: dict[str, Column] = {}
    for kind in ("amount", "quantity"):
        avg = F.col(f"historical_avg_monthly_{kind}_asof_cutoff")
        cols[f"negative_value_at_risk_{kind}_flag"] = avg < 0
        for h in horizons:
            cols[f"value_at_risk_{kind}_raw_H{h}_asof_cutoff"] = avg * h
            cols[f"value_at_risk_{kind}_nonnegative_H{h}_asof_cutoff"] = F.greatest(avg * h, F.lit(0.0))
    return out.withColumns(cols)


def with_value_tier(features: DataFrame, by: Sequence[str] = ("cutoff_month",)) -> DataFrame:
    """Tercile of the average monthly amount within the cutoff; a constant label below three distinct values."""
    value = "historical_avg_monthly_amount_asof_cutoff"
    distinct = features.groupBy(*by).agg(F.countDistinct(value).alias("_distinct"))
    ranked = exact_rank(features, value, by, ENTITY, name="_r", total="_n", descending=False)
    joined = null_safe_join(ranked, distinct, by)
    return joined.withColumn(
        "entity_value_tier_asof_cutoff",
        F.when(F.col("_distinct") >= 3, tercile(F.col("_r"), F.col("_n"))).otherwise(F.lit("known_value")),
    ).drop("_r", "_n", "_distinct")


def cutoff_features(
    entity_month: DataFrame, cutoffs: Sequence[str], max_gap: int = MAX_MONITOR_GAP_MONTHS, tiers: bool = True,
) -> DataFrame:
    """Features of all monitorable entities at each cutoff."""
    base = asof_base(entity_month, cutoffs, max_gap).where(F.col("sample_class") != "unmonitorable")
    out = with_value_at_risk(with_demand(base)).withColumns(
        {
            "candidate_policy": F.lit("monitorable"),
            "days_since_last_purchase": F.col("months_since_last_purchase_asof_cutoff") * DAYS_PER_MONTH,
            "months_since_last_purchase": F.col("months_since_last_purchase_asof_cutoff"),
            "one_shot_flag": F.col("active_month_count_asof_cutoff") == 1,
            "one_shot_silence_months": F.col("months_since_last_purchase_asof_cutoff"),
            "drug_group_source": F.lit("drug_code"),
        }
    )
    return with_value_tier(out) if tiers else out


def candidate_universe(
    events: DataFrame, cutoffs: Sequence[str], policy: str = "monitorable", max_gap: int = MAX_MONITOR_GAP_MONTHS,
) -> DataFrame:
    if policy not in ("monitorable", "all_seen"):
        raise ValueError("policy must be monitorable or all_seen")
    months = events.select(*ENTITY, "purchase_month").distinct()
    seen = explode_dates(months, cutoffs, "purchase_month", "cutoff_month").groupBy(*KEY).agg(
        F.min("purchase_month").alias("first_purchase_month"),
        F.max("purchase_month").alias("last_purchase_month_asof_cutoff"),
    )
    seen = seen.withColumns(
        {
            "months_since_last_purchase": month_gap("cutoff_month", "last_purchase_month_asof_cutoff"),
            "candidate_policy": F.lit(policy),
        }
    )
    return seen if policy == "all_seen" else seen.where(F.col("months_since_last_purchase") <= max_gap)


def candidate_report(all_seen: DataFrame, max_gap: int = MAX_MONITOR_GAP_MONTHS) -> DataFrame:
    kept = F.count_if(F.col("months_since_last_purchase") <= max_gap)
    return all_seen.groupBy("cutoff_month").agg(
        F.count(F.lit(1)).alias("all_seen_entity_count"),
        kept.alias("monitorable_entity_count"),
        (F.count(F.lit(1)) - kept).alias("excluded_by_monitor_gap_count"),
    )


def choice_context(features: DataFrame, base: DataFrame) -> DataFrame:
    """Share of the entity within its hospital x drug pair; `base` holds all seen entities of the cutoffs.

    The pair totals add up entity rows, one per manufacturer, so no distinct count is needed.
    """
    pair = base.groupBy(*PAIR, "cutoff_month").agg(
        F.sum("purchase_count_asof_cutoff").alias("hospital_drug_order_count_asof_cutoff"),
        F.count(F.lit(1)).alias("hospital_drug_active_manufacturer_count_asof_cutoff"),
        *[
            F.sum(f"order_count_last_{m}m_asof_cutoff").alias(f"hospital_drug_order_count_last_{m}m_asof_cutoff")
            for m in (12, 3)
        ],
    )
    out = null_safe_join(features, pair, [*PAIR, "cutoff_month"])

    def rest(total: str, own: str) -> Column:
        return clip(F.col(total) - F.col(own), low=0)

    return out.withColumns(
        {
            "manufacturer_share_within_hospital_drug_asof_cutoff": ratio(
                "purchase_count_asof_cutoff", "hospital_drug_order_count_asof_cutoff"
            ),
            "competitor_order_count_asof_cutoff": rest(
                "hospital_drug_order_count_asof_cutoff", "purchase_count_asof_cutoff"
            ),
            **{
                f"competitor_order_count_last_{m}m_asof_cutoff": rest(
                    f"hospital_drug_order_count_last_{m}m_asof_cutoff", f"order_count_last_{m}m_asof_cutoff"
                )
                for m in (12, 3)
            },
            "manufacturer_substitution_context_available": F.col(
                "hospital_drug_active_manufacturer_count_asof_cutoff"
            ) > 1,
        }
    )


def baseline_scores(features: DataFrame, by: Sequence[str] = ("cutoff_month",), copies: int = 1) -> DataFrame:
    """Recency, frequency decay, interval overdue and their 0.6 / 0.25 / 0.15 blend of percent ranks."""
    since = F.col("months_since_last_purchase_asof_cutoff")
    expected = F.col("median_purchase_interval_days_asof_cutoff") / DAYS_PER_MONTH
    out = features.withColumns(
        {
            "recency_only_baseline": since.cast("double"),
            "frequency_decay_baseline": 1.0 - ratio(
                F.col("order_count_last_3m_asof_cutoff") / 3.0, F.col("order_count_last_12m_asof_cutoff") / 12.0
            ),
            "interval_overdue_baseline": ratio_pos(since, expected),
        }
    ).withColumn("current_interval_over_median", F.col("interval_overdue_baseline"))
    parts = {"interval_overdue_baseline": 0.6, "frequency_decay_baseline": 0.25, "recency_only_baseline": 0.15}
    out = pct_ranks(out, {c: f"_{c}_rank" for c in parts}, by, copies=copies, digits=8)
    blend = sum((F.col(f"_{c}_rank") * w for c, w in list(parts.items())[1:]), F.col("_interval_overdue_baseline_rank") * 0.6)
    return out.withColumn("hybrid_interval_frequency_score", blend).drop(*[f"_{c}_rank" for c in parts])


def expand_horizons(features: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    out = explode_horizons(features, horizons).withColumn("entity_id", entity_id(ENTITY))
    return out.withColumn("candidate_id", F.concat_ws("|", "entity_id", "horizon"))


def runtime_ratios(features: DataFrame) -> DataFrame:
    """Frequency and quantity ratios of the last quarter against the last year."""
    r3 = F.col("order_count_last_3m_asof_cutoff") / 3.0
    r12 = F.col("order_count_last_12m_asof_cutoff") / 12.0
    q3 = F.col("purchase_quantity_sum_last_3m_asof_cutoff")
    q12 = F.col("purchase_quantity_sum_last_12m_asof_cutoff") / 4.0
    return features.withColumns(
        {
            "purchase_frequency_recent": r3,
            "purchase_frequency_baseline": r12,
            "frequency_ratio": ratio(r3, r12),
            "purchase_quantity_recent": q3,
            "purchase_quantity_baseline": q12,
            "quantity_ratio": ratio(q3, q12),
            "value_at_risk_proxy": zero("historical_avg_monthly_amount_asof_cutoff") * horizon_number(),
        }
    )


def runtime_sidecar(expanded: DataFrame, by: Sequence[str] = ("cutoff_month",)) -> DataFrame:
    """Ratios, value level and one-shot attention rank over the horizon-expanded frame."""
    out = pct_rank(runtime_ratios(expanded), "value_at_risk_proxy", by, "_value_rank", digits=6)
    one = F.coalesce("one_shot_flag", F.lit(False))
    shown = F.when(F.col("sample_class") == "recurring", "probability_allowed").otherwise("hidden_one_shot")
    return out.withColumns(
        {
            "potential_value_level": case(
                [(F.col("_value_rank") <= 0.5, "low"), (F.col("_value_rank") <= 0.8, "medium")], "high"
            ),
            "is_one_shot": one,
            "one_shot_attention_score": F.when(one, F.col("_value_rank")).otherwise(0.0),
            "probability_display_level": shown,
            "display_mode": F.when(F.col("sample_class") == "recurring", "show_probability").otherwise(
                "hide_probability"
            ),
        }
    ).drop("_value_rank")


def runtime_features(
    entity_month: DataFrame, cutoffs: Sequence[str], horizons: Sequence[int] = HORIZONS, tiers: bool = False,
) -> DataFrame:
    """Cutoff features with baseline scores, horizons, ids and sidecar columns."""
    feats = baseline_scores(cutoff_features(entity_month, cutoffs, tiers=tiers), copies=len(horizons))
    return runtime_sidecar(expand_horizons(feats, horizons))


def status_rates(base: DataFrame) -> DataFrame:
    """Failed and received shares of the last six months' orders."""
    n = F.col("order_count_last_6m_asof_cutoff")
    return base.withColumns(
        {
            "failed_rate_last_6m_asof_cutoff": ratio("failed_count_last_6m_asof_cutoff", n),
            "received_rate_last_6m_asof_cutoff": ratio("received_count_last_6m_asof_cutoff", n),
        }
    )


def demand_profile(entity_month: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Research profile: gaps as months x 30.4375, population deviations."""
    w = Window.partitionBy(*ENTITY).orderBy("purchase_month")
    gap = month_gap("purchase_month", F.lag("purchase_month").over(w)) * DAYS_PER_MONTH
    hist = explode_dates(entity_month.withColumn("_gap", gap), cutoffs, "purchase_month", "cutoff_month")
    agg = hist.groupBy(*KEY).agg(
        F.sum("order_count").alias("purchase_count_asof_cutoff"),
        F.count(F.lit(1)).alias("active_month_count_asof_cutoff"),
        F.min("purchase_month").alias("_first"),
        F.percentile("_gap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.avg("_gap").alias("mean_purchase_interval_days_asof_cutoff"),
        F.stddev_pop("_gap").alias("std_purchase_interval_days_asof_cutoff"),
        F.avg("purchase_quantity_sum").alias("_mean"),
        F.stddev_pop("purchase_quantity_sum").alias("_std"),
    )
    n, a = F.col("purchase_count_asof_cutoff"), F.col("active_month_count_asof_cutoff")
    out = agg.withColumns(
        {
            "months_observed_asof_cutoff": month_gap("cutoff_month", "_first") + 1,
            "median_purchase_interval_days_asof_cutoff": F.col("_q")[1],
            "purchase_interval_iqr_asof_cutoff": F.col("_q")[2] - F.col("_q")[0],
            "cv2_quantity_asof_cutoff": F.pow(ratio("_std", "_mean"), 2),
        }
    ).drop("_q", "_first", "_mean", "_std")
    m = F.col("months_observed_asof_cutoff")
    out = out.withColumns(
        {
            "adi_asof_cutoff": m / a,
            "active_month_ratio_asof_cutoff": a / m,
            "cold_start_flag": (n < 3) | (a < 2) | (m < 3),
            "confidence_score": F.least(F.lit(1.0), n / 12),
        }
    )
    return out.withColumn(
        "demand_pattern_type_asof_cutoff",
        shape_closed("adi_asof_cutoff", "cv2_quantity_asof_cutoff", F.col("cold_start_flag")),
    )


def coverage_completion(features: DataFrame, entities: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add a row for every base entity that has no feature row."""
    missing = entities.dropDuplicates(list(on)).join(features.select(*on).distinct(), list(on), "left_anti")
    keep = [c for c in missing.columns if c in features.columns]
    out = features.unionByName(missing.select(*keep), allowMissingColumns=True)
    return out.withColumns(
        {
            **{
                c: zero(c)
                for c in ("purchase_count_asof_cutoff", "active_month_count_asof_cutoff", "months_observed_asof_cutoff")
                if c in features.columns
            },
            "entity_id": F.coalesce("entity_id", entity_id(ENTITY)),
            **{c: F.coalesce(c, F.lit(False)) for c in ("one_shot_flag", "is_one_shot") if c in features.columns},
        }
    )


def stability_features(features: DataFrame) -> DataFrame:
    eps = 1e-9
    since = F.col("months_since_last_purchase_asof_cutoff")
    observed = F.col("months_observed_asof_cutoff")
    med = F.col("median_purchase_interval_days_asof_cutoff") / DAYS_PER_MONTH

    def over(num: Column, den: Column, bounded: bool = False) -> Column:
        q = num / F.greatest(den, F.lit(eps))
        return clip(q, 0, 20) if bounded else q

    def at_least_one(c: Column) -> Column:
        return F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(1.0))

    o3, o6, o12 = (F.col(f"order_count_last_{m}m_asof_cutoff") for m in (3, 6, 12))
    prior = F.greatest(o12 - o6, F.lit(0))

    def bucket(c: Column) -> Column:
        return case(
            [(c <= 6, "0-6"), (c <= 12, "7-12"), (c <= 24, "13-24"), (c <= 60, "25-60"), (c > 60, "60+")],
            "__MISSING__",
        )

    def code(c: Column) -> Column:
        return case([(c <= 6, 0.0), (c <= 12, 1.0), (c <= 24, 2.0), (c <= 60, 3.0), (c > 60, 4.0)])

    first = F.col("months_since_first_purchase_asof_cutoff")
    return features.withColumns(
        {
            "normalized_recency_by_adi": over(since, at_least_one(F.col("adi_asof_cutoff"))),
            "normalized_recency_by_median_interval": over(since, at_least_one(med)),
            "recency_excess_over_median_interval": since - med,
            "recency_ratio_to_months_observed": over(since, at_least_one(observed.cast("double")), True),
            "recent_order_rate_3m": o3 / 3.0,
            "recent_order_rate_6m": o6 / 6.0,
            "historical_order_rate_12m": o12 / 12.0,
            "frequency_decay_3m_vs_12m": over(o3 / 3.0, o12 / 12.0, True),
            "frequency_decay_6m_vs_12m": over(o6 / 6.0, o12 / 12.0, True),
            "prior_6m_order_count": prior,
            "frequency_decay_6m_vs_prior_6m": over(o6 / 6.0, prior / 6.0, True),
            "months_observed_bucket": bucket(observed),
            "months_observed_bucket_code": code(observed),
            "months_since_first_purchase_bucket": bucket(first),
            "months_since_first_purchase_bucket_code": code(first),
            "cohort_maturity_flag": (observed >= 12).cast("double"),
            "demand_shape_label": shape_open("adi_asof_cutoff", "cv2_quantity_asof_cutoff", "__MISSING__"),
        }
    )


MODEL_META = ["entity_id", *ENTITY, "drug_group_source", "cutoff_month", "horizon"]


def model_frame(
    features: DataFrame, required: Sequence[str], defaults: Mapping[str, object], dtypes: Mapping[str, str],
) -> DataFrame:
    """Ordered model columns with declared types; a column that is absent takes its default."""
    lost = [c for c in required if c not in features.columns and c not in defaults]
    if lost:
        raise ValueError(f"cannot produce required features: {lost}")
    spark_type = {"float": "double", "int": "bigint", "bool": "boolean"}
    meta = [c for c in MODEL_META if c in features.columns and c not in required]
    cols = []
    for c in required:
        source = F.col(c) if c in features.columns else F.lit(defaults[c])
        typed = source.cast(spark_type.get(dtypes.get(c, ""), "string"))
        if dtypes.get(c) == "float":
            typed = F.when(~F.isnan(typed) & (F.abs(typed) != F.lit(float("inf"))), typed)
        cols.append(typed.alias(c))
    return features.select(*meta, *cols)


def parity_report(
    features: DataFrame, required: Sequence[str], defaults: Mapping[str, object], dtypes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Missing values per model column before and after it takes its declared type, in one pass.

    A value that the type cannot hold (text in a number, an infinite number) is missing afterwards; a column that is
    absent takes its default, which also fills what the type makes missing.
    """
    lost = [c for c in required if c not in features.columns and c not in defaults]
    if lost:
        raise ValueError(f"cannot produce required features: {lost}")
    spark_type = {"float": "double", "int": "double", "bool": "boolean"}
    aggs = []
    for i, c in enumerate(required):
        source = F.col(c) if c in features.columns else F.lit(defaults[c])
        typed = source.cast("string").try_cast(spark_type.get((dtypes or {}).get(c, ""), "string"))
        if (dtypes or {}).get(c) in ("float", "int"):
            typed = F.when(~F.isnan(typed) & (F.abs(typed) != F.lit(float("inf"))), typed)
        if c not in features.columns and defaults[c] is not None:
            typed = F.coalesce(typed.cast("string"), F.lit(str(defaults[c])))
        aggs += [F.count_if(source.isNull()).alias(f"_b{i}"), F.count_if(typed.isNull()).alias(f"_a{i}")]
    wide = features.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("required_feature"),
            F.col(f"_b{i}").cast("bigint").alias("missing_before"),
            F.col(f"_a{i}").cast("bigint").alias("missing_after"),
            F.lit("runtime_generated" if c in features.columns else "schema_default").alias("production_imputation"),
            F.lit(
                "available_from_raw_feature_engineering" if c in features.columns else "generated_from_schema_default"
            ).alias("parity_status"),
        )
        for i, c in enumerate(required)
    ]
    return wide.select(F.inline(F.array(*rows)))
