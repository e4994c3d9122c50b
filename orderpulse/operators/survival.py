"""Interval-based survival refinement: routing, group priors, expected interval, overdue state, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.exprs import null_safe_join
from orderpulse.functions.shapes import history_interval
from orderpulse.schemas import DAYS_PER_MONTH

# Route of each demand shape
# (shape, survival method, confidence multiplier, allowed horizons, alert policy, route).
ROUTES = [
    ("smooth", "entity_interval", 1.0, "H3,H6,H12", "normal_probability_alert", "main_probability_model"),
    ("erratic", "entity_interval_with_lower_confidence", 0.75, "H6,H12_preferred_H3_cautious", "review_required",
     "main_probability_model_with_low_confidence"),
    ("intermittent", "group_prior_or_long_horizon", 0.6, "H12_preferred_H3_observation_only",
     "observation_or_manual_review", "longer_horizon_only"),
    ("lumpy", "observation_only", 0.4, "H12_or_later", "no_strong_alert_without_extra_evidence", "observation_only"),
]
UNKNOWN_ROUTE = ("unknown", 0.5, "manual_review", "manual_review_required", "unknown")
ROUTE_FIELDS = ["survival_method", "confidence_multiplier", "allowed_horizons", "alert_policy", "demand_shape_route"]
# Group prior levels, most specific first.
PRIOR_LEVELS = [
    ("manufacturer_drug_category", ["manufacturer_code", "drug_category_code"]),
    ("hospital_level_drug_category", ["hospital_level_code", "drug_category_code"]),
    ("province_drug_category", ["province_code", "drug_category_code"]),
    ("demand_shape_drug_category", ["demand_shape_label", "drug_category_code"]),
    ("global_by_drug_category", ["drug_category_code"]),
    ("global", []),
]


def with_route(df: DataFrame) -> DataFrame:
    cols = {}
    for i, name in enumerate(ROUTE_FIELDS):
        table = F.create_map(*[F.lit(x) for r in ROUTES for x in (r[0], r[i + 1])])
        cols[name] = F.coalesce(F.try_element_at(table, F.col("demand_shape_label")), F.lit(UNKNOWN_ROUTE[i]))
    out = df.withColumns(cols)
    return out.withColumn("demand_shape_adjustment", F.concat_ws(":", F.coalesce("demand_shape_label", F.lit("__MISSING__")), "alert_policy"))


def group_priors(features: DataFrame) -> DataFrame:
    """Median and mean interval of every group level in one GROUPING SETS job.

    Entities are counted per distinct interval first, so the global level merges a small histogram.
    """
    dims = ["manufacturer_code", "hospital_level_code", "province_code", "demand_shape_label", "drug_category_code"]
    interval = "median_purchase_interval_days_asof_cutoff"
    counts = features.where(F.col(interval).isNotNull()).groupBy("cutoff_month", *dims, interval).agg(
        F.count(F.lit(1)).alias("n")
    )
    sets = [[F.col("cutoff_month"), *[F.col(c) for c in cols]] for _, cols in PRIOR_LEVELS]
    agg = counts.groupingSets(sets, "cutoff_month", *dims).agg(
        F.sum("n").alias("group_count"), F.expr(f"percentile({interval}, 0.5D, n)").alias("median_interval_days"),
        F.expr(f"sum({interval} * n) / sum(n)").alias("mean_interval_days"),
        *[F.grouping(c).alias(f"_g_{c}") for c in dims],
    )
    name, key = None, None
    for level, cols in PRIOR_LEVELS:
        cond = F.lit(True)
        for c in dims:
            cond &= F.col(f"_g_{c}") == (0 if c in cols else 1)
        text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols]) if cols else F.lit("global")
        name = F.when(cond, F.lit(level)) if name is None else name.when(cond, F.lit(level))
        key = F.when(cond, text) if key is None else key.when(cond, text)
    return agg.select("cutoff_month", name.alias("group_name"), key.alias("group_key"), "group_count", "median_interval_days", "mean_interval_days")


def attach_prior(df: DataFrame, priors: DataFrame) -> DataFrame:
    """First level, from specific to global, that has a prior for the row."""
    out = df
    for i, (level, cols) in enumerate(PRIOR_LEVELS):
        text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols]) if cols else F.lit("global")
        one = priors.where(F.col("group_name") == level).select(
            "cutoff_month", F.col("group_key").alias("_key"), F.col("median_interval_days").alias(f"_m{i}"), F.col("group_count").alias(f"_c{i}")
        )
        out = out.withColumn("_key", text).join(one, ["cutoff_month", "_key"], "left").drop("_key")
    n = range(len(PRIOR_LEVELS))
    source = "case " + " ".join(f"when _m{i} is not null then '{PRIOR_LEVELS[i][0]}'" for i in n) + " else '' end"
    count = "case " + " ".join(f"when _m{i} is not null then _c{i}" for i in n) + " end"
    out = out.withColumns(
        {
            "group_prior_interval_days": F.coalesce(*[f"_m{i}" for i in n]),
            "group_prior_source": F.expr(source),
            "group_prior_group_count": F.expr(count),
        }
    )
    return out.drop(*[f"_{k}{i}" for i in n for k in "mc"])


def with_expected_interval(df: DataFrame) -> DataFrame:
    med, prior, flag = "median_purchase_interval_days_asof_cutoff", "group_prior_interval_days", "history_sufficiency_flag"
    w = "least(1D, purchase_count_asof_cutoff / 6D)"
    cases = [
        (f"{flag} = 'history_sufficient'", med, "entity_median_interval"),
        (f"{flag} = 'history_medium' and {med} is not null and {prior} is not null", f"{w} * {med} + (1 - {w}) * {prior}",
         "entity_group_mixed_interval"),
        (f"{flag} = 'history_medium' and {med} is not null", med, "entity_median_interval_low_confidence"),
        (f"{prior} is not null", prior, "group_prior_only"),
    ]
    value = "case " + " ".join(f"when {c} then {v}" for c, v, _ in cases) + " end"
    source = "case " + " ".join(f"when {c} then '{s}'" for c, _, s in cases) + " else 'unavailable' end"
    out = df.withColumns({"expected_interval_days": F.expr(value), "expected_interval_source": F.expr(source)})
    return out.withColumn("expected_interval_months", F.col("expected_interval_days") / DAYS_PER_MONTH)


def with_state(df: DataFrame) -> DataFrame:
    months = "months_since_last_purchase_asof_cutoff"
    out = df.withColumns(
        {
            "overdue_ratio": F.expr(f"{months} / if(expected_interval_months is null, null, greatest(expected_interval_months, 1e-9D))"),
            "overdue_gap_months": F.expr(f"{months} - expected_interval_months"),
        }
    )
    return out.withColumn(
        "survival_state",
        F.expr(
            """case when history_sufficiency_flag = 'one_shot' then 'not_applicable_one_shot'
               when history_sufficiency_flag = 'history_insufficient' then 'insufficient_history'
               when demand_shape_label = 'lumpy' then 'low_confidence_lumpy'
               when overdue_ratio is null then 'insufficient_interval_data' when overdue_ratio < 0.8 then 'normal_interval'
               when overdue_ratio < 1.2 then 'near_expected_interval' when overdue_ratio < 2 then 'slightly_overdue'
               when overdue_ratio < 3 then 'materially_overdue' else 'likely_churn_interval' end"""
        ),
    )


def with_confidence(df: DataFrame) -> DataFrame:
    raw = "least(greatest(coalesce(purchase_count_asof_cutoff, 0) / 6D, 0D), 1D) * coalesce(confidence_multiplier, 0.5D)"
    cap = """least(if(history_sufficiency_flag <> 'history_sufficient', 0.4D, 1D), if(expected_interval_source = 'group_prior_only', 0.5D, 1D))"""
    out = df.withColumn("survival_confidence", F.expr(f"least({raw}, {cap})"))
    return out.withColumn(
        "human_review_required",
        F.expr(
            """survival_state in ('materially_overdue', 'likely_churn_interval') or demand_shape_label in ('erratic', 'intermittent', 'lumpy')
               or history_sufficiency_flag <> 'history_sufficient' or survival_confidence < 0.7"""
        ),
    )


def refine(features: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """All survival columns for a feature frame; priors come from `population` (default: the frame itself)."""
    flag, reason = history_interval()
    base = features.withColumns({"history_sufficiency_flag": flag, "history_sufficiency_reason": reason})
    priors = group_priors(population if population is not None else features)
    return with_confidence(with_state(with_expected_interval(attach_prior(with_route(base), priors))))


def closure_state(df: DataFrame) -> DataFrame:
    """Second variant: state from months since the last purchase over the median interval, no priors."""
    return df.withColumn("overdue_ratio", F.expr(
        """months_since_last_purchase_asof_cutoff / if(median_purchase_interval_days_asof_cutoff > 0, median_purchase_interval_days_asof_cutoff / 30.4375D, null)"""
    )).withColumn("survival_state", F.expr(
        """case when one_shot_flag then 'one_shot_not_applicable' when overdue_ratio is null then 'insufficient_interval_data'
           when overdue_ratio >= 2 then 'high_overdue' when overdue_ratio >= 1.2 then 'overdue' when overdue_ratio >= 0.8 then 'near_due' else 'on_track' end"""
    ))


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and shares of the values of each field, null as `__MISSING__`, all fields in one pass."""
    from pyspark.sql import Window

    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("row_count"))
    return counts.withColumn("share", F.col("row_count") / F.sum("row_count").over(Window.partitionBy("field")))


def history_report(refined: DataFrame) -> DataFrame:
    """Rows, confidence and overdue ratio per history flag."""
    return refined.groupBy("history_sufficiency_flag").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("survival_confidence").alias("avg_survival_confidence"), F.avg("overdue_ratio").alias("avg_overdue_ratio"))


def route_report(refined: DataFrame) -> DataFrame:
    """Rows, confidence and the share that people must review per demand shape and its route."""
    return refined.groupBy("demand_shape_label", "demand_shape_route", "alert_policy").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("survival_confidence").alias("avg_survival_confidence"), F.avg(F.col("human_review_required").cast("double")).alias("human_review_rate"))


def state_distribution(scored: DataFrame, probability: str, priority: str) -> DataFrame:
    """Rows, probability, priority and confidence per horizon and survival state."""
    return scored.groupBy("horizon", "survival_state").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(probability).alias("avg_probability"), F.avg(priority).alias("avg_priority"), F.avg("survival_confidence").alias("avg_survival_confidence"))
