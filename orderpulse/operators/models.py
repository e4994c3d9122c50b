"""Baselines, smoothed priors and P(alive) proxies as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.exprs import null_safe_join
from orderpulse.operators.ranking import pct_rank, quantiles
from orderpulse.schemas import ENTITY


def rule_scores(features: DataFrame) -> DataFrame:
    o, q = "order_count_last_{}m_asof_cutoff", "purchase_quantity_sum_last_{}m_asof_cutoff"

    def drop(c: str) -> str:
        return f"coalesce(least(greatest(1 - {c.format(3)} / nullif({c.format(12)} / 4D, 0D), 0D), 1D), 0D)"

    m = "months_since_last_purchase_asof_cutoff"
    med = "nullif(median_purchase_interval_days_asof_cutoff / 30.4375D, 0D)"
    late = f"if({med} is null, 0D, least(greatest({m} / {med} - 1, 0D), 1D))"
    return features.selectExpr(
        "*", f"0.35D * least({m} / 12D, 1D) + 0.25D * {late} + 0.20D * {drop(o)} + 0.20D * {drop(q)} as rule_score",
        "purchase_count_asof_cutoff >= 3 and active_month_count_asof_cutoff >= 2 as recurring_candidate",
    )


def one_shot_silence(features: DataFrame, by: Sequence[str], score: str, quantile: float = 0.8, lookback: int = 12, silence: int = 3) -> DataFrame:
    """One-shot rows with a high value in their group that have been silent for some months."""
    limit = quantiles(features, by, score, {"_limit": quantile})
    flagged = null_safe_join(features, limit, by)
    return flagged.withColumn(
        "one_shot_high_value_silence_flag",
        F.expr(
            f"""purchase_count_asof_cutoff = 1 and months_since_first_purchase_asof_cutoff <= {lookback} and {score} >= _limit
                and months_since_last_purchase_asof_cutoff >= {silence}"""
        ),
    ).withColumn("one_shot_business_priority_score", F.expr(f"if(one_shot_high_value_silence_flag, {score}, 0D)")).drop("_limit")


BUCKET = "case when {0} <= 1 then '0_1' when {0} <= 3 then '2_3' when {0} <= 6 then '4_6' when {0} <= 12 then '7_12' else '12_plus' end"


def hazard_baseline(rows: DataFrame, train: str) -> DataFrame:
    """Mean training label per horizon x recency x frequency x shape bucket, global rate where a bucket is unseen."""
    b = rows.withColumns({"recency_bucket": F.expr(BUCKET.format("recency")), "frequency_bucket": F.expr(BUCKET.format("n_orders"))})
    keys = ["horizon", "recency_bucket", "frequency_bucket", "demand_shape_label"]
    t = b.where(train)
    overall = t.agg(F.avg("y")).scalar()
    joined = null_safe_join(b, t.groupBy(*keys).agg(F.avg("y").alias("hazard_rate")), keys)
    return joined.withColumn("_overall", overall).withColumn("score", F.coalesce("hazard_rate", "_overall")).drop("_overall")


def rank_probability(rows: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    base = rows.groupBy(*by).agg(F.avg("y").alias("_base"))
    ranked = null_safe_join(pct_rank(rows, score, by, "_rank", digits=8), base, by)
    return ranked.withColumn("probability", F.expr("least(greatest(_base * (0.5D + coalesce(_rank, 0.5D)), 0D), 1D)")).drop("_base", "_rank")


# Fixed values.
PRIOR_GROUPS = {
    "manufacturer": ["manufacturer_code"], "drug_category": ["drug_category_code"], "province": ["province_code"],
    "hospital_level": ["hospital_level_code"], "manufacturer_drug_category": ["manufacturer_code", "drug_category_code"],
}


def group_priors(reference: DataFrame, label: str, strength: float = 20.0) -> DataFrame:
    """Bayesian-smoothed repeat rate of every group set; one GROUPING SETS pass over counted rows."""
    dims = ["manufacturer_code", "drug_category_code", "province_code", "hospital_level_code"]
    counts = reference.where(F.col(label).isNotNull()).groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    overall = reference.agg(F.avg(label)).scalar()
    agg = counts.groupingSets([[F.col(c) for c in cols] for cols in PRIOR_GROUPS.values()], *dims).agg(
        F.sum("n").alias("group_count"), F.sum("pos").alias("group_positive_count"), *[F.grouping(c).alias(f"_g_{c}") for c in dims]
    )
    name = key = None
    for level, cols in PRIOR_GROUPS.items():
        cond = F.lit(True)
        for c in dims:
            cond &= F.col(f"_g_{c}") == (0 if c in cols else 1)
        text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols])
        name = F.when(cond, F.lit(level)) if name is None else name.when(cond, F.lit(level))
        key = F.when(cond, text) if key is None else key.when(cond, text)
    return agg.withColumn("global_repeat_rate", overall).select(
        name.alias("group_name"), key.alias("group_key"), "group_count", "group_positive_count", "global_repeat_rate",
        F.expr(f"(group_positive_count + global_repeat_rate * {strength}D) / (group_count + {strength}D)").alias("smoothed_repeat_rate"),
    )


def attention_scores(df: DataFrame, probability: str, value: str) -> DataFrame:
    r, v = f"least(greatest({probability}, 0D), 1D)", f"coalesce({value}, 1D)"
    return df.selectExpr(
        "*", f"(1 - {r}) * {v} as retention_risk_score", f"{r} * {v} as conversion_opportunity_score", f"{r} * (1 - {r}) * {v} as balanced_attention_score"
    )


def interval_proxy(units: DataFrame) -> DataFrame:
    i = "coalesce(nullif(median_interval_days, 0D), nullif(mean_interval_days, 0D))"
    return units.selectExpr(
        "*", f"if({i} > 0, 1D / (1D + greatest(0D, days_since_last_purchase / {i} - 0.5D)), null) as p_alive",
        f"if({i} > 0, if(purchase_count_365d >= 2, 0.35D, 0.2D), 0.1D) as confidence",
    )


COHORTS = [
    ("strict", ["product_line_code", "org_level", "province_code", "demand_profile"]),
    ("product_province", ["product_line_code", "province_code"]), ("product_line", ["product_line_code"]), ("global", []),
]


def unit_intervals(orders: DataFrame, as_of: str, unit: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Histogram of purchase gaps per unit: (unit, gap, n); gaps are whole days, so it is small for any unit."""
    days = orders.where(F.col("order_date") <= F.to_date(F.lit(as_of))).dropna(subset=list(unit)).groupBy(*unit, "order_date").agg(
        *[F.min(a).alias(a) for a in attributes]
    )
    w = Window.partitionBy(*unit).orderBy("order_date")
    return days.withColumn("gap", F.datediff("order_date", F.lag("order_date").over(w)))


def interval_survival(orders: DataFrame, as_of: str, unit: Sequence[str], k: float = 5.0, min_cohort: int = 20, min_unit: int = 3) -> DataFrame:
    """P(alive): share of own gaps >= the days since the last purchase, shrunk to the first large enough cohort.

    Cohort counts "gaps >= d" are cumulative sums over gap values per cohort; the unit's own gaps are subtracted.
    """
    g = unit_intervals(orders, as_of, unit, ["org_level", "province_code"])
    own = g.groupBy(*unit).agg(
        F.count("gap").alias("n"), F.avg("gap").alias("mean_gap"), F.max("order_date").alias("last"),
        F.min("org_level").alias("org_level"), F.min("province_code").alias("province_code"),
    ).withColumn("d", F.datediff(F.to_date(F.lit(as_of)), "last")).withColumn(
        "demand_profile", F.expr("case when n < 2 then 'cold_start' when mean_gap <= 35 then 'smooth' when mean_gap <= 75 then 'erratic' else 'intermittent' end")
    )
    gaps = g.where("gap is not null").groupBy(*unit, "gap").agg(F.count(F.lit(1)).alias("c")).join(
        own.select(*unit, "org_level", "province_code", "demand_profile", "d"), list(unit)
    )
    mine = gaps.groupBy(*unit).agg(F.expr("sum(if(gap >= d, c, 0)) as own_ge"))
    out = own.join(mine, list(unit), "left").withColumn("own_ge", F.coalesce("own_ge", F.lit(0)))
    for name, keys in COHORTS:
        by = list(keys)
        hist = gaps.groupBy(*by, "gap").agg(F.sum("c").alias("c"))
        # For every distinct (cohort, d): how many cohort gaps are >= d, from a reverse running sum.
        asks = own.select(*by, F.col("d").alias("gap")).distinct().withColumn("c", F.lit(0))
        both = hist.unionByName(asks).groupBy(*by, "gap").agg(F.sum("c").alias("c"))
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("gap"))
        cum = both.withColumns({f"{name}_ge": F.sum("c").over(w), f"{name}_n": F.sum("c").over(Window.partitionBy(*(by or [F.lit(0)])))})
        out = null_safe_join(out, cum.select(*by, F.col("gap").alias("d"), f"{name}_ge", f"{name}_n"), [*by, "d"])
    level = "case " + " ".join(f"when {n}_n - n >= {min_cohort} then '{n}'" for n, _ in COHORTS[:-1]) + " else 'global' end"
    pick = lambda s: "case cohort_level " + " ".join(f"when '{n}' then {n}_{s}" for n, _ in COHORTS) + " end"
    out = out.withColumn("cohort_level", F.expr(level)).selectExpr(
        "*", f"({pick('ge')} - own_ge) / nullif({pick('n')} - n, 0) as p_cohort_raw", f"{pick('n')} - n as cohort_n", "own_ge / nullif(n, 0) as p_unit_raw",
        f"n / (n + {k}D) as w",
    )
    return out.selectExpr(
        *unit, "n", "d", "mean_gap", "demand_profile", "cohort_level", "coalesce(p_unit_raw, p_cohort_raw) as p_unit", "coalesce(p_cohort_raw, p_unit_raw) as p_cohort",
        "round(least(greatest(w * coalesce(p_unit_raw, p_cohort_raw) + (1 - w) * coalesce(p_cohort_raw, p_unit_raw), 0D), 1D), 4) as p_alive",
        f"round(least(0.9D, 0.15D + 0.65D * w + least(cohort_n, 20) / 100D, if(n < {min_unit}, 0.35D, 1D)), 4) as confidence",
    )


def intermittent_proxy(units: DataFrame, multiplier: float = 1.5) -> DataFrame:
    line = f"greatest(mean_gap * {multiplier}D, 1D)"
    return units.selectExpr(
        "*", f"round(1D / (1D + greatest(0D, d - mean_gap) / {line}), 4) as p_intermittent",
        "least(0.25D + least(n, 10) / 25D, if(demand_profile in ('intermittent', 'lumpy'), 0.8D, 0.45D), if(n < 3, 0.35D, 1D)) as intermittent_confidence",
    )


def select_p_alive(units: DataFrame) -> DataFrame:
    use = "demand_profile in ('intermittent', 'lumpy') and p_intermittent is not null"
    return units.selectExpr(
        "*", f"if({use}, 'intermittent_overdue_proxy', if(p_alive is not null, 'interval_survival_proxy', 'not_available')) as selected_model_name",
        f"if({use}, p_intermittent, p_alive) as selected_p_alive", f"if({use}, intermittent_confidence, confidence) as model_confidence",
    )
