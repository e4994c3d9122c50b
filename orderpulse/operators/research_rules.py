"""Monthly and statistical rules on survival-refined feature rows, evidence ids, FDR and corroboration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normal_upper_tail(z: str) -> str:
    """One-sided normal tail P(Z > z) as SQL text, erfc(z / sqrt 2) / 2, to about 1e-14.

    Below |z| = 3.5 the series z e^(-z^2/2) sum z^2n / (2n+1)!! (terms of one sign), beyond it the continued fraction
    1/(z + 1/(z + 2/(z + 3/(z + ...)))).
    """
    x = f"abs({z})"
    density = f"exp(-{x} * {x} / 2) / sqrt(2 * pi())"
    series = f"""0.5D - {density} * aggregate(sequence(1, 80), named_struct('t', {x}, 's', {x}),
        (a, n) -> named_struct('t', a.t * {x} * {x} / (2 * n + 1), 's', a.s + a.t * {x} * {x} / (2 * n + 1)), a -> a.s)"""
    fraction = f"{density} / aggregate(reverse(sequence(1, 80)), {x}, (a, n) -> {x} + n / a)"
    upper = f"if({x} < 3.5D, {series}, {fraction})"
    return f"if({z} >= 0, {upper}, 1 - ({upper}))"


def binomial_cdf(k: str, n: str, p: str) -> str:
    """P(X <= k) by a running log-coefficient fold, as SQL text."""
    return f"""case when {n} <= 0 or {k} is null or {n} is null then null when {k} >= {n} then 1D else
      aggregate(sequence(1, greatest(cast({k} as int), 1)),
        named_struct('c', 0D, 's', exp(cast({n} as double) * ln(1 - {p}))),
        (a, i) -> if(i > {k}, a, named_struct('c', a.c + ln(cast({n} as double) - i + 1) - ln(cast(i as double)),
          's', a.s + exp(a.c + ln(cast({n} as double) - i + 1) - ln(cast(i as double)) + i * ln({p}) + ({n} - i) * ln(1 - {p})))),
        a -> least(a.s, 1D)) end"""


# Monthly rules: detector, family, metric, hit condition, severity when hit, severity else, confidence, rows it applies to.
MONTHLY_RULES = [
    ("purchase_interval_overdue_warning", "interval", "coalesce(interval_overdue_baseline, 0D)", ">= 1.5", "medium", "low", "medium", "true"),
    ("purchase_frequency_fluctuation_warning", "frequency", "coalesce(frequency_ratio, 0D)", "< 0.5", "medium", "low", "medium", "true"),
    ("purchase_quantity_fluctuation_warning", "quantity", "coalesce(quantity_ratio, 0D)", "< 0.5", "low", "info", "low", "true"),
    ("terminal_loss_warning", "terminal", "churn_probability_H", ">= 0.6", "medium", "low", "medium", "sample_class = 'recurring'"),
    ("new_terminal_detection", "one_shot", "0D", ">= 0", "info", "info", "medium", "sample_class = 'one_shot'"),
]


def monthly_rules(scored: DataFrame) -> DataFrame:
    rows = ", ".join(
        f"""if({scope}, named_struct('detector_name', '{d}', 'detector_family', '{f}', 'hit_flag', {m} {cond},
            'severity', if({m} {cond}, '{s1}', '{s0}'), 'confidence', '{c}', 'metric_value', cast({m} as double)), null)"""
        for d, f, m, cond, s1, s0, c, scope in MONTHLY_RULES
    )
    return scored.selectExpr(
        "candidate_id", "entity_id", "horizon", "cutoff_month", f"inline(filter(array({rows}), x -> x is not null))"
    )


_OVERDUE = "survival_state in ('materially_overdue', 'likely_churn_interval')"
_FLOOR = """case when survival_state = 'likely_churn_interval' then greatest(least(coalesce(overdue_ratio, 0D) / 3 * 100, 100D), 80D)
    when survival_state = 'materially_overdue' then greatest(least(coalesce(overdue_ratio, 0D) / 3 * 100, 100D), 60D)
    else least(coalesce(overdue_ratio, 0D) / 3 * 100, 100D) end"""
_SURE = """least(coalesce(survival_confidence, 0D), if(history_sufficiency_flag <> 'history_sufficient', 0.6D, 1D),
    if(demand_shape_label in ('intermittent', 'lumpy'), 0.6D, 1D))"""


def terminal_loss(df: DataFrame) -> DataFrame:
    hit = f"({_OVERDUE} and demand_shape_route <> 'observation_only')"
    return df.selectExpr(
        "entity_id", "cutoff_month", "'terminal_dynamic' as detector_family", "'terminal_loss_warning' as detector_name", f"{hit} as hit_flag",
        f"if({hit}, {_FLOOR}, 0D) as severity", f"{_SURE} as confidence",
        f"case when demand_shape_route = 'observation_only' then 'observation_only_guardrail' when {hit} then survival_state else 'not_overdue_enough' end as reason_code",
    )


def frequency_fluctuation(df: DataFrame) -> DataFrame:
    d = df.selectExpr(
        "*", "(order_count_last_3m_asof_cutoff / 3D) / nullif(order_count_last_12m_asof_cutoff / 12D, 0D) as d3",
        "(order_count_last_6m_asof_cutoff / 6D) / nullif(order_count_last_12m_asof_cutoff / 12D, 0D) as d6",
    )
    hit = "coalesce(d3 < 0.5 or d6 < 0.6, false)"
    return d.selectExpr(
        "entity_id", "cutoff_month", "'sales_fluctuation' as detector_family", "'purchase_frequency_fluctuation_warning' as detector_name",
        f"{hit} as hit_flag", f"if({hit}, greatest(least(greatest((0.5D - d3) / 0.5D * 100, 0D), 100D), least(greatest((0.6D - d6) / 0.6D * 100, 0D), 100D)), 0D) as severity",
        """if(d3 is null and d6 is null, null, least(if(history_sufficiency_flag = 'history_sufficient', 0.8D, 0.6D),
           if(order_count_last_12m_asof_cutoff < 3, 0.4D, 1D), if(demand_shape_label = 'lumpy', 0.5D, 1D))) as confidence""",
        """case when d3 is null and d6 is null then 'frequency_fields_missing' when d3 < 0.5 and d6 < 0.6 then 'frequency_drop_multi_window'
           when d3 < 0.5 then 'frequency_drop_3m' when d6 < 0.6 then 'frequency_drop_6m' else 'no_frequency_drop' end as reason_code""",
    )


def quantity_fluctuation(df: DataFrame) -> DataFrame:
    d = df.selectExpr("*", "(purchase_quantity_sum_last_3m_asof_cutoff / 3D) / nullif(historical_avg_monthly_quantity_asof_cutoff, 0D) as r")
    return d.selectExpr(
        "entity_id", "cutoff_month", "'sales_fluctuation' as detector_family", "'purchase_quantity_fluctuation_warning' as detector_name",
        "coalesce(r < 0.5 or r > 3, false) as hit_flag",
        "case when r < 0.5 then least(greatest((0.5D - r) / 0.5D * 100, 0D), 100D) when r > 3 then least((r - 3D) / 3D * 100, 100D) else 0D end as severity",
        "if(r is null, null, least(least(purchase_count_asof_cutoff / 6D, 0.8D), if(demand_shape_label = 'lumpy', 0.5D, 1D))) as confidence",
        "case when r is null then 'quantity_fields_missing' when r < 0.5 then 'quantity_drop' when r > 3 then 'quantity_spike' else 'no_quantity_fluctuation' end as reason_code",
    )


def one_shot_new_terminal(df: DataFrame) -> DataFrame:
    return df.where("sample_class = 'one_shot'").selectExpr(
        "entity_id", "cutoff_month", "'terminal_dynamic' as detector_family", "'new_terminal_detection' as detector_name",
        "first_purchase_month_asof_cutoff is not null as hit_flag", "40D as severity", "0.6D as confidence", "'first_seen' as reason_code",
    )


def interval_overdue_test(df: DataFrame) -> DataFrame:
    """Overdue rule with a normal-tail p-value of (days since - median gap) / MAD of the gaps, where the MAD is above 0."""
    d = df.selectExpr(
        "*",
        """if(purchase_interval_mad_days_asof_cutoff > 0, (months_since_last_purchase_asof_cutoff * 30.4375D - median_purchase_interval_days_asof_cutoff)
           / greatest(purchase_interval_mad_days_asof_cutoff, 1e-9D), null) as robust_z""",
    )
    hit = f"(coalesce(overdue_ratio >= 2, false) or {_OVERDUE}) and demand_shape_route <> 'observation_only'"
    return d.selectExpr(
        "entity_id", "cutoff_month", "'terminal_dynamic' as detector_family", "'purchase_interval_overdue_warning' as detector_name",
        f"{hit} as hit_flag", f"if({hit}, {_FLOOR}, 0D) as severity", f"least({_SURE}, if(demand_shape_route = 'observation_only', 0.4D, 1D)) as confidence",
        "robust_z", "robust_z is not null as fdr_eligible", f"if(robust_z is null, null, {normal_upper_tail('robust_z')}) as p_value",
        "if(robust_z is null, 'not_available_mad_missing', 'robust_interval_z_normal_approx') as p_value_method",
    )


def rate_drop_test(df: DataFrame) -> DataFrame:
    """Conditional binomial tests of the last 3 against the 9 months before and the last 6 against the 6 before."""
    o3, o6, o12 = (f"order_count_last_{m}m_asof_cutoff" for m in (3, 6, 12))
    d = df.selectExpr(
        "entity_id", "cutoff_month", "demand_shape_label", "history_sufficiency_flag", f"{o3} as o3", f"{o6} as o6", f"{o12} as o12",
        f"{o12} - {o3} as b9", f"{o12} - {o6} as b6",
    )
    d = d.selectExpr(
        "*", "(o3 / 3D) / greatest(b9 / 9D, 1e-9D) as ratio3", "(o6 / 6D) / greatest(b6 / 6D, 1e-9D) as ratio6",
        f"{binomial_cdf('o3', 'o12', '0.25D')} as p3", f"{binomial_cdf('o6', 'o12', '0.5D')} as p6",
    )
    d = d.selectExpr(
        "*", "coalesce(ratio3 < 0.6 and p3 <= 0.10 and b9 >= 3, false) as hit3", "coalesce(ratio6 < 0.7 and p6 <= 0.10 and b6 >= 3, false) as hit6",
        "greatest(least(greatest((1 - ratio3) * 100, 0D), 100D), least(greatest((1 - ratio6) * 100, 0D), 100D)) as sev",
    )
    return d.selectExpr(
        "entity_id", "cutoff_month", "'sales_fluctuation' as detector_family", "'purchase_frequency_decay_rate_test' as detector_name",
        "hit3 or hit6 as hit_flag", "if(hit3 or hit6, sev, least(sev, 39D)) as severity",
        """least(case when greatest(b9, b6) >= 6 then 0.8D when greatest(b9, b6) >= 3 then 0.6D else 0.4D end,
           if(demand_shape_label in ('intermittent', 'lumpy'), 0.5D, 1D), if(history_sufficiency_flag <> 'history_sufficient', 0.6D, 1D)) as confidence""",
        "least(p3, p6) as p_value", "p3 as p_value_3m", "p6 as p_value_6m",
        """case when hit3 and hit6 then 'frequency_drop_multi_window' when hit3 then 'frequency_drop_3m_vs_previous_9m' when hit6 then 'frequency_drop_6m_vs_previous_6m'
           when ratio3 < 0.6 or ratio6 < 0.7 then 'frequency_drop_not_statistically_supported' else 'no_frequency_rate_drop' end as reason_code""",
        "coalesce(least(p3, p6) is not null, false) as fdr_eligible",
        "if(least(p3, p6) is null, 'not_available', 'conditional_binomial') as p_value_method",
        "if(least(p3, p6) is null, 'not_evaluable', 'ok') as data_quality_status",
    )


#: What an evidence id is made of, in this order; fixed, ids are compared across runs.
EVIDENCE_PARTS = ["candidate_id", "detector_family", "detector_name", "detector_version", "cutoff_month", "horizon", "reason_code", "evidence_values"]


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """SHA-256 over the eight parts and its first 16 digits; a part that is absent or null is empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in evidence.columns else F.lit("") for c in EVIDENCE_PARTS]
    return evidence.withColumn("evidence_hash", F.sha2(F.concat_ws("|", *parts), 256)).withColumn("evidence_id", F.substring("evidence_hash", 1, 16))


def benjamini_hochberg(tests: DataFrame, by: list[str], q: float = 0.10, key: str = "entity_id") -> DataFrame:
    """Adjusted q-values per group: p x n / rank, then the running minimum from the largest p down.

    Ties share the largest rank, so the work is done on distinct p-values; cells keep a group out of one task, and the
    minimum across cells is joined from the small cell table.
    """
    from orderpulse.functions.exprs import null_safe_join
    from orderpulse.operators.ranking import cumulate, value_cell

    d = tests.where("p_value is not null").withColumn("_p", F.round("p_value", 10))
    counts = d.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    c = cumulate(counts, by, "_p", ["_n"]).withColumn("_raw", F.expr("_p * _n_total / (_n_before + _n)"))
    c = c.withColumn("_cell", value_cell(F.col("_p")))
    cells = c.groupBy(*by, "_cell").agg(F.min("_raw").alias("_min"))
    later = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_later", F.min("_min").over(later)).drop("_min")
    inside = Window.partitionBy(*by, "_cell").orderBy(F.desc("_p"))
    adj = null_safe_join(c, cells, [*by, "_cell"], "inner").withColumn(
        "fdr_q_value", F.least(F.min("_raw").over(inside), F.coalesce("_later", F.lit(1.0)), F.lit(1.0))
    )
    out = null_safe_join(d, adj.select(*by, "_p", "fdr_q_value"), [*by, "_p"], "inner").drop("_p")
    return out.withColumn("fdr_pass_flag", F.col("fdr_q_value") <= q)


# Detector, signal family it supports for recurring entities, whether its p-value goes through FDR.
SIGNAL_FAMILIES = [
    ("terminal_loss_warning", "terminal_dynamic", False),
    ("purchase_frequency_fluctuation_warning", "sales_frequency", False),
    ("purchase_quantity_fluctuation_warning", "sales_quantity", False),
    ("purchase_interval_overdue_warning", "terminal_dynamic", False),
    ("purchase_frequency_decay_rate_test", "sales_frequency", True),
]
STATISTICAL_TEST = "purchase_frequency_decay_rate_test"
# Fixed values.
GUARDRAILS = ["peer_suppressed", "policy_caveat", "systemic_delivery_caveat", "suppressed_by_l2"]


def corroboration(
    evidence: DataFrame, by: list[str] | None = None, guardrail: DataFrame | None = None, fdr_applied: bool = False,
) -> DataFrame:
    """Level by distinct signal families among effective hits: none, single_signal, provisional_fdr_ready (one family,
    a hit of the statistical test, FDR not applied yet), multi_signal; suppressed_by_l2 where a guardrail says so.

    Detectors without a family, rows that are not evaluable and, once FDR is applied, tests that failed it don't count.
    """
    by = by or ["entity_id", "cutoff_month"]
    family = F.coalesce(*[F.when(F.col("detector_name") == d, F.lit(f)) for d, f, _ in SIGNAL_FAMILIES])
    tested = F.col("detector_name").isin([d for d, _, t in SIGNAL_FAMILIES if t])
    hit = F.coalesce(F.col("hit_flag"), F.lit(False))
    counts = hit & family.isNotNull()
    if "data_quality_status" in evidence.columns:
        counts &= F.coalesce(F.lower("data_quality_status"), F.lit("")) != "not_evaluable"
    if fdr_applied:
        counts &= ~tested | F.coalesce(F.col("fdr_pass_flag"), F.lit(False))
    out = evidence.groupBy(*by).agg(
        F.countDistinct(F.when(counts, family)).alias("effective_family_count"), F.count_if(hit).alias("hit_count"),
        F.coalesce(F.bool_or(hit & (F.col("detector_name") == STATISTICAL_TEST)), F.lit(False)).alias("_test"),
    )
    if guardrail is not None:
        out = out.join(guardrail.select(*by, "l2_guardrail"), by, "left")
    held = F.col("l2_guardrail").isin(GUARDRAILS) if guardrail is not None else F.lit(False)
    level = (
        F.when(F.coalesce(held, F.lit(False)), "suppressed_by_l2").when(F.col("effective_family_count") == 0, "none")
        .when(F.col("effective_family_count") >= 2, "multi_signal")
        .when(F.col("_test") & F.lit(not fdr_applied), "provisional_fdr_ready").otherwise("single_signal")
    )
    return out.withColumn("corroboration_level", level).drop("_test", "l2_guardrail")


def closure_rules(df: DataFrame) -> DataFrame:
    rules = [
        ("terminal", "terminal_loss_warning", "terminal_count_last_12m_asof_cutoff > 0 and order_count_last_3m_asof_cutoff <= 0 and months_since_last_purchase_asof_cutoff >= 3"),
        ("interval", "purchase_interval_overdue_warning", "coalesce(overdue_ratio >= 1.2, false)"),
        ("frequency", "purchase_frequency_fluctuation_warning", "coalesce(1 - (order_count_last_3m_asof_cutoff / 3D) / nullif(order_count_last_12m_asof_cutoff / 12D, 0D) >= 0.5, false)"),
    ]
    rows = ", ".join(
        f"""named_struct('detector_family', '{f}', 'detector_name', '{d}', 'hit_flag', {c},
            'severity', if({c}, '{"medium" if f == "frequency" else "strong"}', 'none'))""" for f, d, c in rules
    )
    return df.selectExpr("entity_id", "cutoff_month", f"inline(array({rows}))")


def family_summary(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("detector_family", "detector_name").agg(
        F.count(F.lit(1)).alias("evaluated_count"), F.count_if("hit_flag").alias("hit_count"),
        (F.count_if("hit_flag") / F.count(F.lit(1))).alias("hit_rate"),
    )


def p_value_readiness(evidence: DataFrame) -> DataFrame:
    """Per detector: rows evaluated, p-values present and missing, rows fit for FDR, methods, and a note."""
    out = evidence.groupBy("detector_name").agg(
        F.count_if(F.coalesce(F.col("data_quality_status"), F.lit("")) != "not_evaluable").alias("evaluated_row_count"),
        F.count("p_value").alias("p_value_available_count"), F.count_if(F.col("p_value").isNull()).alias("p_value_missing_count"),
        F.count_if("fdr_eligible").alias("fdr_eligible_count"),
        F.array_join(F.array_sort(F.collect_set("p_value_method")), ";").alias("p_value_method"),
    )
    ready = (F.col("p_value_available_count") > 0) & (F.col("fdr_eligible_count") > 0)
    return out.withColumn("readiness_note", F.when(ready, "ready_for_future_fdr").otherwise("partial_or_not_ready_for_fdr"))
