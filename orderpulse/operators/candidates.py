"""Candidate selection, top-k policies, worklists and pool audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.exprs import labels_where, null_safe_join, truth
from orderpulse.operators.ranking import exact_rank, exact_ranks, first_rows, pct_ranks
from orderpulse.schemas import ENTITY

GROUP = ["horizon", "cutoff_month"]


def policy_scores(df: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Percent ranks of probability, interval, frequency and value; priority = probability rank x value rank."""
    names = {"p": "probability_rank_score", "overdue": "interval_rank_score", "decay": "frequency_rank_score", "v": "_value_rank"}
    out = pct_ranks(df, names, by, digits=8)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in names.values() if c != "_value_rank"}
    return out.withColumns(zero).withColumn(
        "business_priority_score", F.col("probability_rank_score") * F.coalesce("_value_rank", F.lit(0.5))
    ).drop("_value_rank")


def select_recurring(df: DataFrame) -> DataFrame:
    """Full recurring universe with high-risk flag, global rank and rank per manufacturer."""
    scored = policy_scores(df.where("sample_class = 'recurring'").dropDuplicates(["candidate_id", "cutoff_month"]))
    scored = scored.withColumns({"is_high_risk_candidate": F.col("p") >= 0.7, "_neg": -F.col("business_priority_score")})
    specs = [("p", [], "rank_global"), ("p", ["manufacturer_code"], "rank_per_manufacturer")]
    ranked = exact_ranks(scored, specs, ["_neg", "candidate_id", "cutoff_month"], spread=1)
    return ranked.drop("_neg").withColumns(
        {"candidate_policy": F.lit("full_recurring_universe"), "selection_reason": F.lit("recurring_eligible")}
    )


def top_pct(df: DataFrame, score: str, pct: float, by: Sequence[str] = GROUP, name: str = "is_top", ties: Sequence[str] = ENTITY) -> DataFrame:
    """Flag of the best ceil(n x pct) rows of each group, at least one."""
    r = exact_rank(df, score, by, ties, name="_r", total="_n")
    return r.withColumn(name, F.expr(f"_r <= greatest(1, cast(ceil(_n * {pct!r}D) as int))")).drop("_r", "_n")


POLICY_SCORES = {
    "probability_top10": "probability_rank_score", "interval_top10": "interval_rank_score",
    "frequency_top10": "frequency_rank_score", "business_priority_top10": "business_priority_score",
}


def recall_union(scored: DataFrame, pct: float = 0.10, by: Sequence[str] = GROUP) -> DataFrame:
    """Four top sets and their union as flags."""
    specs = [(score, by, f"_r_{name}") for name, score in POLICY_SCORES.items()]
    out = exact_ranks(scored, specs, ENTITY, total="_n")
    flags = {name: F.expr(f"_r_{name} <= greatest(1, cast(ceil(_n * {pct!r}D) as int))") for name in POLICY_SCORES}
    out = out.withColumns(flags).drop("_n", *[f"_r_{name}" for name in POLICY_SCORES])
    return out.withColumn("multi_recall_union_top10", F.expr(" or ".join(POLICY_SCORES)))


def manufacturer_worklist(df: DataFrame, n: int = 50) -> DataFrame:
    """Top n per manufacturer, cutoff and horizon: high-risk first, then by probability."""
    order = [F.desc("is_high_risk_candidate"), F.desc_nulls_last("p"), F.asc("entity_id")]
    return first_rows(df, ["manufacturer_code", *GROUP], order, n)


# Value sources in order: column, multiplier, name of the source.
VALUE_SOURCES = [
    ("historical_avg_monthly_amount_asof_cutoff", 1.0, "historical_avg_monthly_amount_asof_cutoff"),
    ("purchase_amount_sum_last_12m_asof_cutoff", 1 / 12, "purchase_amount_sum_last_12m_asof_cutoff_div_12"),
    ("purchase_amount_sum_last_6m_asof_cutoff", 1 / 6, "purchase_amount_sum_last_6m_asof_cutoff_div_6"),
    ("purchase_amount_sum_last_3m_asof_cutoff", 1 / 3, "purchase_amount_sum_last_3m_asof_cutoff_div_3"),
]


def relative_value(df: DataFrame, horizon: Column) -> DataFrame:
    have = [(c, m, s) for c, m, s in VALUE_SOURCES if c in df.columns]
    monthly = F.coalesce(*[F.col(c) * m for c, m, _ in have])
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), s) for c, _, s in have], F.lit(""))
    return df.withColumns(
        {
            "relative_value_at_risk_H": F.when(monthly.isNotNull(), F.greatest(monthly * horizon, F.lit(0.0))),
            "relative_value_source": source,
            "value_missing": monthly.isNull(),
        }
    )


def priority_ranks(df: DataFrame, score: str = "prio") -> DataFrame:
    specs = [(score, GROUP, "rank_global"), (score, [*GROUP, "manufacturer_code"], "rank_within_manufacturer")]
    return exact_ranks(df, specs, ENTITY, total="_n")


def top_pct_with_fill(df: DataFrame, pct: float = 0.05, minimum: int = 3, score: str = "prio") -> DataFrame:
    """Best share of every group plus the next best rows of manufacturers below the minimum.

    The shortage is a count per manufacturer; at most `minimum` unselected rows per manufacturer can be needed, so
    they are found with a grouped limit instead of a second full ranking.
    """
    ranked = priority_ranks(df.where(F.col(score).isNotNull()), score)
    ranked = ranked.withColumn("_top", F.expr(f"rank_global <= greatest(1, cast(ceil(_n * {pct!r}D) as int))"))
    key = [*GROUP, "manufacturer_code"]
    need = ranked.groupBy(*key).agg(
        F.expr(f"greatest(least(count(1), {minimum}) - count_if(_top), 0) as need"), F.expr(f"count(1) < {minimum} as thin")
    )
    rest = first_rows(ranked.where("not _top").withColumn("_order", F.col(score)), key, [F.desc("_order"), F.col("rank_within_manufacturer")], minimum)
    w = F.row_number().over(_by(key, [F.desc("_order"), F.col("rank_within_manufacturer")]))
    fill = null_safe_join(rest.withColumn("_i", w), need, key).where("_i <= need").withColumn(
        "selection_reason", F.expr("if(thin, 'available_entities_less_than_minimum', 'manufacturer_min_fill')")
    )
    top = ranked.where("_top").withColumn("selection_reason", F.lit("global_top5pct"))
    return top.unionByName(fill.select(*top.columns)).drop("_top", "_n")


def _by(key, order):
    from pyspark.sql import Window

    return Window.partitionBy(*key).orderBy(*order)


def fill_audit(selected: DataFrame) -> DataFrame:
    return selected.groupBy(*GROUP, "selection_reason").agg(
        F.count(F.lit(1)).alias("selected_row_count"), F.countDistinct("manufacturer_code").alias("manufacturer_count")
    )


def collapse_horizons(selected: DataFrame, default: int = 6, score: str = "prio") -> DataFrame:
    """One row per entity and cutoff: the default horizon if selected, else the best score."""
    best = F.struct((F.col("h") == default).cast("int").alias("_pref"), F.col(score).alias("_s"), (-F.col("h")).alias("_h"))
    agg = selected.groupBy("entity_id", *ENTITY, "cutoff_month").agg(
        F.max_by(F.struct("horizon", "p", "v", score, "rank_global", "demand_shape_label"), best).alias("b"),
        F.expr("array_join(transform(array_sort(collect_set(h)), x -> concat('H', x)), ',')").alias("selected_horizons"),
        F.array_join(F.array_sort(F.collect_set("selection_reason")), ";").alias("candidate_selection_reasons"),
    )
    return agg.select(
        "entity_id", *ENTITY, "cutoff_month", "selected_horizons", "candidate_selection_reasons",
        F.col("b.horizon").alias("primary_horizon"), F.col("b.p").alias("primary_churn_probability"),
        F.col("b.v").alias("primary_relative_value_at_risk"), F.col(f"b.{score}").alias("primary_priority_score"),
        F.col("b.rank_global").alias("rank_global_primary_horizon"), F.col("b.demand_shape_label").alias("demand_shape_label"),
    )


def one_shot_attention(features: DataFrame) -> DataFrame:
    values = [c for c, _, _ in VALUE_SOURCES if c in features.columns]
    return features.where("sample_class = 'one_shot'").select(
        *ENTITY, "cutoff_month", F.col("first_purchase_month_asof_cutoff").alias("first_purchase_month"),
        F.coalesce(*values).alias("one_shot_value_score"), F.lit("one_shot_high_value_attention_passthrough").alias("attention_reason"),
        F.lit(False).alias("probability_available"),
    )


def observation_list(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Intermittent H3 and lumpy rows above the threshold: shown for observation only."""
    hit = df.where(f"p >= {threshold} and ((demand_shape_label = 'intermittent' and h = 3) or demand_shape_label = 'lumpy')")
    lumpy = F.col("demand_shape_label") == "lumpy"
    return hit.withColumns(
        {
            "demand_shape_route": F.when(lumpy, "observation_only").otherwise("longer_horizon_only"),
            "observation_reason": F.when(lumpy, "lumpy_high_risk_low_confidence").otherwise("intermittent_H3_observation_only"),
            "recommended_observation_window": F.when(lumpy, "H12_or_observation_only").otherwise("H12"),
        }
    )


def display_ready(obs: DataFrame, primary: str = "H12", quantile: float = 0.8, n: int = 20) -> DataFrame:
    """Latest cutoff, enough history and a strong signal; top n per manufacturer."""
    by = ["cutoff_month", "horizon", "manufacturer_code"]
    ranked = pct_ranks(obs, {"p": "probability_quantile", "v": "value_quantile"}, by, digits=8)
    latest = obs.agg(F.max("cutoff_month")).scalar()
    signal = (
        (F.col("horizon") == primary) | (F.col("probability_quantile") >= quantile) | (F.col("value_quantile") >= quantile)
        | (F.col("demand_shape_route") == "observation_only")
    )
    work = ranked.withColumn("_latest", latest).withColumns(
        {
            "filter_latest": F.col("cutoff_month") == F.col("_latest"),
            "filter_history": F.col("history_sufficiency_flag") != "history_insufficient",
            "filter_signal": truth(signal),
            "display_priority_score": F.greatest("probability_quantile", "value_quantile"),
        }
    ).drop("_latest")
    kept = work.where("filter_latest and filter_history and filter_signal").withColumn("_primary", (F.col("horizon") == primary).cast("int"))
    order = [F.desc("_primary"), F.desc("display_priority_score"), F.desc("p"), F.asc("entity_id"), F.asc("horizon")]
    top = first_rows(kept, ["manufacturer_code"], order, n)
    reason = F.expr(
        f"""case when horizon = '{primary}' then 'primary_horizon_{primary}' when probability_quantile >= {quantile} then 'probability_top20pct'
            when value_quantile >= {quantile} then 'value_top20pct' else 'explicit_observation_only_guardrail' end"""
    )
    return top.withColumn("display_ready_reason", reason).drop("_primary")


def display_audit(obs: DataFrame) -> DataFrame:
    """Rows that remain after each filter stage."""
    latest = obs.agg(F.max("cutoff_month")).scalar()
    a = obs.withColumn("_latest", latest).agg(
        F.count(F.lit(1)).alias("raw"), F.expr("count_if(cutoff_month = _latest) as latest_cutoff"),
        F.expr("count_if(cutoff_month = _latest and history_sufficiency_flag <> 'history_insufficient') as history_sufficiency"),
    )
    return a.unpivot([], a.columns, "filter_stage", "row_count")


def pool_overlap(pools: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Membership combination of each entity over several pools, counted: one union and one aggregate instead of outer joins."""
    parts = None
    for name, df in pools.items():
        part = df.select(*key).distinct().withColumn("_pool", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    per = parts.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("_pool")), "+").alias("pools"))
    return per.groupBy("pools").agg(F.count(F.lit(1)).alias("entity_count"))


#: The pools in the order in which they are shown; a row is shown in the first that holds it.
DISPLAY_POOLS = ["recurring_business_priority", "demand_shape_observation", "one_shot_attention"]


def display_overlap(recurring: DataFrame, observation: DataFrame, one_shot: DataFrame) -> DataFrame:
    """Per entity and cutoff of the first two pools: the pool that shows it and those that are suppressed.

    An entity counts as one-shot at every cutoff if it is one at any.
    """
    key, flags = ["entity_id", "cutoff_month"], [f"in_{p}" for p in DISPLAY_POOLS]
    first = recurring.select(*key, F.lit(True).alias(flags[0]), F.lit(False).alias(flags[1]))
    second = observation.select(*key, F.lit(False).alias(flags[0]), F.lit(True).alias(flags[1]))
    held = first.unionByName(second).groupBy(*key).agg(*[F.bool_or(c).alias(c) for c in flags[:2]])
    once = one_shot.select("entity_id").distinct().withColumn(flags[2], F.lit(True))
    marked = held.join(once, "entity_id", "left").fillna(False, [flags[2]])
    pools = labels_where([(F.col(c), p) for c, p in zip(flags, DISPLAY_POOLS, strict=True)])
    return marked.withColumn("_p", pools).select(
        *key, *flags, F.get("_p", F.lit(0)).alias("recommended_display_bucket"), F.array_join(F.slice("_p", 2, len(DISPLAY_POOLS)), ";").alias("suppressed_display_sources"))


def row_decomposition(df: DataFrame) -> DataFrame:
    """Distinct counts at row, entity x cutoff and entity grain."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("entity_id", "cutoff_month").alias("entity_cutoff_count"),
        F.countDistinct("entity_id").alias("entity_count"), F.countDistinct("manufacturer_code").alias("manufacturer_count"),
        F.countDistinct("cutoff_month").alias("cutoff_count"),
    ).withColumn(
        "expansion_reasons",
        F.array_join(
            labels_where(
                [
                    (F.col("row_count") > F.col("entity_cutoff_count"), "multiple_horizons_per_entity_cutoff"),
                    (F.col("entity_cutoff_count") > F.col("entity_count"), "multiple_cutoffs_per_entity"),
                ]
            ), ";",
        ),
    )


def policy_evaluation(flagged: DataFrame, policies: Sequence[str], by: Sequence[str] = GROUP) -> DataFrame:
    """Recall, lift against non-candidates, load and manufacturer coverage of every policy in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum("y").alias("pos")]
    for i, f in enumerate(policies):
        aggs += [
            F.expr(f"count_if({f}) as n{i}"), F.expr(f"sum(if({f}, y, 0)) as y{i}"),
            F.expr(f"count(distinct if({f}, manufacturer_code, null)) as m{i}"),
        ]
    wide = flagged.groupBy(*by).agg(*aggs)
    rows = ", ".join(
        f"""named_struct('policy', '{f}', 'candidate_count', n{i}, 'candidate_rate', n{i} / rows, 'recall', y{i} / nullif(pos, 0),
            'lift_vs_rest', (y{i} / nullif(n{i}, 0)) / nullif((pos - y{i}) / nullif(rows - n{i}, 0), 0D), 'manufacturer_coverage', m{i})"""
        for i, f in enumerate(policies)
    )
    return wide.selectExpr(*by, f"inline(array({rows}))")


def policy_overlap(flagged: DataFrame, policies: Sequence[str], by: Sequence[str] = GROUP) -> DataFrame:
    """Shared rows of every two policies per group: overlap, union, Jaccard share and share of the first one's rows.

    Each row carries its policies as the bits of one number; rows are counted per number once, and all pairs are sums
    over those few counts (2 to the power of the policies at most), whatever the number of rows.
    """
    bits = " + ".join(f"if(coalesce({f}, false), {1 << i}, 0)" for i, f in enumerate(policies))
    counted = flagged.withColumn("_bits", F.expr(f"cast({bits} as bigint)")).groupBy(*by, "_bits").agg(F.count(F.lit(1)).alias("_n"))
    aggs, rows = [], []
    for i, a in enumerate(policies):
        for j, b in enumerate(policies):
            if i >= j:
                continue
            both = (1 << i) | (1 << j)
            aggs += [F.expr(f"sum(if(_bits & {both} = {both}, _n, 0)) as both{i}_{j}"), F.expr(f"sum(if(_bits & {both} <> 0, _n, 0)) as any{i}_{j}"), F.expr(f"sum(if(_bits & {1 << i} <> 0, _n, 0)) as one{i}_{j}")]
            rows.append(f"named_struct('policy', '{a}', 'other_policy', '{b}', 'overlap_count', both{i}_{j}, 'union_count', any{i}_{j}, "
                        f"'jaccard', both{i}_{j} / nullif(any{i}_{j}, 0), 'share_of_policy', both{i}_{j} / nullif(one{i}_{j}, 0))")
    return counted.groupBy(*by).agg(*aggs).selectExpr(*by, f"inline(array({', '.join(rows)}))")


def recommend_policy(evaluation: DataFrame) -> DataFrame:
    """Mean recall and lift per policy, best recall first, then lift, then lighter load."""
    mean = evaluation.groupBy("policy").agg(
        F.avg("recall").alias("mean_recall"), F.avg("lift_vs_rest").alias("mean_lift"), F.avg("candidate_rate").alias("mean_rate")
    )
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("_r"), F.desc("_l"), F.asc("policy"))
    rounded = mean.withColumns({"_r": F.round("mean_recall", 6), "_l": F.round("mean_lift", 6)})
    return rounded.withColumn("is_recommended", F.row_number().over(w) == 1).drop("_r", "_l")


def worklist_capacity(df: DataFrame, sizes: Sequence[int] = (20, 50)) -> DataFrame:
    """Rows kept at several sizes per manufacturer and their positive rate."""
    top = first_rows(df, ["manufacturer_code", *GROUP], [F.desc("p"), F.asc("entity_id")], max(sizes))
    i = F.row_number().over(_by(["manufacturer_code", *GROUP], [F.desc("p"), F.asc("entity_id")]))
    rows = ", ".join(f"named_struct('capacity', {s}, 'kept', _i <= {s})" for s in sizes)
    long = top.withColumn("_i", i).selectExpr("horizon", "y", f"inline(array({rows}))").where("kept")
    return long.groupBy("horizon", "capacity").agg(F.count(F.lit(1)).alias("rows_kept"), F.avg("y").alias("positive_rate"))


def capped_scope(df: DataFrame, cap: int = 10) -> DataFrame:
    """All recurring rows, the others capped per manufacturer and class by value."""
    keep = df.where("sample_class = 'recurring'")
    rest = first_rows(df.where("sample_class <> 'recurring'"), ["manufacturer_code", "sample_class"], [F.desc("v"), F.asc("entity_id")], cap)
    return keep.unionByName(rest)


def availability_gate(df: DataFrame, subset_caveat: bool = True, leakage_clean: bool = True) -> DataFrame:
    """Whether a probability may be shown: allowed, band, observation or hidden, with reasons."""
    p = "least(greatest(p, 0D), 1D)"
    out = df.withColumn(
        "model_confidence_bucket",
        F.expr(f"case when {p} >= 0.7 then 'high' when {p} >= 0.45 then 'medium' when p is not null then 'low' else 'unavailable' end"),
    )
    hidden = f"one_shot or history_sufficiency_flag = 'history_insufficient' or p is null or {'false' if leakage_clean else 'true'}"
    out = out.withColumn("one_shot", F.col("sample_class") == "one_shot").withColumn(
        "probability_display_level",
        F.expr(
            f"""case when {hidden} then 'hidden_data_insufficient'
                when history_sufficiency_flag = 'history_sufficient' and demand_shape_label not in ('intermittent', 'lumpy', 'cold_start', 'unknown')
                  and model_confidence_bucket in ('high', 'medium') then 'probability_allowed'
                when history_sufficiency_flag = 'history_medium' or demand_shape_label in ('intermittent', 'lumpy') or model_confidence_bucket = 'low'
                  then 'risk_band_only' else 'observation_only' end"""
        ),
    )
    reasons = [
        (F.lit(not leakage_clean), "leakage_audit_not_clean"),
        (F.col("one_shot"), "one_shot_not_recurring_churn"),
        (F.col("history_sufficiency_flag") == "history_insufficient", "history_insufficient"),
        (F.col("history_sufficiency_flag") == "history_medium", "history_medium"),
        *[(F.col("demand_shape_label") == s, f"demand_shape_{s}") for s in ("intermittent", "lumpy", "cold_start", "unknown")],
        (F.lit(subset_caveat), "selected_subset_not_full_universe"),
    ]
    out = out.withColumn("_r", labels_where(reasons))
    return out.withColumn(
        "reason_code", F.when(F.size("_r") == 0, "stable_recurring_probability_allowed").otherwise(F.array_join("_r", "|"))
    ).withColumn("auto_dispatch_allowed", F.lit(False)).drop("_r")


def history_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distribution and missing rate of history columns per demand shape; the values are counted before the quantile."""
    rows = ", ".join(f"named_struct('column', '{c}', 'value', cast({c} as double))" for c in columns)
    long = df.selectExpr("demand_shape_label", f"inline(array({rows}))").groupBy("demand_shape_label", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("demand_shape_label", "column").agg(
        F.expr("sum(n) as row_count"), F.expr("sum(value * n) / sum(if(value is null, 0, n)) as mean"),
        F.expr("percentile(value, 0.25D, n) as p25"), F.expr("percentile(value, 0.5D, n) as median"), F.expr("percentile(value, 0.75D, n) as p75"),
        F.expr("sum(if(value is null, n, 0)) / sum(n) as missing_rate"), F.expr("sum(if(value < 3, n, 0)) / sum(n) as share_below_3"),
    )


def bucket_audit(df: DataFrame) -> DataFrame:
    """Counts per shape, reason, metric and fixed bucket of probability and value."""
    long = df.selectExpr(
        "demand_shape_label", "observation_reason",
        """inline(array(
           named_struct('metric', 'probability', 'bucket', case when p >= 0.9 then '>=0.9' when p >= 0.8 then '0.8-0.9' when p >= 0.7 then '0.7-0.8' else '<0.7' end),
           named_struct('metric', 'value', 'bucket', case when v is null then 'missing' when v <= 0 then '0' when v < 1000 then '<1k' when v < 10000 then '1k-10k' else '>=10k' end)))""",
    )
    return long.groupBy("demand_shape_label", "observation_reason", "metric", "bucket").agg(F.count(F.lit(1)).alias("row_count"))


def policy_by_manufacturer(flagged: DataFrame, policy: str) -> DataFrame:
    return flagged.groupBy("manufacturer_code").agg(
        F.count(F.lit(1)).alias("row_count"), F.expr(f"count_if({policy}) as candidate_count"),
        F.expr(f"count_if({policy}) / count(1) as candidate_rate"), F.expr(f"avg(if({policy}, y, null)) as candidate_positive_rate"),
    )
