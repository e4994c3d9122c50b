"""The ten daily rules as column expressions, their result, clue and evidence tables, and config profiles.

Every rule is a set of SQL expressions over one snapshot row. All rules are evaluated in a single projection and
turned into one row per rule by `inline`, so the snapshot is read once and nothing leaves the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.functions.exprs import entity_id, labels_where
from orderpulse.operators.ranking import sorted_rank
from orderpulse.schemas import ORDER_ENTITY

# Rule parameters.
SHRINK = {"smooth": 1.0, "erratic": 0.85, "intermittent": 0.75, "lumpy": 0.65}
GROW = {"smooth": 1.0, "erratic": 1.15, "intermittent": 1.3, "lumpy": 1.5}
DEFAULTS: dict[str, dict[str, object]] = {
    "purchase_interval_ipi": {
        "z_hit": 1.5, "z_full": 3.5, "mad_floor_days": 3.0, "min_purchase_count": 4.0, "confidence_n": 12.0,
    },
    "purchase_quantity_trend": {
        "drop_ratio_hit": 0.6, "min_baseline_quantity": 1.0, "confidence_n": 6.0, "demand_shape_modifiers": SHRINK,
    },
    "purchase_quantity_spike": {
        "spike_ratio_hit": 3.0, "min_baseline_quantity": 1.0, "confidence_n": 6.0, "demand_shape_modifiers": GROW,
    },
    "purchase_frequency_drop": {
        "freq_drop_ratio": 0.6, "min_base_rate": 1.0, "confidence_base_rate": 2.0, "demand_shape_modifiers": SHRINK,
    },
    "purchase_frequency_spike": {
        "freq_spike_ratio": 2.0, "min_base_rate": 1.0, "confidence_base_rate": 2.0, "demand_shape_modifiers": GROW,
    },
    "low_price_warning": {
        "reference_quantile": 0.05, "min_reference_order_count": 30.0, "min_reference_hospital_count": 5.0,
        "absolute_warning_prices": {},
    },
    "order_price_spread_warning": {"spread_ratio_threshold": 1.8, "min_order_count": 2.0},
    "purchase_price_level_shift": {
        "upper_ratio_threshold": 1.25, "lower_ratio_threshold": 0.8, "min_recent_order_count": 2.0,
        "min_baseline_order_count": 5.0,
    },
    "first_purchase_fact": {},
    "reactivated_purchase_fact": {"configured_gap_days": 180.0},
}
FAMILY = {
    "purchase_interval_ipi": "interval", "purchase_quantity_trend": "quantity", "purchase_quantity_spike": "quantity",
    "purchase_frequency_drop": "frequency", "purchase_frequency_spike": "frequency", "low_price_warning": "price",
    "order_price_spread_warning": "price", "purchase_price_level_shift": "price", "first_purchase_fact": "purchase_fact",
    "reactivated_purchase_fact": "purchase_fact",
}
VERSION = {d: f"{d}_v1" for d in DEFAULTS}

# p(parameter) -> SQL text of its value for the current row.
Param = Callable[[str], str]


def shape_modifier(modifiers: str) -> str:
    return f"coalesce(nullif(try_element_at({modifiers}, coalesce(demand_shape_label, 'smooth')), 0D), 1D)"


def price_reason(price: str, require_current: bool) -> str:
    today = "when not coalesce(current_purchase_flag, false) then 'no_purchase_on_observation_date'"
    return f"""case when coalesce(entity_purchase_unit_count, 1) > 1 then 'multiple_purchase_units_for_entity'
        when coalesce(purchase_unit, '') = '' then 'purchase_unit_missing' {today if require_current else ''}
        when coalesce({price}, 0) <= 0 then 'purchase_unit_price_missing_or_nonpositive' end"""


def _drop_score(value: str, threshold: str) -> str:
    return f"greatest(({threshold} - {value}) / greatest({threshold}, 1e-9D) * 100, 0D)"


def _rise_score(value: str, threshold: str) -> str:
    return f"greatest(({value} / greatest({threshold}, 1e-9D) - 1) * 100, 0D)"


BASE_WINDOW = {"start": "baseline_window_start", "end": "recent_window_end"}
HISTORY_WINDOW = {"start": "data_history_start", "end": "observation_date"}


def interval_rule(p: Param) -> dict[str, str]:
    med, mad = "historical_interval_median", f"greatest(historical_interval_mad, {p('mad_floor_days')})"
    z = f"if({med} > 0, greatest((days_since_last_purchase - {med}) / {mad}, 0D), 0D)"
    hit, full = p("z_hit"), p("z_full")
    score = f"""case when {z} <= {hit} then 0D when {full} <= {hit} then 100D
        else least(greatest(({z} - {hit}) / ({full} - {hit}) * 100, 0D), 100D) end"""
    return {
        "reason": f"if({med} <= 0 or purchase_count_total < {p('min_purchase_count')}, 'insufficient_history', null)",
        "hit": f"{z} >= {hit}", "score": score,
        "confidence": f"purchase_count_total / {p('confidence_n')}",
        "current": "days_since_last_purchase", "baseline": med, "comparison": z, "threshold": hit, "operator": "'>='",
        **HISTORY_WINDOW,
        "payload": f"""named_struct('current_gap_days', days_since_last_purchase, 'historical_median_interval_days', {med},
            'historical_mad_days', historical_interval_mad, 'robust_z', round({z}, 4), 'purchase_count', purchase_count_total)""",
    }


def _ratio_rule(p: Param, ratio: str, base: str, limit: str, floor: str, drop: bool, confidence: str, current: str) -> dict[str, str]:
    threshold = f"({p(limit)} * {shape_modifier(p('demand_shape_modifiers'))})"
    op = "<=" if drop else ">="
    return {
        "reason": f"if({ratio} is null or {base} < {floor}, 'insufficient_history', null)",
        "hit": f"{ratio} {op} {threshold}",
        "score": (_drop_score if drop else _rise_score)(ratio, threshold),
        "confidence": confidence, "current": current, "baseline": base, "comparison": ratio, "threshold": threshold,
        "operator": f"'{op}'", **BASE_WINDOW,
        "payload": f"""named_struct('ratio', {ratio}, 'recent', {current}, 'baseline', {base}, 'amount_ratio', amount_ratio,
            'amount_direction_consistent', ({ratio} <= 1) = (amount_ratio <= 1), 'demand_shape_label', demand_shape_label,
            'effective_threshold', {threshold})""",
    }


def quantity_rule(limit: str, drop: bool):
    return lambda p: _ratio_rule(
        p, "quantity_ratio", "baseline_quantity", limit, p("min_baseline_quantity"), drop,
        f"purchase_count_total / {p('confidence_n')}", "recent_quantity",
    )


def frequency_rule(limit: str, drop: bool):
    return lambda p: _ratio_rule(
        p, "frequency_ratio", "purchase_frequency_baseline", limit, p("min_base_rate"), drop,
        f"purchase_frequency_baseline / {p('confidence_base_rate')}", "recent_frequency",
    )


def low_price_rule(p: Param) -> dict[str, str]:
    prices = p("absolute_warning_prices")
    own = f"coalesce(try_element_at({prices}, concat(drug_group, '|', purchase_unit)), try_element_at({prices}, drug_group))"
    threshold = f"coalesce({own}, market_reference_price)"
    return {
        "reason": f"""coalesce({price_reason('current_unit_price', True)},
            case when {own} is null and (coalesce(reference_order_count, 0) < {p('min_reference_order_count')}
              or coalesce(reference_hospital_count, 0) < {p('min_reference_hospital_count')}) then 'insufficient_reference'
            when coalesce({threshold}, 0) <= 0 then 'threshold_missing' end)""",
        "hit": f"current_unit_price < {threshold}",
        "score": f"greatest(({threshold} - current_unit_price) / {threshold} * 100, 0D)",
        "confidence": "coalesce(reference_order_count, 0) / 100D",
        "current": "current_unit_price", "baseline": threshold, "comparison": f"current_unit_price / {threshold}",
        "threshold": threshold, "operator": "'<'", **HISTORY_WINDOW,
        "payload": f"""named_struct('current_unit_price', current_unit_price, 'warning_unit_price', {threshold},
            'threshold_source', if({own} is null, 'prior_market_p05', 'configured_absolute'),
            'reference_order_count', reference_order_count, 'reference_hospital_count', reference_hospital_count)""",
    }


def price_spread_rule(p: Param) -> dict[str, str]:
    n, limit = "coalesce(price_recent_order_count, 0)", p("spread_ratio_threshold")
    return {
        "reason": f"""coalesce({price_reason('median_price', False)},
            if({n} < {p('min_order_count')} or price_spread_ratio is null, 'insufficient_history', null))""",
        "hit": f"price_spread_ratio >= {limit}",
        "score": f"greatest((price_spread_ratio / {limit} - 1) * 100, 0D)", "confidence": f"{n} / 10D",
        "current": "max_price", "baseline": "min_price", "comparison": "price_spread_ratio", "threshold": limit,
        "operator": "'>='", "start": "recent_window_start", "end": "recent_window_end",
        "payload": f"""named_struct('order_count', {n}, 'min_price', min_price, 'max_price', max_price,
            'median_price', median_price, 'price_spread_ratio', price_spread_ratio)""",
    }


def price_shift_rule(p: Param) -> dict[str, str]:
    up, low = p("upper_ratio_threshold"), p("lower_ratio_threshold")
    rn, bn = "coalesce(price_recent_order_count, 0)", "coalesce(price_baseline_order_count, 0)"
    hit = f"(price_ratio >= {up} or price_ratio <= {low})"
    return {
        "reason": f"""coalesce({price_reason('recent_price', False)},
            if({rn} < {p('min_recent_order_count')} or {bn} < {p('min_baseline_order_count')} or price_ratio is null,
               'insufficient_history', null))""",
        "hit": hit, "score": f"if({hit}, abs(ln(greatest(price_ratio, 1e-9D))) * 100, 0D)",
        "confidence": f"({rn} + {bn}) / 20D", "current": "recent_price", "baseline": "baseline_price",
        "comparison": "price_ratio", "threshold": f"if(price_ratio >= {up}, {up}, {low})",
        "operator": f"if(price_ratio >= {up}, '>=', '<=')", **BASE_WINDOW,
        "payload": f"""named_struct('recent_price', recent_price, 'baseline_price', baseline_price, 'price_ratio', price_ratio,
            'direction', case when price_ratio >= {up} then 'up' when price_ratio <= {low} then 'down' else 'stable' end,
            'recent_order_count', {rn}, 'baseline_order_count', {bn})""",
    }


def first_purchase_rule(p: Param) -> dict[str, str]:
    return {
        "reason": "if(first_purchase_date <=> observation_date, null, 'no_first_purchase_on_observation_date')",
        "hit": "true", "score": "100D", "confidence": "1D", "current": "1D", "baseline": "null", "comparison": "null",
        "threshold": "1D", "operator": "'fact'", "start": "first_purchase_date", "end": "first_purchase_date",
        "payload": """named_struct('first_purchase_date', first_purchase_date, 'first_order_id', first_order_id,
            'first_purchase_quantity', first_purchase_quantity, 'first_purchase_amount', first_purchase_amount)""",
    }


def reactivated_rule(p: Param) -> dict[str, str]:
    gap = p("configured_gap_days")
    return {
        "reason": """case when not coalesce(current_purchase_flag, false) then 'no_purchase_on_observation_date'
            when silence_days is null then 'no_previous_purchase' end""",
        "hit": f"silence_days > {gap}", "score": f"greatest((silence_days / {gap} - 1) * 100, 0D)", "confidence": "1D",
        "current": "silence_days", "baseline": gap, "comparison": "silence_days", "threshold": gap, "operator": "'>'",
        "start": "previous_purchase_date", "end": "observation_date",
        "payload": f"""named_struct('previous_purchase_date', previous_purchase_date, 'silence_days', silence_days,
            'configured_gap_days', {gap})""",
    }


RULES: dict[str, Callable[[Param], dict[str, str]]] = {
    "purchase_interval_ipi": interval_rule,
    "purchase_quantity_trend": quantity_rule("drop_ratio_hit", True),
    "purchase_quantity_spike": quantity_rule("spike_ratio_hit", False),
    "purchase_frequency_drop": frequency_rule("freq_drop_ratio", True),
    "purchase_frequency_spike": frequency_rule("freq_spike_ratio", False),
    "low_price_warning": low_price_rule,
    "order_price_spread_warning": price_spread_rule,
    "purchase_price_level_shift": price_shift_rule,
    "first_purchase_fact": first_purchase_rule,
    "reactivated_purchase_fact": reactivated_rule,
}


def _literal(value: object) -> str:
    if isinstance(value, Mapping):
        if not value:
            return "cast(map() as map<string,double>)"
        return "map(" + ", ".join(f"'{k}', {float(v)!r}D" for k, v in value.items()) + ")"
    return f"{float(value)!r}D"


def default_params(detector: str, overrides: Mapping[str, object] | None = None) -> Param:
    values = {**DEFAULTS[detector], **(overrides or {})}
    return lambda name: _literal(values[name])


def _param_column(detector: str, name: str) -> str:
    return f"_p_{detector}__{name}"


def profile_params(detector: str) -> Param:
    """Values of the manufacturer's profile, read from the columns that `pivot_profiles` adds."""
    return lambda name: f"coalesce({_param_column(detector, name)}, {_literal(DEFAULTS[detector][name])})"


def rule_struct(detector: str, rule: Mapping[str, str], config: bool) -> str:
    """SQL of the raw rule outcome; all rules share one struct type."""
    reason = rule["reason"]
    if config:
        reason = f"case when _c_{detector}_id is null then 'config_missing' else {reason} end"
    fields = {
        "detector_id": f"'{detector}'",
        "detector_family": f"'{FAMILY[detector]}'",
        "detector_version": f"'{VERSION[detector]}'",
        "config_id": f"coalesce(_c_{detector}_id, '')" if config else "''",
        "config_hash": f"coalesce(_c_{detector}_hash, '')" if config else "''",
        "reason": f"cast({reason} as string)",
        "hit": f"coalesce({rule['hit']}, false)",
        **{k: f"cast({rule[k]} as double)" for k in ("score", "confidence", "current", "baseline", "comparison", "threshold")},
        "operator": rule["operator"],
        "start": f"cast({rule['start']} as date)",
        "end": f"cast({rule['end']} as date)",
        "evidence_payload": f"to_json({rule['payload']})",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


# Final columns from the raw outcome; an inapplicable row keeps only its reason and payload.
RESULT_COLUMNS = [
    "detector_id", "detector_family", "detector_version", "config_id", "config_hash",
    "reason is null and hit as hit_flag",
    """case when reason is not null then 'not_evaluable' when least(greatest(score, 0D), 100D) >= 80 then 'high'
       when least(greatest(score, 0D), 100D) >= 40 then 'medium' when hit then 'low' else 'stable' end as severity""",
    "if(reason is null, round(greatest(least(confidence, 1D), 0D), 4), null) as confidence",
    """case when reason is null then 'applicable' when reason in ('config_missing', 'insufficient_reference') then reason
       else 'inapplicable' end as eligibility_status""",
    "reason as inapplicable_reason",
    "if(reason is null, start, null) as evidence_window_start",
    "if(reason is null, end, null) as evidence_window_end",
    "if(reason is null, current, null) as current_value",
    "if(reason is null, baseline, null) as baseline_value",
    "if(reason is null, comparison, null) as comparison_value",
    "if(reason is null, threshold, null) as threshold_value",
    "if(reason is null, operator, null) as threshold_operator",
    "evidence_payload",
    "case when reason is not null then reason when hit then detector_id else 'threshold_not_met' end as hit_reason",
]


def detector_results(
    snapshot: DataFrame,
    detectors: Sequence[str] | None = None,
    profiles: DataFrame | None = None,
    overrides: Mapping[str, Mapping[str, object]] | None = None,
    run_id: str = "run",
) -> DataFrame:
    """One row per entity, observation date and rule.

    With `profiles` (already resolved, one per rule, manufacturer and date) each manufacturer's own parameters
    apply and a missing one gives `config_missing`; without, the defaults plus `overrides` apply.
    """
    names = list(detectors or RULES)
    if profiles is not None:
        snapshot = snapshot.join(
            pivot_profiles(profiles, names), ["observation_date", "manufacturer_code"], "left"
        )
    structs = []
    for d in names:
        p = profile_params(d) if profiles is not None else default_params(d, (overrides or {}).get(d))
        structs.append(rule_struct(d, RULES[d](p), profiles is not None))
    keep = ["observation_date", *ORDER_ENTITY, "purchase_unit", "demand_shape_label"]
    raw = snapshot.selectExpr(*keep, "inline(array(" + ", ".join(structs) + "))")
    out = raw.selectExpr(*keep, *RESULT_COLUMNS)
    eid = entity_id(ORDER_ENTITY)
    return out.withColumns(
        {
            "run_id": F.lit(run_id),
            "detector_result_id": F.concat(
                F.lit(run_id), F.lit("|"), F.col("observation_date").cast("string"), F.lit("|"), F.col("detector_id"),
                F.lit("|"), eid, F.lit("|"), F.coalesce("purchase_unit", F.lit("")),
            ),
        }
    )


def result_score() -> Column:
    """Strength of a hit from comparison, threshold and direction, 1..100."""
    return F.expr(
        """case when comparison_value is null or threshold_value is null then if(hit_flag, 100D, 0D)
           when threshold_operator in ('>', '>=')
             then least(greatest((comparison_value / greatest(threshold_value, 1e-9D) - 1) * 100, 1D), 100D)
           when threshold_operator in ('<', '<=')
             then least(greatest((threshold_value - comparison_value) / greatest(abs(threshold_value), 1e-9D) * 100, 1D), 100D)
           else if(hit_flag, 100D, 0D) end"""
    )


def clues(results: DataFrame, monthly: DataFrame) -> DataFrame:
    """Hits with score, monthly context and display rank per observation date.

    `monthly` has one row per entity: risk_entity_id, monthly_risk_probability, monthly_loss_value.
    """
    hits = results.where("hit_flag").withColumn("detector_score", result_score())
    joined = hits.join(
        monthly.select(*ORDER_ENTITY, "risk_entity_id", "monthly_risk_probability", "monthly_loss_value"),
        ORDER_ENTITY, "left",
    ).withColumn("is_monthly_high_risk_entity", F.col("risk_entity_id").isNotNull())
    # Rank by score then confidence: the pair becomes one sortable number (score has 0..100, confidence 0..1 at 4 digits).
    ranked = sorted_rank(
        joined.withColumn("_order", F.expr("round(detector_score, 6) * 100000 + coalesce(confidence, -1D) * 0.01")),
        "_order", ["observation_date"], ["detector_result_id"], name="display_rank",
    )
    return ranked.withColumnRenamed("detector_result_id", "detector_clue_id").drop("_order")


def attached_evidence(clue_table: DataFrame) -> DataFrame:
    return clue_table.where("is_monthly_high_risk_entity and hit_flag and risk_entity_id is not null").select(
        "risk_entity_id", "run_id", "observation_date", "detector_id", "detector_family", "detector_score",
        "confidence", "evidence_payload",
    )


def run_summary(results: DataFrame, clue_table: DataFrame) -> DataFrame:
    scanned = results.groupBy("run_id", "observation_date").agg(
        F.countDistinct(*ORDER_ENTITY).alias("scanned_entity_count"),
        F.array_join(F.array_sort(F.collect_set("detector_id")), ",").alias("enabled_detectors"),
    )
    found = clue_table.groupBy("run_id", "observation_date").agg(
        F.count(F.lit(1)).alias("clue_count"),
        F.count_if("is_monthly_high_risk_entity").alias("high_risk_clue_count"),
    )
    return scanned.join(found, ["run_id", "observation_date"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("clue_count", "high_risk_clue_count")}
    )


def _parameters_json(detector: str, overrides: Mapping[str, object] | None = None) -> str:
    return json.dumps({**DEFAULTS[detector], **(overrides or {})}, sort_keys=True, separators=(",", ":"))


def config_profiles(
    manufacturers: DataFrame, detectors: Sequence[str] | None = None, effective_from: str = "1995-01-01",
    overrides: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """One profile per rule and manufacturer with a hash of its parameters."""
    rows = [
        F.struct(
            F.lit(d).alias("detector_id"), F.lit(VERSION[d]).alias("detector_version"),
            F.lit(_parameters_json(d, (overrides or {}).get(d))).alias("parameters"),
        )
        for d in (detectors or RULES)
    ]
    out = manufacturers.select("manufacturer_code").distinct().select("manufacturer_code", F.inline(F.array(*rows)))
    out = out.withColumn("config_hash", F.sha2(F.concat_ws("|", "detector_id", "detector_version", "manufacturer_code", "parameters"), 256))
    return out.withColumns(
        {
            "config_id": F.concat_ws("-", "detector_id", "manufacturer_code", F.substring("config_hash", 1, 12)),
            "parameter_scope": F.lit("manufacturer_specific"),
            "status": F.lit("active"),
            "engineering_validated": F.lit(True),
            "effective_from": F.to_date(F.lit(effective_from)),
            "effective_to": F.lit(None).cast("date"),
        }
    )


def resolve_profiles(profiles: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Profiles valid on each observation date (open-ended when effective_to is null)."""
    valid = profiles.where("status = 'active' and engineering_validated")
    return valid.selectExpr(
        "*",
        "explode(filter(array(" + ", ".join(f"date'{d}'" for d in dates) + "), d -> d >= effective_from and "
        "(effective_to is null or d <= effective_to))) as observation_date",
    )


def missing_profiles(resolved: DataFrame, manufacturers: DataFrame, detectors: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """Expected (date, rule, manufacturer) combinations without a valid profile."""
    expected = manufacturers.select("manufacturer_code").distinct().selectExpr(
        "manufacturer_code",
        "explode(array(" + ", ".join(f"'{d}'" for d in detectors) + ")) as detector_id",
    ).selectExpr("*", "explode(array(" + ", ".join(f"date'{d}'" for d in dates) + ")) as observation_date")
    return expected.join(resolved, ["observation_date", "detector_id", "manufacturer_code"], "left_anti")


def ambiguous_profiles(resolved: DataFrame) -> DataFrame:
    """Combinations with more than one valid profile: an error for the caller to raise."""
    return resolved.groupBy("observation_date", "detector_id", "manufacturer_code").agg(
        F.count(F.lit(1)).alias("profile_count")
    ).where("profile_count > 1")


def run_config_snapshot(resolved: DataFrame, run_id: str) -> DataFrame:
    return resolved.select(
        F.lit(run_id).alias("run_id"), "observation_date", "detector_id", "manufacturer_code", "config_id",
        "config_hash", "detector_version", "parameters", "effective_from", "effective_to",
    )


def pivot_profiles(resolved: DataFrame, detectors: Sequence[str] | None = None) -> DataFrame:
    """One row per date and manufacturer with a column per rule parameter (null where no profile is valid)."""
    parsed = resolved.select(
        "observation_date", "manufacturer_code", "detector_id", "config_id", "config_hash",
        F.from_json("parameters", "map<string,string>").alias("raw"),
    )
    aggs = []
    for d in detectors or RULES:
        aggs += [f"max(if(detector_id = '{d}', config_{k}, null)) as _c_{d}_{k}" for k in ("id", "hash")]
        for name, default in DEFAULTS[d].items():
            text = f"if(detector_id = '{d}', try_element_at(raw, '{name}'), null)"
            column = _param_column(d, name)
            if isinstance(default, Mapping):
                aggs.append(f"from_json(max({text}), 'map<string,double>') as {column}")
            else:
                aggs.append(f"max(try_cast({text} as double)) as {column}")
    return parsed.groupBy("observation_date", "manufacturer_code").agg(*[F.expr(a) for a in aggs])


def result_quality(results: DataFrame, clue_table: DataFrame, profiles: DataFrame) -> DataFrame:
    """Gate counts per rule and date; every failing count must be zero for a component to be published."""
    key = ["observation_date", "detector_id"]
    ids = results.groupBy(*key, "detector_result_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("eligibility_status") == "config_missing").alias("config_missing"),
        F.count_if((F.col("config_id") == "") | (F.col("config_hash") == "")).alias("no_config"),
        F.count_if("hit_flag").alias("hits"),
    )
    per = ids.groupBy(*key).agg(
        F.sum("n").alias("result_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_result_ids"),
        F.sum("config_missing").alias("config_missing_count"),
        F.sum("no_config").alias("config_reference_missing"),
        F.sum("hits").alias("hit_count"),
    )
    orphan = clue_table.join(
        results.select(F.col("detector_result_id").alias("detector_clue_id")), "detector_clue_id", "left_anti"
    ).groupBy(*key).agg(F.count(F.lit(1)).alias("orphan_clues"))
    found = clue_table.groupBy(*key).agg(
        F.count(F.lit(1)).alias("clue_count"), F.count_if(~F.col("hit_flag")).alias("clues_without_hit")
    )
    scope = results.select(*key, "manufacturer_code").distinct().join(
        profiles.select(*key, "manufacturer_code").distinct().withColumn("_in", F.lit(1)),
        [*key, "manufacturer_code"], "full",
    ).join(results.select(*key, "manufacturer_code").distinct().withColumn("_res", F.lit(1)), [*key, "manufacturer_code"], "left")
    scope = scope.groupBy(*key).agg(
        F.count_if(F.col("_in").isNull() | F.col("_res").isNull()).alias("manufacturer_scope_mismatch")
    )
    out = per.join(found, key, "left").join(orphan, key, "left").join(scope, key, "left")
    counts = ["clue_count", "clues_without_hit", "orphan_clues", "manufacturer_scope_mismatch"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    failing = ["duplicate_result_ids", "config_missing_count", "config_reference_missing", "clues_without_hit", "orphan_clues", "manufacturer_scope_mismatch"]
    return out.withColumn("failed_checks", labels_where([(F.col(c) > 0, c) for c in failing]))


def quality_gate(features: DataFrame, deliveries: DataFrame, prices: DataFrame, config: Mapping[str, bool] | None = None) -> DataFrame:
    """Which of the monthly rules may run, from null rates of their inputs."""
    cfg = config or {}
    quantity = features.agg(F.avg(F.col("purchase_quantity_recent").isNotNull().cast("double")).alias("q"))
    delivery = deliveries.agg(
        F.least(
            F.avg(F.col("delivery_date").isNotNull().cast("double")),
            F.avg(F.col("arrival_date").isNotNull().cast("double")),
        ).alias("d")
    )
    price = prices.agg(F.count(F.lit(1)).alias("p"))
    q_ok = F.coalesce(quantity.select("q").scalar() > 0.8, F.lit(False))
    d_ok = F.coalesce(delivery.select("d").scalar() >= 0.5, F.lit(False))
    p_ok = price.select("p").scalar() > 0
    price_on = p_ok & F.lit(bool(cfg.get("enable_price_detectors", False)))
    low_delivery = bool(cfg.get("enable_low_delivery_rate_if_quality_passed", False))
    on, weak, none, interface = "enabled_rule_v1", "weak_enabled_review_required", "deferred_missing_data", "interface_only"
    rows = [
        ("terminal_loss_warning", F.lit(on), F.lit(True)),
        ("purchase_interval_overdue_warning", F.lit(on), F.lit(True)),
        ("purchase_frequency_fluctuation_warning", F.lit(on), F.lit(True)),
        ("purchase_quantity_fluctuation_warning", F.when(q_ok, weak).otherwise(none), q_ok),
        ("new_terminal_detection", F.lit(on), F.lit(True)),
        ("delayed_response_warning", F.when(d_ok, on).otherwise(none), F.lit(False)),
        ("rejection_response_warning", F.lit(none), F.lit(False)),
        ("low_delivery_rate_warning", F.lit(weak if low_delivery else interface), F.lit(low_delivery)),
        ("low_price_purchase_warning", F.when(price_on, weak).otherwise(interface), F.lit(False)),
        ("order_price_spread_warning", F.when(price_on, weak).otherwise(interface), F.lit(False)),
        ("sku_narrowing_warning", F.lit("deferred_missing_mapping"), F.lit(False)),
        ("wallet_share_decline_warning", F.lit("deferred_missing_mapping"), F.lit(False)),
        ("purchase_amount_trend_warning", F.lit("internal_only"), F.lit(False)),
    ]
    spark: SparkSession = features.sparkSession
    return spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("detector_name"), s.alias("gate_status"), e.alias("enable_frontend_display"))
                    for n, s, e in rows
                ]
            )
        )
    )
