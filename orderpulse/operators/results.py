"""Status decisions, result tables, display names and evidence cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.ranking import first_rows


def aggregate_evidence(evidence: DataFrame) -> DataFrame:
    """Hit counts, named flags, best confidence and reasons per entity and cutoff."""
    return evidence.groupBy("entity_id", "cutoff_month").agg(
        F.count_if("hit_flag").alias("detector_hit_count"),
        F.expr("count_if(hit_flag and severity >= 70 and confidence >= 0.6) as strong_detector_hit_count"),
        F.expr("bool_or(hit_flag and detector_name = 'terminal_loss_warning') as terminal_loss_hit"),
        F.expr("bool_or(hit_flag and detector_name = 'purchase_frequency_fluctuation_warning') as frequency_hit"),
        F.expr("bool_or(hit_flag and detector_name = 'purchase_quantity_fluctuation_warning') as quantity_hit"),
        F.expr("max(if(hit_flag, confidence, null)) as max_detector_confidence"),
        F.expr("array_join(array_sort(collect_set(if(hit_flag, concat(detector_name, ':', reason_code), null))), ' | ') as top_detector_reasons"),
    )


def evidence_strength(df: DataFrame) -> DataFrame:
    late = "survival_state in ('materially_overdue', 'likely_churn_interval')"
    strong = f"terminal_loss_hit and {late} and survival_confidence >= 0.7 and demand_shape_route <> 'observation_only' and max_detector_confidence >= 0.6"
    medium = f"(terminal_loss_hit and survival_confidence < 0.7) or (survival_state = 'slightly_overdue' and (frequency_hit or quantity_hit)) or (frequency_hit and quantity_hit) or {late}"
    return df.withColumn(
        "evidence_strength",
        F.expr(
            f"""case when p is null or prio is null or demand_shape_route = 'unknown' then 'insufficient' when coalesce({strong}, false) then 'strong'
                when coalesce({medium}, false) then 'medium' else 'weak' end"""
        ),
    )


def recurring_status(df: DataFrame, threshold: DataFrame) -> DataFrame:
    """Final status and review priority; `threshold` holds the 80% quantile of the priority as one value."""
    top = f"coalesce(prio >= _limit, false)"
    late = "survival_state in ('materially_overdue', 'likely_churn_interval')"
    out = evidence_strength(df).withColumn("_limit", threshold.scalar())
    out = out.withColumn(
        "final_candidate_status",
        F.expr(
            f"""case when p is null or prio is null then 'not_actionable'
                when demand_shape_route = 'observation_only' or survival_state = 'low_confidence_lumpy' or demand_shape_label = 'lumpy'
                  or (demand_shape_label = 'intermittent' and horizon = 'H3') then 'observation_only'
                when {late} and evidence_strength in ('strong', 'medium') then 'priority_review'
                when survival_state in ('slightly_overdue', 'materially_overdue', 'likely_churn_interval') or demand_shape_label = 'erratic'
                  or ({top} and evidence_strength in ('weak', 'insufficient')) then 'manual_review'
                when history_sufficiency_flag <> 'history_sufficient' or survival_confidence < 0.5 or demand_shape_route = 'unknown' then 'low_confidence_watch'
                else 'manual_review' end"""
        ),
    )
    return out.withColumn(
        "review_priority",
        F.expr(
            f"""case when final_candidate_status = 'priority_review' and evidence_strength = 'strong' and {top} then 'P0'
                when final_candidate_status in ('priority_review', 'manual_review') and evidence_strength in ('medium', 'strong') and {top} then 'P1'
                when final_candidate_status in ('observation_only', 'low_confidence_watch') and {top} then 'P2' else 'P3' end"""
        ),
    ).drop("_limit")


def monthly_status(candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    hits = outputs.groupBy("candidate_id", "cutoff_month").agg(
        F.count_if("hit_flag").alias("detector_hit_count"), F.expr("count_if(severity = 'high') as strong_detector_hit_count")
    )
    out = candidates.join(hits, ["candidate_id", "cutoff_month"], "left").fillna(0, ["detector_hit_count", "strong_detector_hit_count"])
    out = out.withColumns({"is_one_shot": F.expr("sample_class = 'one_shot'"), "is_high_risk": F.expr("sample_class = 'recurring' and p >= 0.6")})
    return out.selectExpr(
        "*", "case when is_one_shot then 'one_shot_attention' when is_high_risk then 'priority_review' when sample_class = 'recurring' then 'manual_review' else 'not_actionable' end as final_candidate_status",
        "case when is_high_risk then 'P1' when sample_class = 'recurring' then 'P2' else 'P3' end as review_priority",
        "case when is_high_risk then 'orange' when sample_class = 'recurring' then 'yellow' when is_one_shot then 'attention' else 'insufficient' end as risk_level",
        "case when detector_hit_count >= 2 then 'medium' when detector_hit_count = 1 then 'weak' else 'insufficient' end as evidence_strength",
    )


def risk_cards(status: DataFrame, outputs: DataFrame, per_entity: int = 5) -> DataFrame:
    """One primary card plus up to four rule cards per entity."""
    primary = status.selectExpr(
        "concat('card_primary_', candidate_id) as risk_card_id", "candidate_id", "cutoff_month", "risk_level as card_level",
        "'primary' as source_detector_name", "true as is_primary", "0 as _o",
    )
    hits = outputs.where("hit_flag").join(status.select("candidate_id", "cutoff_month", F.col("risk_level").alias("card_level")), ["candidate_id", "cutoff_month"])
    cards = first_rows(hits, ["candidate_id", "cutoff_month"], [F.col("detector_name")], per_entity - 1).selectExpr(
        "concat('card_', detector_name, '_', candidate_id) as risk_card_id", "candidate_id", "cutoff_month", "card_level",
        "detector_name as source_detector_name", "false as is_primary", "1 as _o",
    )
    return primary.unionByName(cards).drop("_o")


def evidence_bundle(status: DataFrame, outputs: DataFrame) -> DataFrame:
    """JSON list of the hits of each candidate, with counts (bounded by the number of rules)."""
    hits = outputs.where("hit_flag").groupBy("candidate_id", "cutoff_month").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("detector_name", "severity")))).alias("detector_evidence"), F.count(F.lit(1)).alias("evidence_count")
    )
    return status.join(hits, ["candidate_id", "cutoff_month"], "left").withColumns(
        {"detector_evidence": F.coalesce("detector_evidence", F.lit("[]")), "evidence_count": F.coalesce("evidence_count", F.lit(0))}
    )


def claims(bundle: DataFrame) -> DataFrame:
    parsed = F.from_json("detector_evidence", "array<struct<detector_name:string,severity:string>>")
    return bundle.select("candidate_id", "cutoff_month", F.inline(parsed))


def claim_audit(bundle: DataFrame) -> DataFrame:
    """Violations per candidate: counts that do not match the parsed list, high status without evidence, missing fields."""
    parsed = F.from_json("detector_evidence", "array<struct<detector_name:string,severity:string>>")
    d = bundle.withColumn("_e", parsed)
    return d.groupBy("final_candidate_status").agg(
        F.count(F.lit(1)).alias("row_count"), F.expr("count_if(size(_e) <> evidence_count) as count_mismatch"),
        F.expr("count_if(final_candidate_status = 'priority_review' and size(_e) = 0) as priority_without_evidence"),
        F.expr("count_if(exists(_e, x -> x.severity is null)) as evidence_without_severity"),
        F.expr("avg(if(size(_e) > 0, 1D, 0D)) as evidence_completeness"),
    )


def horizon_profiles(scored: DataFrame) -> DataFrame:
    """Probability, involved amount with its source, level and band per entity and horizon."""
    amount = """case horizon when 'H3' then purchase_amount_sum_last_3m_asof_cutoff when 'H6' then purchase_amount_sum_last_6m_asof_cutoff
        when 'H12' then purchase_amount_sum_last_12m_asof_cutoff end"""
    level = "case when probability is null then 'unavailable' when probability >= 0.8 then 'red' when probability >= 0.6 then 'orange' when probability >= 0.4 then 'yellow' else 'low' end"
    out = scored.selectExpr(
        "entity_id as risk_entity_id", "cutoff_month as report_month", "horizon", "if(sample_class = 'one_shot', null, p) as probability",
        f"greatest(coalesce({amount}, value_at_risk_proxy, 0D), 0D) as involved_amount",
        "if(horizon in ('H3', 'H6', 'H12'), concat('purchase_amount_sum_last_', substring(horizon, 2), 'm_asof_cutoff'), 'value_at_risk_proxy') as involved_amount_source",
    ).withColumn("risk_level", F.expr(level))
    return out.withColumnRenamed("probability", "risk_probability").withColumn(
        "risk_band", F.expr("case risk_level when 'red' then 'High risk' when 'orange' then 'Medium risk' when 'yellow' then 'Lower risk' else 'Data unavailable' end")
    )


def one_shot_terminals(features: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """One-shot entities with the date and the summed amount of their first purchase day."""
    days = orders.where(F.col("order_date") <= F.to_date(F.lit(as_of))).groupBy(
        "manufacturer_code", "hospital_code", F.col("drug_code").alias("drug_group"), "order_date"
    ).agg(F.sum("order_amount").alias("amount"))
    first = days.groupBy("manufacturer_code", "hospital_code", "drug_group").agg(
        F.min("order_date").alias("first_purchase_date"), F.min_by("amount", "order_date").alias("first_purchase_amount")
    )
    one = features.where("sample_class = 'one_shot'").join(first, ["manufacturer_code", "hospital_code", "drug_group"])
    return one.withColumn("days_since_first_purchase", F.datediff(F.to_date(F.lit(as_of)), "first_purchase_date"))


def entity_aggregates(entities: DataFrame, by: Sequence[str]) -> DataFrame:
    return entities.groupBy(*by).agg(F.count("entity_id").alias("risk_entity_count"), F.count_if("is_high_risk").alias("high_risk_count"))


def monthly_report(entities: DataFrame) -> DataFrame:
    return entities.groupBy("cutoff_month").agg(
        F.concat(F.lit("monthly_"), F.date_format(F.first("cutoff_month"), "yyyy-MM")).alias("monthly_report_id"),
        F.countDistinct("entity_id").alias("entity_count"), F.count_if("is_high_risk").alias("high_risk_count"),
    )


def display_lookup(entities: DataFrame, hospitals: DataFrame, drugs: DataFrame, orders: DataFrame) -> DataFrame:
    """Names by source order master, latest order, code, with the source kept as quality."""
    latest = orders.groupBy(F.col("drug_code").alias("drug_group")).agg(
        F.max_by("drug_name", F.struct("order_date", "row_uid")).alias("_order_name")
    )
    j = entities.select("manufacturer_code", "hospital_code", "drug_group").distinct()
    j = j.join(hospitals.select("hospital_code", "hospital_name", "region_code", "region_name"), "hospital_code", "left")
    j = j.join(drugs.select(F.col("drug_code").alias("drug_group"), F.col("drug_name").alias("_master")), "drug_group", "left").join(latest, "drug_group", "left")
    j = j.selectExpr(
        "manufacturer_code", "hospital_code", "drug_group", "coalesce(hospital_name, hospital_code) as hospital_display_name",
        "coalesce(_master, _order_name, drug_group) as drug_display_name", "region_code", "coalesce(region_name, 'unknown_region') as region_display_name",
        "if(hospital_name is null, 'code_fallback', 'master') as hs", "case when _master is not null then 'master' when _order_name is not null then 'order' else 'code_fallback' end as ds",
    )
    return j.withColumn(
        "display_name_quality",
        F.expr("case when hs = ds then hs when hs = 'code_fallback' or ds = 'code_fallback' then 'code_fallback' else 'mixed' end"),
    ).drop("hs", "ds")


def merge_lookups(primary: DataFrame, secondary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Best row per key: most names that differ from their codes, then the primary source."""
    score = F.expr("if(hospital_display_name <> hospital_code, 1, 0) + if(drug_display_name <> drug_group, 1, 0)")
    both = primary.withColumn("_src", F.lit(1)).unionByName(secondary.withColumn("_src", F.lit(0)), allowMissingColumns=True)
    rest = [c for c in primary.columns if c not in key]
    return both.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(score.alias("s"), F.col("_src"))).alias("_r")
    ).select(*key, "_r.*")


def review_sample(status: DataFrame, n: int = 5) -> DataFrame:
    """First n rows per status, priority and strength, without repeats."""
    order = [F.asc("review_priority"), F.asc("final_candidate_status"), F.desc_nulls_last("prio"), F.asc("candidate_id"), F.asc("cutoff_month")]
    parts = [first_rows(status, [c], order, n) for c in ("final_candidate_status", "review_priority", "evidence_strength")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["candidate_id", "cutoff_month"])
