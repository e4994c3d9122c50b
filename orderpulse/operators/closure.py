"""Closure of a monthly run: status from gate, survival and hits, contract tables, one bundle per candidate, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.ranking import first_rows
from orderpulse.session import cut_lineage

OF = ["candidate_id", "cutoff_month"]
#: Claims that no text may make; each bundle carries the list.
FORBIDDEN_CLAIMS = ["guaranteed churn", "confirmed lost customer", "automatic dispatch", "exact churn date"]
MAX_CARDS, MAX_EVIDENCE = 5, 3
BUNDLE = """bundle_id string, candidate_id string, cutoff_month date, candidate_type string, final_candidate_status string, review_priority string,
    evidence_strength string, demand_shape_label string, probability double, probability_display_level string, survival_state string, auto_dispatch_allowed boolean,
    detectors array<struct<detector_name: string, severity: string>>, allowed_claims string, forbidden_claims array<string>"""


def closure_status(candidates: DataFrame, survival: DataFrame, outputs: DataFrame, strong: str = "high") -> DataFrame:
    """Candidates with their final status, priority and evidence strength.

    `candidates` has passed the availability gate; one-shot and observation candidates keep their own status, a strong
    hit with a probability that may be shown makes a priority review, any hit a manual one.
    """
    hits = outputs.groupBy(*OF).agg(F.count_if("hit_flag").alias("detector_hit_count"), F.expr(f"count_if(hit_flag and severity = '{strong}')").alias("strong_detector_hit_count"))
    base = candidates.join(survival, ["entity_id", "cutoff_month"], "left").join(hits, OF, "left").fillna(0, ["detector_hit_count", "strong_detector_hit_count"])
    typed = base.withColumn("candidate_type", F.expr(
        "case when sample_class = 'one_shot' then 'one_shot' when demand_shape_label = 'lumpy' or probability_display_level = 'observation_only' then 'demand_shape_observation' else 'recurring_business_priority' end"))
    cases = [
        ("candidate_type = 'one_shot'", "one_shot_attention", "P2", "weak", True, "one_shot_separated_from_recurring_churn"),
        ("candidate_type = 'demand_shape_observation'", "observation_only", "P2", "weak", True, "demand_shape_or_history_insufficient_observation"),
        ("probability_display_level = 'hidden_data_insufficient'", "not_actionable", "P3", "insufficient", True, "probability_hidden_data_insufficient"),
        ("strong_detector_hit_count > 0 and probability_display_level in ('probability_allowed', 'risk_band_only')", "priority_review", "P0", "strong", False, "strong_evidence_with_probability_gate"),
        ("detector_hit_count > 0", "manual_review", "P1", "medium", False, "detector_or_interval_evidence"),
        ("true", "low_confidence_watch", "P2", "weak", False, "ranking_signal_without_strong_evidence"),
    ]
    decided = None
    for condition, *values in cases:
        value = F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("final_candidate_status", "review_priority", "evidence_strength", "data_quality_warning_flag", "status_reason"), strict=True)])
        decided = F.when(F.expr(condition), value) if decided is None else decided.when(F.expr(condition), value)
    out = typed.withColumn("_d", decided).select("*", "_d.*").drop("_d")
    return out.withColumns({"auto_dispatch_allowed": F.lit(False), "human_review_required": F.col("final_candidate_status") != "not_actionable"})


def evidence_bundles(status: DataFrame, outputs: DataFrame) -> DataFrame:
    """One typed JSON text per candidate; its detector list is bounded by the number of rules."""
    hits = outputs.where("hit_flag").groupBy(*OF).agg(F.array_sort(F.collect_list(F.struct("detector_name", "severity"))).alias("detectors"))
    joined = status.join(hits, OF, "left").withColumn("detectors", F.coalesce("detectors", F.array().cast("array<struct<detector_name: string, severity: string>>")))
    shown = F.when(F.col("probability_display_level") == "probability_allowed", F.col("p"))
    body = F.struct(
        F.concat(F.lit("bundle|"), "candidate_id").alias("bundle_id"), "candidate_id", "cutoff_month", "candidate_type", "final_candidate_status", "review_priority", "evidence_strength", "demand_shape_label",
        shown.alias("probability"), "probability_display_level", "survival_state", "auto_dispatch_allowed", "detectors",
        F.lit("monthly analyst review candidate; evidence is proxy based; human review required").alias("allowed_claims"), F.array(*[F.lit(c) for c in FORBIDDEN_CLAIMS]).alias("forbidden_claims"))
    return joined.select(*OF, F.to_json(body).alias("bundle"))


def read_bundles(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.from_json("bundle", BUNDLE).alias("b")).select("b.*")


def closure_tables(status: DataFrame, outputs: DataFrame, tenant: str = "default", max_cards: int = MAX_CARDS, max_evidence: int = MAX_EVIDENCE) -> dict[str, DataFrame]:
    """Contract tables of one run, all from one written frame of entities, so that their rows agree.

    A primary card for each entity and cards of its first hits by rule name, up to `max_cards`; up to `max_evidence`
    evidence rows for each rule card; counts per hospital and drug; one report row per month.
    """
    entity_id = F.concat(F.lit("re_"), F.date_format("cutoff_month", "yyyyMM"), F.lit("_"), "candidate_id")
    level = "case final_candidate_status when 'priority_review' then 'orange' when 'manual_review' then 'yellow' when 'one_shot_attention' then 'attention' when 'observation_only' then 'observation' else 'insufficient' end"
    entities = cut_lineage(status.select(
        entity_id.alias("risk_entity_id"), *OF, F.lit(tenant).alias("tenant_id"), "manufacturer_code", "hospital_code", "drug_group", "horizon", F.date_format("cutoff_month", "yyyy-MM").alias("report_month"),
        F.expr(level).alias("risk_level"), "final_candidate_status", "review_priority", "auto_dispatch_allowed",
        F.expr("final_candidate_status = 'one_shot_attention'").alias("is_one_shot"), F.expr("final_candidate_status = 'observation_only'").alias("is_observation"), F.expr("final_candidate_status = 'priority_review'").alias("is_high_risk")))
    primary = entities.select(
        F.concat(F.lit("rc_"), "risk_entity_id", F.lit("_primary")).alias("risk_card_id"), "risk_entity_id", "candidate_id",
        F.expr("case when is_one_shot then 'one_shot_attention' when is_observation then 'demand_shape_observation' else 'primary_risk' end").alias("card_type"),
        F.col("risk_level").alias("card_level"), F.lit("primary").alias("source_detector_name"), F.lit(True).alias("is_primary"))
    hits = outputs.where("hit_flag").join(entities.select(*OF, "risk_entity_id"), OF)
    named = hits.withColumn("risk_card_id", F.concat(F.lit("rc_"), "risk_entity_id", F.lit("_"), "detector_name"))
    once = named.groupBy("risk_card_id", "risk_entity_id", "candidate_id", "detector_name").agg(F.max("severity").alias("severity"))
    ruled = cut_lineage(first_rows(once, ["risk_entity_id"], [F.col("detector_name")], max_cards - 1))
    evidence = first_rows(named.join(ruled.select("risk_card_id"), "risk_card_id", "left_semi"), ["risk_card_id"], [F.col("severity")], max_evidence)
    evidence = cut_lineage(evidence.select(
        F.concat(F.lit("ev_"), "risk_card_id", F.lit("_"), "severity").alias("evidence_id"), "risk_card_id", "risk_entity_id", "candidate_id",
        F.col("detector_name").alias("evidence_type"), F.col("severity").alias("evidence_level"), F.concat("detector_name", F.lit(": "), "severity").alias("evidence_text")))
    card = ruled.select(
        "risk_card_id", "risk_entity_id", "candidate_id", F.lit("evidence").alias("card_type"), F.expr("case severity when 'high' then 'orange' else 'yellow' end").alias("card_level"),
        F.col("detector_name").alias("source_detector_name"), F.lit(False).alias("is_primary"))
    counted = evidence.groupBy("risk_card_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    cards = cut_lineage(primary.unionByName(card).join(counted, "risk_card_id", "left").fillna(0, ["evidence_count"]))
    per = cards.groupBy("risk_entity_id").agg(F.count(F.lit(1)).alias("risk_card_count"))
    counts = [F.count(F.lit(1)).alias("risk_entity_count"), *[F.count_if(f"is_{k}").alias(f"{k}_count") for k in ("high_risk", "observation", "one_shot")]]
    return {
        "risk_entities": entities.join(per, "risk_entity_id", "left").fillna(0, ["risk_card_count"]),
        "risk_cards": cards,
        "risk_card_evidence": evidence,
        "hospital_aggregates": entities.groupBy("tenant_id", "report_month", "hospital_code").agg(*counts),
        "drug_aggregates": entities.groupBy("tenant_id", "report_month", "drug_group").agg(*counts),
        "monthly_reports": entities.groupBy("tenant_id", "report_month").agg(
            F.concat(F.lit("monthly_"), F.col("report_month")).alias("monthly_report_id"), *counts,
            F.countDistinct("hospital_code").alias("key_hospital_count"), F.countDistinct("drug_group").alias("key_drug_count")),
    }


def run_checks(
    tables: Mapping[str, DataFrame], rows: Mapping[str, Mapping[str, str]], unique: Mapping[str, Sequence[str]], children: Sequence[tuple[str, str, str]] = (),
    totals: Sequence[tuple[str, str, str]] = (),
) -> DataFrame:
    """One row per check: table_name, check_name, row_count, violations, passed.

    `rows` holds conditions that every row of a table must meet, all of a table in one aggregate (null doesn't meet one);
    `unique` keys; `children` (child, key, parent) whose keys must exist in the parent; `totals` (table, column, other)
    whose sum must be the number of rows of the other table. An empty table passes its row conditions.
    """
    out = None
    for name, df in tables.items():
        conditions = dict(rows.get(name, {}))
        aggs = [F.count(F.lit(1)).alias("row_count"), *[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"v{i}") for i, c in enumerate(conditions.values())]]
        names = ["has_rows", *conditions]
        values = [F.when(F.col("row_count") > 0, F.lit(0)).otherwise(F.lit(1)).cast("long"), *[F.col(f"v{i}") for i in range(len(conditions))]]
        structs = [F.struct(F.lit(n).alias("check_name"), v.alias("violations")) for n, v in zip(names, values, strict=True)]
        part = df.agg(*aggs).select(F.lit(name).alias("table_name"), "row_count", F.inline(F.array(*structs)))
        if name in unique:
            key = unique[name]
            counted = df.groupBy(*key).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
            part = part.unionByName(counted.select(F.lit(name).alias("table_name"), "row_count", F.lit("unique_" + "_".join(key)).alias("check_name"), "violations"))
        out = part if out is None else out.unionByName(part)
    for child, key, parent in children:
        marked = tables[child].join(tables[parent].select(key).distinct().withColumn("_there", F.lit(1)), key, "left")
        part = marked.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("_there").isNull()).alias("violations"))
        out = out.unionByName(part.select(F.lit(child).alias("table_name"), "row_count", F.lit(f"{key}_in_{parent}").alias("check_name"), "violations"))
    for table, column, other in totals:
        size = tables[other].agg(F.count(F.lit(1))).scalar()
        part = tables[table].agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(column), F.lit(0)).alias("_sum")).withColumn("_size", size)
        out = out.unionByName(part.select(F.lit(table).alias("table_name"), "row_count", F.lit(f"{column}_adds_up_to_{other}").alias("check_name"), F.abs(F.col("_sum") - F.col("_size")).alias("violations")))
    return out.withColumn("passed", F.col("violations") == 0)
