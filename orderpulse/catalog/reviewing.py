"""Audits of the closure's evidence bundles, the sample for their review, survival reports and views by horizon."""

from pyspark.sql import functions as F

from orderpulse.catalog import candidates as CQ
from orderpulse.catalog import closing
from orderpulse.catalog import features as FQ
from orderpulse.catalog.base import query, rnd
from orderpulse.functions.exprs import round_all
from orderpulse.operators import candidates as K
from orderpulse.operators import closure as C
from orderpulse.operators import results as T
from orderpulse.operators import reviews as V
from orderpulse.operators import serving as G
from orderpulse.operators import survival as SV
from orderpulse.session import cut_lineage


def bundles(spark, sf):
    return C.read_bundles(C.evidence_bundles(*closing.closure(spark, sf)))


_SHOWN = "(lvl = 'probability_allowed' AND p IS NOT NULL)"


@query("closure_claim_consistency", f"""
WITH v AS (
  SELECT candidate_id, cutoff_month, candidate_type, 'one_shot_probability_present' AS violation_type FROM clst WHERE candidate_type = 'one_shot' AND {_SHOWN}
  UNION ALL SELECT DISTINCT candidate_id, cutoff_month, candidate_type, 'interface_only_detector_in_evidence' FROM clst JOIN (SELECT candidate_id, cutoff_month, detector_name FROM mouta WHERE hit_flag) USING (candidate_id, cutoff_month)
    WHERE detector_name IN ('low_price_purchase_warning', 'order_price_spread_warning', 'rejection_response_warning', 'delayed_response_warning', 'low_delivery_rate_warning')
)
SELECT candidate_id, cutoff_month, candidate_type, false AS claim_check_pass, violation_type FROM v
UNION ALL SELECT candidate_id, cutoff_month, candidate_type, true, '' FROM clst ANTI JOIN v USING (candidate_id, cutoff_month)
""")
def _(spark, sf):
    return V.claim_consistency(bundles(spark, sf))


@query("closure_actionability", f"""
WITH m AS (
  SELECT candidate_id, cutoff_month, candidate_type, CASE candidate_type
    WHEN 'recurring_business_priority' THEN concat_ws(';', CASE WHEN NOT {_SHOWN} THEN 'probability' END, CASE WHEN survival_state IS NULL THEN 'survival_state' END, CASE WHEN survival_state IS NULL AND hn = 0 THEN 'detectors_or_survival_state' END)
    WHEN 'one_shot' THEN CASE WHEN {_SHOWN} THEN 'recurring_probability_hidden' ELSE '' END
    ELSE CASE WHEN demand_shape_label IS NULL THEN 'demand_shape_label' ELSE '' END END AS missing_critical_fields FROM clst
)
SELECT *, missing_critical_fields = '' AS actionable_flag, CASE WHEN missing_critical_fields = '' THEN 'minimum_structured_material_available' ELSE 'missing_critical_fields' END AS actionability_note FROM m
""")
def _(spark, sf):
    return V.actionability(bundles(spark, sf))


def _rate(condition: str) -> str:
    return rnd(f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)", 6)


@query("closure_field_completeness", f"""
SELECT candidate_type, final_candidate_status, review_priority, evidence_strength, count(*) AS row_count, {_rate(_SHOWN)} AS probability_rate, {_rate('survival_state IS NOT NULL')} AS survival_state_rate,
  {_rate('demand_shape_label IS NOT NULL')} AS demand_shape_label_rate, {_rate('hn > 0')} AS detectors_rate, 1.0::DOUBLE AS allowed_claims_rate, 1.0::DOUBLE AS forbidden_claims_rate, 1.0::DOUBLE AS auto_dispatch_false_rate
FROM clst GROUP BY ALL
""")
def _(spark, sf):
    return round_all(V.field_completeness(bundles(spark, sf)), 6)


def _stratum(column: str, value: str, limit: int) -> str:
    place = "list_position(['priority_review', 'manual_review', 'low_confidence_watch', 'observation_only', 'one_shot_attention', 'not_actionable'], final_candidate_status)"
    return f"(SELECT candidate_id, cutoff_month FROM clst WHERE {column} = '{value}' ORDER BY review_priority, {place}, p * v DESC NULLS LAST, candidate_id, cutoff_month LIMIT {limit})"


_STRATA = [
    ("final_candidate_status", "priority_review", 20), ("final_candidate_status", "manual_review", 20), ("final_candidate_status", "low_confidence_watch", 10), ("final_candidate_status", "observation_only", 10),
    ("final_candidate_status", "one_shot_attention", 20), ("candidate_type", "demand_shape_observation", 10), ("review_priority", "P1", 10), ("review_priority", "P2", 10), ("evidence_strength", "insufficient", 10),
]


@query("closure_review_sample", "SELECT candidate_id, cutoff_month, final_candidate_status, review_priority FROM clst JOIN (" + "\nUNION ".join(_stratum(*s) for s in _STRATA) + ") USING (candidate_id, cutoff_month)")
def _(spark, sf):
    sample = V.stratified_sample(closing.closure(spark, sf)[0], "prio", ["candidate_id", "cutoff_month"])
    return sample.select("candidate_id", "cutoff_month", "final_candidate_status", "review_priority")


_FIELDS = ["survival_state", "history_sufficiency_flag", "demand_shape_label", "expected_interval_source"]


@query("survival_distributions", " UNION ALL ".join(
    f"SELECT '{c}' AS field, coalesce({c}, '__MISSING__') AS value, count(*) AS row_count, {rnd('count(*) / sum(count(*)) OVER ()', 6)} AS share FROM (SELECT *, expected_source AS expected_interval_source FROM surv) GROUP BY ALL" for c in _FIELDS))
def _(spark, sf):
    return round_all(SV.distributions(CQ.refined(spark, sf), _FIELDS), 6)


@query("survival_history_report", f"""
SELECT history_sufficiency_flag, count(*) AS row_count, {rnd('avg(survival_confidence)', 6)} AS avg_survival_confidence, {rnd('avg(overdue_ratio)', 6)} AS avg_overdue_ratio FROM surv GROUP BY ALL
""")
def _(spark, sf):
    return round_all(SV.history_report(CQ.refined(spark, sf)), 6)


@query("survival_route_report", f"""
SELECT demand_shape_label, demand_shape_route, alert_policy, count(*) AS row_count, {rnd('avg(survival_confidence)', 6)} AS avg_survival_confidence,
  {rnd("avg(CASE WHEN survival_state IN ('materially_overdue', 'likely_churn_interval') OR demand_shape_label IN ('erratic', 'intermittent', 'lumpy') OR history_sufficiency_flag <> 'history_sufficient' OR survival_confidence < 0.7 THEN 1.0 ELSE 0.0 END)", 6)} AS human_review_rate
FROM surv GROUP BY ALL
""")
def _(spark, sf):
    return round_all(SV.route_report(CQ.refined(spark, sf)), 6)


@query("survival_state_by_horizon", f"""
SELECT horizon, survival_state, count(*) AS row_count, {rnd('avg(p)', 6)} AS avg_probability, {rnd('avg(p * v)', 4)} AS avg_priority, {rnd('avg(survival_confidence)', 6)} AS avg_survival_confidence
FROM mfa JOIN (SELECT entity_id, cutoff_month, survival_state, survival_confidence FROM surv) USING (entity_id, cutoff_month) GROUP BY ALL
""")
def _(spark, sf):
    states = CQ.refined(spark, sf).select("entity_id", "cutoff_month", "survival_state", "survival_confidence")
    d = SV.state_distribution(closing.candidates(spark, sf).join(states, ["entity_id", "cutoff_month"]), "p", "prio")
    return round_all(d.withColumn("avg_priority", F.round(F.col("avg_priority") + 1.3e-7, 4)), 6)


@query("serve_horizon_view", f"""
WITH e AS (SELECT entity_id AS risk_entity_id, cutoff_month AS report_month FROM featx WHERE horizon = 'H6' AND sample_class = 'recurring')
SELECT risk_entity_id, report_month, horizon AS selected_horizon, {rnd('churn_probability_H', 6)} AS profile_risk_probability, 'purchase_amount_sum_last_' || h || 'm_asof_cutoff' AS involved_amount_source,
  CASE WHEN churn_probability_H >= 0.8 THEN 'red' WHEN churn_probability_H >= 0.6 THEN 'orange' WHEN churn_probability_H >= 0.4 THEN 'yellow' WHEN churn_probability_H IS NULL THEN 'unavailable' ELSE 'low' END AS risk_level
FROM e JOIN (SELECT entity_id AS risk_entity_id, cutoff_month AS report_month, horizon, h, churn_probability_H FROM featx) USING (risk_entity_id, report_month)
""")
def _(spark, sf):
    scored = cut_lineage(FQ.scored(spark, sf).withColumnRenamed("churn_probability_H", "p"))
    profiles = T.horizon_profiles(scored)
    entities = scored.where("horizon = 'H6' and sample_class = 'recurring'").selectExpr("entity_id as risk_entity_id", "cutoff_month as report_month", "horizon as primary_horizon", "'own' as risk_level")
    views = [G.horizon_view(entities, profiles, h)[0] for h in ("H3", "H6", "H12")]
    every = views[0].unionByName(views[1]).unionByName(views[2])
    return round_all(every.select("risk_entity_id", "report_month", "selected_horizon", "profile_risk_probability", "involved_amount_source", "risk_level"), 6)


@query("candidates_display_overlap", """
WITH u AS (SELECT entity_id, cutoff_month, bool_or(r) AS r, bool_or(NOT r) AS o FROM (SELECT entity_id, cutoff_month, true AS r FROM sel UNION ALL SELECT entity_id, cutoff_month, false FROM ob) GROUP BY ALL),
m AS (SELECT *, entity_id IN (SELECT entity_id FROM feat WHERE sample_class = 'one_shot') AS s FROM u)
SELECT entity_id, cutoff_month, r AS in_recurring_business_priority, o AS in_demand_shape_observation, s AS in_one_shot_attention,
  CASE WHEN r THEN 'recurring_business_priority' ELSE 'demand_shape_observation' END AS recommended_display_bucket,
  CASE WHEN r AND o AND s THEN 'demand_shape_observation;one_shot_attention' WHEN r AND o THEN 'demand_shape_observation' WHEN s THEN 'one_shot_attention' ELSE '' END AS suppressed_display_sources FROM m
""")
def _(spark, sf):
    one = CQ.entity_features(spark, sf).where("sample_class = 'one_shot'")
    return K.display_overlap(CQ.selected(spark, sf), CQ.observations(spark, sf), one)
