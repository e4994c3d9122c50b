"""Backtest frames, their policy metrics, closure tables and their validation, over all cutoffs and horizons."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog import evaluation as EV
from orderpulse.catalog import features as FQ
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.functions.exprs import nudge, round_all
from orderpulse.operators import backtest_frames as BF
from orderpulse.operators import labels as L
from orderpulse.operators import research_rules as RR
from orderpulse.operators import results as T
from orderpulse.schemas import ENTITY
from orderpulse.session import cut_lineage

_E = "manufacturer_code, hospital_code, drug_group"
KEY = [*ENTITY, "cutoff_month", "horizon"]
#: What tells the rows of a horizon apart.
TIES = [*ENTITY, "cutoff_month"]
_T = f"{_E}, cutoff_month"

# Rule outputs and monthly status of every cutoff and horizon.
cte("mouta", " UNION ALL ".join(
    f"SELECT candidate_id, cutoff_month, '{d}' AS detector_name, ({m}) {c} AS hit_flag, CASE WHEN ({m}) {c} THEN '{s1}' ELSE '{s0}' END AS severity FROM featx WHERE {scope}"
    for d, _f, m, c, s1, s0, _c, scope in RR.MONTHLY_RULES).replace("0D", "0"))
cte("msta", """
SELECT entity_id || '|' || horizon AS candidate_id, m.*, p * v AS prio, coalesce(hh, 0) AS detector_hit_count, sample_class = 'one_shot' AS is_one_shot, sample_class = 'recurring' AND p >= 0.6 AS is_high_risk,
  CASE WHEN sample_class = 'one_shot' THEN 'one_shot_attention' WHEN sample_class = 'recurring' AND p >= 0.6 THEN 'priority_review' WHEN sample_class = 'recurring' THEN 'manual_review' ELSE 'not_actionable' END AS final_candidate_status,
  CASE WHEN sample_class = 'recurring' AND p >= 0.6 THEN 'P1' WHEN sample_class = 'recurring' THEN 'P2' ELSE 'P3' END AS review_priority,
  CASE WHEN sample_class = 'recurring' AND p >= 0.6 THEN 'orange' WHEN sample_class = 'recurring' THEN 'yellow' WHEN sample_class = 'one_shot' THEN 'attention' ELSE 'insufficient' END AS risk_level,
  CASE WHEN coalesce(hh, 0) >= 2 THEN 'medium' WHEN coalesce(hh, 0) = 1 THEN 'weak' ELSE 'insufficient' END AS evidence_strength
FROM mfa m LEFT JOIN (SELECT candidate_id AS cid, cutoff_month AS cm, count(*) FILTER (hit_flag) AS hh FROM mouta GROUP BY ALL) o ON o.cid = entity_id || '|' || horizon AND o.cm = m.cutoff_month
""")


def outputs(spark, sf, months=None):
    return RR.monthly_rules(FQ.scored(spark, sf, months))


def candidates(spark, sf, months=None):
    return EV.all_rows(spark, sf, months).selectExpr("*", "concat(entity_id, '|', horizon) as candidate_id", "p * v as prio")


_DEC = ["final_candidate_status", "review_priority", "risk_level", "evidence_strength"]


@query("status_monthly_all", f"SELECT candidate_id, cutoff_month, detector_hit_count, {', '.join(_DEC)}, is_high_risk FROM msta")
def _(spark, sf):
    return T.monthly_status(candidates(spark, sf), outputs(spark, sf)).select("candidate_id", "cutoff_month", "detector_hit_count", *_DEC, "is_high_risk")


cte("rbf", f"""
WITH s AS (SELECT candidate_id, cutoff_month, string_agg(part, ';' ORDER BY part) AS summary FROM (
  SELECT candidate_id, cutoff_month, detector_name || ':' || coalesce(severity, '') AS part, row_number() OVER (PARTITION BY candidate_id, cutoff_month ORDER BY detector_name || ':' || coalesce(severity, '')) AS i
  FROM mouta WHERE hit_flag) WHERE i <= 5 GROUP BY ALL)
SELECT m.candidate_id, {_E}, m.cutoff_month, horizon, p, v, prio, CASE WHEN closed THEN 1 - y END AS label_alive, CASE WHEN closed THEN y END AS label_die, closed AS label_window_closed,
  m.cutoff_month AS label_window_start, last_day((m.cutoff_month + INTERVAL (h) MONTH)::DATE) AS label_window_end,
  row_number() OVER (PARTITION BY m.cutoff_month, horizon ORDER BY p DESC, {_E}) AS rank_probability_global, row_number() OVER (PARTITION BY m.cutoff_month, horizon ORDER BY prio DESC, {_E}) AS rank_business_priority_global,
  row_number() OVER (PARTITION BY m.cutoff_month, horizon, manufacturer_code ORDER BY p DESC, {_E}) AS rank_probability_within_manufacturer,
  row_number() OVER (PARTITION BY m.cutoff_month, horizon, manufacturer_code ORDER BY prio DESC, {_E}) AS rank_business_priority_within_manufacturer,
  final_candidate_status, review_priority, evidence_strength, summary AS detector_hit_summary
FROM msta m LEFT JOIN s USING (candidate_id, cutoff_month) WHERE sample_class = 'recurring'
""")
_RB = ["candidate_id", "cutoff_month", "label_alive", "label_die", "label_window_closed", "label_window_start", "label_window_end", "rank_probability_global", "rank_business_priority_global",
       "rank_probability_within_manufacturer", "rank_business_priority_within_manufacturer", "final_candidate_status", "review_priority", "evidence_strength", "detector_hit_summary"]


def recurring(spark, sf):
    c = cut_lineage(candidates(spark, sf))
    out = cut_lineage(outputs(spark, sf))
    scored = c.where("sample_class = 'recurring'").select("candidate_id", *KEY, "p", "v", "prio")
    labels = L.long_labels(EV.labelled(spark, sf), [*ENTITY, "cutoff_month"])
    return BF.recurring_frame(scored, labels, T.monthly_status(c, out), out, "severity")


@query("backtest_recurring_rows", f"SELECT {', '.join(_RB)} FROM rbf")
def _(spark, sf):
    return recurring(spark, sf).select(*_RB)


TRAIN_END = "1996-12-31"
_GROUPS = ["drug_category_code", "province_code"]
cte("osf", f"""
WITH l AS ({' UNION ALL '.join(f"SELECT {_E}, drug_category_code, province_code, first_purchase_month, first_purchase_time, first_purchase_amount, 'H{h}' AS horizon, (first_purchase_time + INTERVAL {h} MONTH)::DATE AS we, label_window_closed_H{h} AS label_window_closed, label_repeat_H{h} AS label_repeat FROM fps" for h in (3, 6, 12))}),
past AS (SELECT * FROM l WHERE we <= DATE '{TRAIN_END}' AND label_repeat IS NOT NULL),
o AS (SELECT horizon, avg(label_repeat) AS overall FROM past GROUP BY horizon),
g AS (SELECT horizon, drug_category_code, province_code, count(*) AS n, sum(label_repeat) AS pos FROM past GROUP BY ALL),
a AS (SELECT l.*, round((coalesce(pos, 0) + overall * 20) / (coalesce(n, 0) + 20), 9) AS repeat_probability FROM l JOIN o USING (horizon)
  LEFT JOIN g ON g.horizon = l.horizon AND g.drug_category_code IS NOT DISTINCT FROM l.drug_category_code AND g.province_code IS NOT DISTINCT FROM l.province_code WHERE first_purchase_month > DATE '{TRAIN_END}'),
b AS (SELECT *, round(1 - repeat_probability, 9) AS non_repeat_risk, 1 - label_repeat AS label_non_repeat FROM a),
c AS (SELECT *, round(non_repeat_risk * ln(1 + greatest(first_purchase_amount, 0)), 9) AS selected_attention FROM b)
SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY repeat_probability DESC, {_E}) AS rank_repeat_probability, row_number() OVER (PARTITION BY horizon ORDER BY non_repeat_risk DESC, {_E}) AS rank_non_repeat_risk,
  row_number() OVER (PARTITION BY horizon ORDER BY selected_attention DESC, {_E}) AS rank_selected_attention FROM c
""")
_OS = ["horizon", "first_purchase_month", "label_window_closed", "label_repeat", "label_non_repeat"]


def one_shot(spark, sf):
    return BF.one_shot_frame(EV.samples(spark, sf), TRAIN_END, _GROUPS)


@query("backtest_one_shot_rows", f"SELECT {_E}, {', '.join(_OS)}, {rnd('repeat_probability', 6)} AS repeat_probability, {rnd('non_repeat_risk', 6)} AS non_repeat_risk, rank_repeat_probability, rank_non_repeat_risk FROM osf")
def _(spark, sf):
    return round_all(one_shot(spark, sf).select(*ENTITY, *_OS, "repeat_probability", "non_repeat_risk", "rank_repeat_probability", "rank_non_repeat_risk"), 6)


@query("model_attention_scores", f"""
SELECT {_E}, horizon, {rnd('(1 - repeat_probability) * first_purchase_amount', 4)} AS retention_risk_score, {rnd('repeat_probability * first_purchase_amount', 4)} AS conversion_opportunity_score,
  {rnd('repeat_probability * (1 - repeat_probability) * first_purchase_amount', 4)} AS balanced_attention_score FROM osf
""")
def _(spark, sf):
    from orderpulse.operators import models as M

    s = M.attention_scores(one_shot(spark, sf), "repeat_probability", "first_purchase_amount")
    return round_all(s.select(*ENTITY, "horizon", "retention_risk_score", "conversion_opportunity_score", "balanced_attention_score"), 4)


_MET = ["row_count", "positive_rate", "brier_score", "log_loss", "roc_auc", "ece", "average_precision"]


def _probability_sql(src: str, order: str) -> str:
    q = "least(greatest(p, 1e-15), 1 - 1e-15)"
    return f"""SELECT horizon, row_count, {', '.join(rnd(c, 6) + ' AS ' + c for c in _MET[1:])} FROM (
  SELECT horizon, count(*) AS row_count, avg(y) AS positive_rate, avg((p - y) * (p - y)) AS brier_score, avg(-(y * ln({q}) + (1 - y) * ln(1 - {q}))) AS log_loss FROM {src} GROUP BY horizon)
  LEFT JOIN (SELECT horizon, auc AS roc_auc FROM ({EV.auc_sql(src, 'horizon')})) USING (horizon) LEFT JOIN ({EV.ece_sql(src, 'horizon')}) USING (horizon)
  LEFT JOIN (SELECT horizon, sum(tp / r) / max(t) AS average_precision FROM (SELECT horizon, y, row_number() OVER w AS r, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER (PARTITION BY horizon) AS t
    FROM {src} WINDOW w AS (PARTITION BY horizon ORDER BY p DESC, {order})) WHERE y = 1 GROUP BY horizon) USING (horizon)"""


@query("backtest_v2_probability", f"WITH bp AS (SELECT horizon, {_T}, label_die AS y, p FROM rbf WHERE label_die IS NOT NULL)\n{_probability_sql('bp', _T)}")
def _(spark, sf):
    rows = recurring(spark, sf)
    return round_all(BF.probability_table(rows, "label_die", "p", TIES).select("horizon", *_MET), 6)


@query("backtest_v2_one_shot", f"WITH bo AS (SELECT horizon, {_E}, label_repeat AS y, repeat_probability AS p FROM osf WHERE label_repeat IS NOT NULL)\n{_probability_sql('bo', _E)}")
def _(spark, sf):
    return round_all(BF.probability_table(one_shot(spark, sf), "label_repeat", "repeat_probability").select("horizon", *_MET), 6)


@query("backtest_v2_bins", f"""
SELECT horizon, greatest(ceil(p * 10)::INTEGER - 1, 0) + 1 AS bin_id, count(*) AS row_count, {rnd('avg(p)', 6)} AS average, {rnd('avg(label_die)', 6)} AS observed, {rnd('min(p)', 6)} AS min_pred, {rnd('max(p)', 6)} AS max_pred
FROM rbf WHERE label_die IS NOT NULL GROUP BY ALL
""")
def _(spark, sf):
    return round_all(BF.bin_table(recurring(spark, sf), "label_die", "p"), 6)


def _k(k, n):
    return f"greatest(1, least({n}, ceil({n} * {float(k.split('_')[1]) / 100})::BIGINT))" if isinstance(k, str) else f"least({k}, {n})"


def _topk_sql(src: str, policies: dict, means: list, sums: list, ks: list, order: str) -> str:
    ranked = " UNION ALL ".join(
        f"SELECT horizon, '{n}' AS policy, {label} AS y, {', '.join(dict.fromkeys([*means, *sums]))}, row_number() OVER (PARTITION BY horizon ORDER BY {score} DESC, {order}) AS r, count(*) OVER (PARTITION BY horizon) AS n FROM {src}"
        for n, (score, label) in policies.items())
    parts = []
    for k in ks:
        top = f"r <= {_k(k, 'n')}"
        extra = "".join(f", {rnd(f'avg({c}) FILTER ({top})', 6)} AS avg_{c}" for c in means) + "".join(f", round(sum({c}) FILTER ({top}) + {nudge(2)!r}, 2) AS sum_{c}" for c in sums)
        parts.append(f"""SELECT horizon, policy, max(n) AS row_count, {rnd('avg(y)', 6)} AS base_rate, '{k}' AS k, count(*) FILTER ({top}) AS topk_count, CAST(sum(y) FILTER ({top}) AS BIGINT) AS hit_count,
  {rnd(f'avg(y) FILTER ({top})', 6)} AS precision_at_k, {rnd(f'(avg(y) FILTER ({top})) / nullif(avg(y), 0)', 6)} AS lift_vs_base,
  {rnd(f'sum(y / log2(r + 1)) FILTER ({top}) / nullif(max(i{ks.index(k)}), 0)', 6)} AS ndcg_at_k{extra} FROM rk JOIN ideal USING (horizon, policy) GROUP BY horizon, policy""")
    hits = ", ".join(f"sum(y) FILTER (r <= {_k(k, 'n')}) AS h{i}" for i, k in enumerate(ks))
    ideals = ", ".join(f"sum(1 / log2(r + 1)) FILTER (r <= h{i}) AS i{i}" for i in range(len(ks)))
    return f"""WITH rk AS MATERIALIZED ({ranked}), hits AS (SELECT horizon, policy, {hits} FROM rk GROUP BY ALL), ideal AS (SELECT horizon, policy, {ideals} FROM rk JOIN hits USING (horizon, policy) GROUP BY ALL)
""" + "\nUNION ALL ".join(parts)


_POL = {"probability_topk": ("p", "label_die"), "business_priority_topk": ("prio", "label_die")}
cte("rbc", "SELECT * FROM rbf WHERE label_die IS NOT NULL")
cte("osc", "SELECT * FROM osf WHERE label_repeat IS NOT NULL")


@query("backtest_v2_topk", _topk_sql("rbc", _POL, ["p"], ["v"], BF.K_SPECS, _T))
def _(spark, sf):
    rows = recurring(spark, sf)
    m = BF.policy_topk(rows, _POL, ["p"], ["v"], ties=TIES)
    return round_all(m.withColumn("sum_v", F.round(F.col("sum_v") + nudge(2), 2)), 6)


_DIR = {"repeat_opportunity": ("repeat_probability", "label_repeat"), "non_repeat_risk": ("non_repeat_risk", "label_non_repeat"), "selected_attention": ("selected_attention", "label_repeat")}


@query("backtest_v2_one_shot_topk", _topk_sql("osc", _DIR, ["repeat_probability", "non_repeat_risk"], [], BF.ONE_SHOT_K_SPECS, _E))
def _(spark, sf):
    return round_all(BF.policy_topk(one_shot(spark, sf), _DIR, ["repeat_probability", "non_repeat_risk"], [], BF.ONE_SHOT_K_SPECS), 6)


@query("backtest_v2_policy_overlap", f"""
WITH r AS (SELECT horizon, label_die AS y, row_number() OVER (PARTITION BY horizon ORDER BY p DESC, {_T}) AS a, row_number() OVER (PARTITION BY horizon ORDER BY prio DESC, {_T}) AS b, count(*) OVER (PARTITION BY horizon) AS n FROM rbc)
""" + "\nUNION ALL ".join(f"""SELECT horizon, '{k}' AS k, count(*) FILTER (a <= {_k(k, 'n')} AND b <= {_k(k, 'n')}) AS overlap_count, {rnd(f"count(*) FILTER (a <= {_k(k, 'n')} AND b <= {_k(k, 'n')}) / count(*) FILTER (b <= {_k(k, 'n')})", 6)} AS overlap_rate,
  {rnd(f"avg(y) FILTER (a <= {_k(k, 'n')})", 6)} AS probability_rate, {rnd(f"avg(y) FILTER (b <= {_k(k, 'n')})", 6)} AS business_rate FROM r GROUP BY horizon""" for k in BF.K_SPECS))
def _(spark, sf):
    rows = recurring(spark, sf)
    return round_all(BF.policy_overlap(rows, {"probability": "p", "business": "prio"}, "label_die", ties=TIES), 6)


# Closure: status, bundle, contract tables and their checks.
cte("clst", """
WITH g AS (
  SELECT m.*, entity_id || '|' || horizon AS candidate_id, CASE WHEN sample_class = 'one_shot' OR history_sufficiency_flag = 'history_insufficient' THEN 'hidden_data_insufficient'
    WHEN history_sufficiency_flag = 'history_sufficient' AND demand_shape_label NOT IN ('intermittent', 'lumpy', 'cold_start', 'unknown') AND p >= 0.45 THEN 'probability_allowed'
    WHEN history_sufficiency_flag = 'history_medium' OR demand_shape_label IN ('intermittent', 'lumpy') OR p < 0.45 THEN 'risk_band_only' ELSE 'observation_only' END AS lvl FROM mfa m
), j AS (
  SELECT g.*, survival_state, coalesce(hn, 0) AS hn, coalesce(sn, 0) AS sn, CASE WHEN sample_class = 'one_shot' THEN 'one_shot' WHEN g.demand_shape_label = 'lumpy' OR lvl = 'observation_only' THEN 'demand_shape_observation' ELSE 'recurring_business_priority' END AS candidate_type
  FROM g LEFT JOIN (SELECT entity_id, cutoff_month, survival_state FROM surv) s USING (entity_id, cutoff_month)
    LEFT JOIN (SELECT candidate_id AS cid, cutoff_month AS cm, count(*) FILTER (hit_flag) AS hn, count(*) FILTER (hit_flag AND severity = 'high') AS sn FROM mouta GROUP BY ALL) o ON o.cid = g.candidate_id AND o.cm = g.cutoff_month
), c AS (SELECT *, CASE WHEN candidate_type = 'one_shot' THEN 1 WHEN candidate_type = 'demand_shape_observation' THEN 2 WHEN lvl = 'hidden_data_insufficient' THEN 3 WHEN sn > 0 AND lvl IN ('probability_allowed', 'risk_band_only') THEN 4 WHEN hn > 0 THEN 5 ELSE 6 END AS k FROM j)
SELECT c.*, ['one_shot_attention', 'observation_only', 'not_actionable', 'priority_review', 'manual_review', 'low_confidence_watch'][k] AS final_candidate_status, ['P2', 'P2', 'P3', 'P0', 'P1', 'P2'][k] AS review_priority,
  ['weak', 'weak', 'insufficient', 'strong', 'medium', 'weak'][k] AS evidence_strength, k <= 3 AS data_quality_warning_flag, 're_' || strftime(cutoff_month, '%Y%m') || '_' || candidate_id AS risk_entity_id FROM c
""")
cte("clhit", "SELECT c.risk_entity_id, o.candidate_id, o.detector_name, o.severity, 'rc_' || risk_entity_id || '_' || detector_name AS risk_card_id, row_number() OVER (PARTITION BY risk_entity_id ORDER BY detector_name) AS i FROM mouta o JOIN clst c USING (candidate_id, cutoff_month) WHERE hit_flag")


def closure(spark, sf):
    from orderpulse.catalog import candidates as CQ
    from orderpulse.operators import candidates as K
    from orderpulse.operators import closure as C

    months = common.settled_months(spark, sf)
    out = cut_lineage(outputs(spark, sf, months))
    gated = K.availability_gate(candidates(spark, sf, months))
    survival = CQ.refined(spark, sf, months).select("entity_id", "cutoff_month", "survival_state")
    return cut_lineage(C.closure_status(gated, survival, out)), out


@query("closure_status", "SELECT candidate_id, cutoff_month, candidate_type, final_candidate_status, review_priority, evidence_strength, data_quality_warning_flag, hn AS detector_hit_count, sn AS strong_detector_hit_count, lvl AS probability_display_level, survival_state FROM clst")
def _(spark, sf):
    return closure(spark, sf)[0].select(
        "candidate_id", "cutoff_month", "candidate_type", "final_candidate_status", "review_priority", "evidence_strength", "data_quality_warning_flag", "detector_hit_count", "strong_detector_hit_count", "probability_display_level", "survival_state")


@query("closure_bundles", f"""
WITH d AS (SELECT candidate_id, cutoff_month, string_agg(detector_name || '=' || severity, ';' ORDER BY detector_name) AS detectors, count(*) AS n FROM mouta WHERE hit_flag GROUP BY ALL)
SELECT 'bundle|' || candidate_id AS bundle_id, candidate_id, cutoff_month, candidate_type, final_candidate_status, CASE WHEN lvl = 'probability_allowed' THEN {rnd('p', 6)} END AS probability, survival_state,
  coalesce(detectors, '') AS detectors, coalesce(n, 0)::INTEGER AS detector_count, 4 AS forbidden_count FROM clst LEFT JOIN d USING (candidate_id, cutoff_month)
""")
def _(spark, sf):
    from orderpulse.operators import closure as C

    status, out = closure(spark, sf)
    b = C.read_bundles(C.evidence_bundles(status, out))
    named = F.array_join(F.transform("detectors", lambda x: F.concat(x["detector_name"], F.lit("="), x["severity"])), ";")
    return round_all(b.select("bundle_id", "candidate_id", "cutoff_month", "candidate_type", "final_candidate_status", "probability", "survival_state", named.alias("detectors"),
                              F.size("detectors").alias("detector_count"), F.size("forbidden_claims").alias("forbidden_count")), 6)


def tables(spark, sf):
    from orderpulse.operators import closure as C

    return C.closure_tables(*closure(spark, sf))


_LEVEL = "CASE k WHEN 4 THEN 'orange' WHEN 5 THEN 'yellow' WHEN 1 THEN 'attention' WHEN 2 THEN 'observation' ELSE 'insufficient' END"
cte("clent", f"SELECT risk_entity_id, candidate_id, {_E}, horizon, strftime(cutoff_month, '%Y-%m') AS report_month, {_LEVEL} AS risk_level, final_candidate_status, k = 1 AS is_one_shot, k = 2 AS is_observation, k = 4 AS is_high_risk FROM clst")


@query("closure_risk_entities", "SELECT e.*, 1 + coalesce(n, 0) AS risk_card_count FROM clent e LEFT JOIN (SELECT risk_entity_id, count(*) AS n FROM clhit WHERE i <= 4 GROUP BY ALL) USING (risk_entity_id)")
def _(spark, sf):
    return tables(spark, sf)["risk_entities"].select("risk_entity_id", "candidate_id", *ENTITY, "horizon", "report_month", "risk_level", "final_candidate_status", "is_one_shot", "is_observation", "is_high_risk", "risk_card_count")


@query("closure_risk_cards", """
SELECT 'rc_' || risk_entity_id || '_primary' AS risk_card_id, risk_entity_id, CASE WHEN is_one_shot THEN 'one_shot_attention' WHEN is_observation THEN 'demand_shape_observation' ELSE 'primary_risk' END AS card_type, risk_level AS card_level,
  'primary' AS source_detector_name, true AS is_primary, 0 AS evidence_count FROM clent
UNION ALL SELECT risk_card_id, risk_entity_id, 'evidence', CASE severity WHEN 'high' THEN 'orange' ELSE 'yellow' END, detector_name, false, 1 FROM clhit WHERE i <= 4
""")
def _(spark, sf):
    return tables(spark, sf)["risk_cards"].drop("candidate_id")


@query("closure_card_evidence", "SELECT 'ev_' || risk_card_id || '_' || severity AS evidence_id, risk_card_id, risk_entity_id, candidate_id, detector_name AS evidence_type, severity AS evidence_level, detector_name || ': ' || severity AS evidence_text FROM clhit WHERE i <= 4")
def _(spark, sf):
    return tables(spark, sf)["risk_card_evidence"]


_COUNTS = "count(*) AS risk_entity_count, count(*) FILTER (is_high_risk) AS high_risk_count, count(*) FILTER (is_observation) AS observation_count, count(*) FILTER (is_one_shot) AS one_shot_count"


@query("closure_aggregates", f"SELECT 'hospital' AS level, report_month, hospital_code AS code, {_COUNTS} FROM clent GROUP BY ALL UNION ALL SELECT 'drug', report_month, drug_group, {_COUNTS} FROM clent GROUP BY ALL")
def _(spark, sf):
    t = tables(spark, sf)
    side = lambda name, c, level: t[name].withColumnRenamed(c, "code").withColumn("level", F.lit(level)).drop("tenant_id")
    return side("hospital_aggregates", "hospital_code", "hospital").unionByName(side("drug_aggregates", "drug_group", "drug"))


@query("closure_monthly_reports", f"SELECT 'monthly_' || report_month AS monthly_report_id, report_month, {_COUNTS}, count(DISTINCT hospital_code) AS key_hospital_count, count(DISTINCT drug_group) AS key_drug_count FROM clent GROUP BY report_month")
def _(spark, sf):
    return tables(spark, sf)["monthly_reports"].drop("tenant_id")


CHECKS = {
    "risk_entities": {"no_auto_dispatch": "not auto_dispatch_allowed", "has_primary_card": "risk_card_count >= 1", "at_most_five_cards": "risk_card_count <= 5", "status_known": "final_candidate_status is not null"},
    "risk_cards": {"level_known": "card_level is not null", "rule_card_has_evidence": "is_primary or evidence_count > 0"},
    "risk_card_evidence": {"text_not_empty": "length(evidence_text) > 0", "no_forbidden_text": "not exists(array('guaranteed churn', 'confirmed lost customer', 'automatic dispatch', 'exact churn date'), x -> contains(lower(evidence_text), x))"},
    "hospital_aggregates": {"parts_within_total": "high_risk_count + observation_count + one_shot_count <= risk_entity_count"},
    "monthly_reports": {"id_matches_month": "monthly_report_id = concat('monthly_', report_month)"},
}
UNIQUE = {"risk_entities": ["risk_entity_id"], "risk_cards": ["risk_card_id"], "risk_card_evidence": ["evidence_id"]}
CHILDREN = [("risk_cards", "risk_entity_id", "risk_entities"), ("risk_card_evidence", "risk_card_id", "risk_cards")]
TOTALS = [("hospital_aggregates", "risk_entity_count", "risk_entities"), ("risk_entities", "risk_card_count", "risk_cards"), ("risk_cards", "evidence_count", "risk_card_evidence")]
_SIZES = {
    "risk_entities": "(SELECT count(*) FROM clent)", "risk_cards": "(SELECT (SELECT count(*) FROM clent) + count(*) FROM clhit WHERE i <= 4)", "risk_card_evidence": "(SELECT count(*) FROM clhit WHERE i <= 4)",
    "hospital_aggregates": "(SELECT count(*) FROM (SELECT DISTINCT report_month, hospital_code FROM clent))", "monthly_reports": "(SELECT count(DISTINCT report_month) FROM clent)",
}
_NAMES = [(t, c) for t, cs in CHECKS.items() for c in ["has_rows", *cs]] + [(t, "unique_" + "_".join(k)) for t, k in UNIQUE.items()] + [(c, f"{k}_in_{p}") for c, k, p in CHILDREN] + [(t, f"{c}_adds_up_to_{o}") for t, c, o in TOTALS]


@query("closure_validation", "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS check_name, CAST({_SIZES[t]} AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS violations, true AS passed" for t, c in _NAMES))
def _(spark, sf):
    from orderpulse.operators import closure as C

    made = tables(spark, sf)
    made["risk_entities"] = cut_lineage(made["risk_entities"])
    return C.run_checks({t: made[t] for t in CHECKS}, CHECKS, UNIQUE, CHILDREN, TOTALS)
