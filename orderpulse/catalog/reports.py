"""Result-table, serving, quality, sampling and source queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import candidates as CQ
from orderpulse.catalog import common
from orderpulse.catalog import detectors as DQ
from orderpulse.catalog import evaluation as EV
from orderpulse.catalog import events as EQ
from orderpulse.catalog import features as FQ
from orderpulse.catalog import models as MQ
from orderpulse.catalog import rules as RQ
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.functions.exprs import round_all
from orderpulse.operators import audits as N
from orderpulse.operators import quality as Q
from orderpulse.operators import research_rules as R
from orderpulse.operators import results as T
from orderpulse.operators import serving as G
from orderpulse.operators.ranking import quantiles
from orderpulse.schemas import ENTITY
from orderpulse.sources import star

_E = "manufacturer_code, hospital_code, drug_group"


# Monthly status, cards and bundles at the last cutoff with the H6 horizon.
_OUT = " UNION ALL ".join(
    f"SELECT candidate_id, cutoff_month, '{d}' AS detector_name, ({m}) {c} AS hit_flag, CASE WHEN ({m}) {c} THEN '{s1}' ELSE '{s0}' END AS severity FROM featx WHERE horizon = 'H6' AND cutoff_month = DATE '2000-12-31' AND {scope}"
    for d, _f, m, c, s1, s0, _c, scope in R.MONTHLY_RULES).replace("0D", "0")
cte("mout", _OUT)
cte("mst", """
SELECT entity_id || '|' || horizon AS candidate_id, m.*, p * v AS prio, coalesce(h, 0) AS detector_hit_count, sample_class = 'one_shot' AS is_one_shot, sample_class = 'recurring' AND p >= 0.6 AS is_high_risk,
  CASE WHEN sample_class = 'one_shot' THEN 'one_shot_attention' WHEN p >= 0.6 THEN 'priority_review' ELSE 'manual_review' END AS final_candidate_status,
  CASE WHEN sample_class = 'recurring' AND p >= 0.6 THEN 'P1' WHEN sample_class = 'recurring' THEN 'P2' ELSE 'P3' END AS review_priority,
  CASE WHEN sample_class = 'recurring' AND p >= 0.6 THEN 'orange' WHEN sample_class = 'recurring' THEN 'yellow' ELSE 'attention' END AS risk_level,
  CASE WHEN coalesce(h, 0) >= 2 THEN 'medium' WHEN coalesce(h, 0) = 1 THEN 'weak' ELSE 'insufficient' END AS evidence_strength
FROM (SELECT * EXCLUDE (h) FROM mfa WHERE horizon = 'H6' AND cutoff_month = DATE '2000-12-31') m LEFT JOIN (SELECT candidate_id AS cid, count(*) FILTER (hit_flag) AS h FROM mout GROUP BY 1) o ON o.cid = entity_id || '|' || horizon
""")


def outputs(spark, sf):
    s = FQ.scored(spark, sf).where("horizon = 'H6' and cutoff_month = date'2000-12-31'")
    return R.monthly_rules(s)


def status(spark, sf):
    rows = EV.all_rows(spark, sf).where("horizon = 'H6' and cutoff_month = date'2000-12-31'").selectExpr("*", "concat(entity_id, '|', horizon) as candidate_id", "p * v as prio")
    return T.monthly_status(rows, outputs(spark, sf))


@query("status_monthly", "SELECT candidate_id, detector_hit_count, final_candidate_status, review_priority, risk_level, evidence_strength, is_high_risk FROM mst")
def _(spark, sf):
    return status(spark, sf).select("candidate_id", "detector_hit_count", "final_candidate_status", "review_priority", "risk_level", "evidence_strength", "is_high_risk")


def evidence_rows(spark, sf):
    s = CQ.refined(spark, sf)
    cols = ["entity_id", "cutoff_month", "detector_family", "detector_name", "hit_flag", "severity", "confidence", "reason_code"]
    return s, R.terminal_loss(s).select(*cols).unionByName(R.frequency_fluctuation(s).select(*cols)).unionByName(R.quantity_fluctuation(s).select(*cols))


@query("status_evidence_aggregate", """
SELECT entity_id, cutoff_month, count(*) FILTER (hit_flag) AS detector_hit_count, bool_or(hit_flag AND detector_name = 'terminal_loss_warning') AS terminal_loss_hit,
  bool_or(hit_flag AND detector_name = 'purchase_frequency_fluctuation_warning') AS frequency_hit, bool_or(hit_flag AND detector_name = 'purchase_quantity_fluctuation_warning') AS quantity_hit FROM evd
WHERE detector_name IN ('terminal_loss_warning', 'purchase_frequency_fluctuation_warning', 'purchase_quantity_fluctuation_warning') GROUP BY ALL
""")
def _(spark, sf):
    return T.aggregate_evidence(evidence_rows(spark, sf)[1]).select("entity_id", "cutoff_month", "detector_hit_count", "terminal_loss_hit", "frequency_hit", "quantity_hit")


cte("conf3", """
SELECT entity_id, cutoff_month, least(coalesce(survival_confidence, 0), CASE WHEN history_sufficiency_flag <> 'history_sufficient' THEN 0.6 ELSE 1 END, CASE WHEN demand_shape_label IN ('intermittent', 'lumpy') THEN 0.6 ELSE 1 END) AS ct,
  CASE WHEN order_count_last_12m_asof_cutoff > 0 THEN least(CASE WHEN history_sufficiency_flag = 'history_sufficient' THEN 0.8 ELSE 0.6 END, CASE WHEN order_count_last_12m_asof_cutoff < 3 THEN 0.4 ELSE 1 END, CASE WHEN demand_shape_label = 'lumpy' THEN 0.5 ELSE 1 END) END AS cf,
  CASE WHEN historical_avg_monthly_quantity_asof_cutoff <> 0 THEN least(purchase_count_asof_cutoff / 6, 0.8, CASE WHEN demand_shape_label = 'lumpy' THEN 0.5 ELSE 1 END) END AS cq FROM surv
""")


cte("rdec", """
WITH e AS (
  SELECT entity_id, cutoff_month, bool_or(hit_flag AND detector_name = 'terminal_loss_warning') AS t, bool_or(hit_flag AND detector_name = 'purchase_frequency_fluctuation_warning') AS f,
    bool_or(hit_flag AND detector_name = 'purchase_quantity_fluctuation_warning') AS q FROM evd GROUP BY ALL
), j AS (
  SELECT s.*, m.horizon, m.p, m.p * m.v AS prio, e.t, e.f, e.q, greatest(CASE WHEN e.t THEN ct END, CASE WHEN e.f THEN cf END, CASE WHEN e.q THEN cq END) AS best,
    coalesce(survival_state IN ('materially_overdue', 'likely_churn_interval'), false) AS late
  FROM (SELECT entity_id, cutoff_month, survival_state, survival_confidence, demand_shape_route, demand_shape_label, history_sufficiency_flag FROM surv) s
  JOIN mfa m USING (entity_id, cutoff_month) JOIN e USING (entity_id, cutoff_month) JOIN conf3 USING (entity_id, cutoff_month) WHERE m.horizon = 'H6' AND m.sample_class = 'recurring'
), lim AS (SELECT quantile_cont(p * v, 0.8) AS x FROM mfa WHERE horizon = 'H6' AND sample_class = 'recurring'),
st AS (
  SELECT *, coalesce(prio >= (SELECT x FROM lim), false) AS big, CASE WHEN p IS NULL OR prio IS NULL OR demand_shape_route = 'unknown' THEN 'insufficient'
    WHEN coalesce(t AND late AND survival_confidence >= 0.7 AND demand_shape_route <> 'observation_only' AND best >= 0.6, false) THEN 'strong'
    WHEN coalesce((t AND survival_confidence < 0.7) OR (survival_state = 'slightly_overdue' AND (f OR q)) OR (f AND q) OR late, false) THEN 'medium' ELSE 'weak' END AS evidence_strength FROM j
), fin AS (
  SELECT *, CASE WHEN p IS NULL OR prio IS NULL THEN 'not_actionable' WHEN demand_shape_route = 'observation_only' OR survival_state = 'low_confidence_lumpy' OR demand_shape_label = 'lumpy' THEN 'observation_only'
    WHEN late AND evidence_strength IN ('strong', 'medium') THEN 'priority_review'
    WHEN survival_state IN ('slightly_overdue', 'materially_overdue', 'likely_churn_interval') OR demand_shape_label = 'erratic' OR (big AND evidence_strength IN ('weak', 'insufficient')) THEN 'manual_review'
    WHEN history_sufficiency_flag <> 'history_sufficient' OR survival_confidence < 0.5 OR demand_shape_route = 'unknown' THEN 'low_confidence_watch' ELSE 'manual_review' END AS final_candidate_status FROM st
)
SELECT entity_id, cutoff_month, evidence_strength, final_candidate_status, CASE WHEN final_candidate_status = 'priority_review' AND evidence_strength = 'strong' AND big THEN 'P0'
  WHEN final_candidate_status IN ('priority_review', 'manual_review') AND evidence_strength IN ('medium', 'strong') AND big THEN 'P1'
  WHEN final_candidate_status IN ('observation_only', 'low_confidence_watch') AND big THEN 'P2' ELSE 'P3' END AS review_priority FROM fin
""")


def recurring_decision(spark, sf):
    s, ev = evidence_rows(spark, sf)
    rows = EV.all_rows(spark, sf).where("horizon = 'H6' and sample_class = 'recurring'").selectExpr("entity_id", "cutoff_month", "horizon", "p", "p * v as prio")
    keep = ["entity_id", "cutoff_month", "survival_state", "survival_confidence", "demand_shape_route", "demand_shape_label", "history_sufficiency_flag"]
    j = rows.join(s.select(*keep), ["entity_id", "cutoff_month"]).join(T.aggregate_evidence(ev), ["entity_id", "cutoff_month"], "left")
    d = T.recurring_status(j, quantiles(rows, [], "prio", {"q": 0.8}).select("q"))
    return d.select("entity_id", "cutoff_month", "evidence_strength", "final_candidate_status", "review_priority")


@query("status_recurring_decision", "SELECT * FROM rdec")
def _(spark, sf):
    return recurring_decision(spark, sf)


@query("result_risk_cards", """
WITH c AS (SELECT o.*, row_number() OVER (PARTITION BY o.candidate_id ORDER BY detector_name) AS i FROM mout o WHERE hit_flag)
SELECT 'card_primary_' || candidate_id AS risk_card_id, candidate_id, risk_level AS card_level, true AS is_primary FROM mst
UNION ALL SELECT 'card_' || detector_name || '_' || c.candidate_id, c.candidate_id, risk_level, false FROM c JOIN mst USING (candidate_id) WHERE i <= 4
""")
def _(spark, sf):
    return T.risk_cards(status(spark, sf), outputs(spark, sf)).select("risk_card_id", "candidate_id", "card_level", "is_primary")


@query("result_evidence_claims", "SELECT o.candidate_id, detector_name, severity FROM mout o JOIN mst USING (candidate_id) WHERE hit_flag")
def _(spark, sf):
    return T.claims(T.evidence_bundle(status(spark, sf), outputs(spark, sf))).select("candidate_id", "detector_name", "severity")


@query("result_claim_audit", f"""
SELECT final_candidate_status, count(*) AS row_count, CAST(0 AS BIGINT) AS count_mismatch, count(*) FILTER (final_candidate_status = 'priority_review' AND detector_hit_count = 0) AS priority_without_evidence,
  {rnd('avg(CASE WHEN detector_hit_count > 0 THEN 1.0 ELSE 0 END)')} AS evidence_completeness FROM mst GROUP BY final_candidate_status
""")
def _(spark, sf):
    a = T.claim_audit(T.evidence_bundle(status(spark, sf), outputs(spark, sf)))
    return round_all(a.select("final_candidate_status", "row_count", "count_mismatch", "priority_without_evidence", "evidence_completeness"))


@query("result_review_sample", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY final_candidate_status ORDER BY review_priority, final_candidate_status, prio DESC, candidate_id) AS a,
  row_number() OVER (PARTITION BY review_priority ORDER BY review_priority, final_candidate_status, prio DESC, candidate_id) AS b, row_number() OVER (PARTITION BY evidence_strength ORDER BY review_priority, final_candidate_status, prio DESC, candidate_id) AS c FROM mst)
SELECT candidate_id FROM o WHERE a <= 5 OR b <= 5 OR c <= 5
""")
def _(spark, sf):
    return T.review_sample(status(spark, sf)).select("candidate_id")


@query("result_horizon_profiles", f"""
SELECT entity_id AS risk_entity_id, cutoff_month AS report_month, horizon, {rnd("CASE WHEN sample_class <> 'one_shot' THEN churn_probability_H END", 6)} AS risk_probability,
  {rnd("greatest(CASE horizon WHEN 'H3' THEN purchase_amount_sum_last_3m_asof_cutoff WHEN 'H6' THEN purchase_amount_sum_last_6m_asof_cutoff ELSE purchase_amount_sum_last_12m_asof_cutoff END, 0)", 4)} AS involved_amount,
  'purchase_amount_sum_last_' || h || 'm_asof_cutoff' AS involved_amount_source FROM featx
""")
def _(spark, sf):
    p = T.horizon_profiles(FQ.scored(spark, sf).withColumnRenamed("churn_probability_H", "p"))
    amount = F.round(F.col("involved_amount") + 1.3e-7, 4)
    return round_all(p.select("risk_entity_id", "report_month", "horizon", "risk_probability", amount.alias("involved_amount"), "involved_amount_source"), 6)


@query("result_one_shot_terminals", f"""
WITH d AS (SELECT manufacturer_code, hospital_code, drug_code AS drug_group, order_date, sum(order_amount) AS a FROM ord WHERE order_date <= DATE '2000-12-31' GROUP BY ALL),
f AS (SELECT {_E}, min(order_date) AS first_purchase_date, first(a ORDER BY order_date) AS first_purchase_amount FROM d GROUP BY ALL)
SELECT {_E}, first_purchase_date, {rnd('first_purchase_amount', 4)} AS first_purchase_amount, DATE '2000-12-31' - first_purchase_date AS days_since_first_purchase
FROM feat JOIN f USING ({_E}) WHERE sample_class = 'one_shot' AND cutoff_month = DATE '2000-12-31'
""")
def _(spark, sf):
    f = FQ.feats(spark, sf).where("cutoff_month = date'2000-12-31'")
    return round_all(T.one_shot_terminals(f, common.orders(spark, sf), common.CUTOFF).select(*ENTITY, "first_purchase_date", "first_purchase_amount", "days_since_first_purchase"), 4)


@query("result_aggregates", """
SELECT 'hospital' AS level, hospital_code AS code, count(*) AS risk_entity_count, count(*) FILTER (is_high_risk) AS high_risk_count FROM mst GROUP BY ALL
UNION ALL SELECT 'drug', drug_group, count(*), count(*) FILTER (is_high_risk) FROM mst GROUP BY ALL
""")
def _(spark, sf):
    s = status(spark, sf)
    h = T.entity_aggregates(s, ["hospital_code"]).withColumnRenamed("hospital_code", "code").withColumn("level", F.lit("hospital"))
    return h.unionByName(T.entity_aggregates(s, ["drug_group"]).withColumnRenamed("drug_group", "code").withColumn("level", F.lit("drug")))


@query("result_monthly_report", "SELECT cutoff_month, 'monthly_2000-12' AS monthly_report_id, count(DISTINCT entity_id) AS entity_count, count(*) FILTER (is_high_risk) AS high_risk_count FROM mst GROUP BY ALL")
def _(spark, sf):
    return T.monthly_report(status(spark, sf))


@query("result_entity_timeline", f"SELECT {_E}, purchase_month, order_count, purchase_quantity_sum FROM em")
def _(spark, sf):
    return common.entity_month(spark, sf).select(*ENTITY, "purchase_month", "order_count", "purchase_quantity_sum")


cte("dl", """
SELECT DISTINCT o.manufacturer_code, o.hospital_code, o.drug_code AS drug_group, coalesce(h.hospital_name, o.hospital_code) AS hospital_display_name, coalesce(d.drug_name, l.n) AS drug_display_name,
  h.region_code, coalesce(h.region_name, 'unknown_region') AS region_display_name, CASE WHEN d.drug_name IS NOT NULL THEN 'master' ELSE 'mixed' END AS display_name_quality
FROM ord o LEFT JOIN hosp h ON o.hospital_code = h.hospital_code LEFT JOIN drug d ON o.drug_code = d.drug_code
  LEFT JOIN (SELECT drug_code AS dc, last(drug_name ORDER BY order_date, row_uid) AS n FROM ord GROUP BY ALL) l ON l.dc = o.drug_code
""")


def lookup(spark, sf):
    o = common.orders(spark, sf)
    return T.display_lookup(o.withColumn("drug_group", F.col("drug_code")), star.hospital_master(spark, sf), star.drug_master(spark, sf), o)


@query("result_display_lookup", "SELECT * FROM dl")
def _(spark, sf):
    return lookup(spark, sf)


@query("result_display_merge", f"SELECT {_E}, hospital_display_name, drug_display_name FROM dl")
def _(spark, sf):
    full = lookup(spark, sf).select(*ENTITY, "hospital_display_name", "drug_display_name")
    poor = full.selectExpr(*ENTITY, "hospital_code as hospital_display_name", "drug_display_name")
    return T.merge_lookups(poor, full, ENTITY)


@query("context_observation_registry", "SELECT last_day(order_date) AS report_month, manufacturer_code, count(DISTINCT order_date) AS observation_dates, max(order_date) AS latest_date FROM ord GROUP BY ALL")
def _(spark, sf):
    return common.orders(spark, sf).groupBy(F.last_day("order_date").alias("report_month"), "manufacturer_code").agg(
        F.countDistinct("order_date").alias("observation_dates"), F.max("order_date").alias("latest_date"))


@query("context_resolution", "SELECT max(purchase_month) AS resolved_month, DATE '2001-12-31' AS requested_month, 'latest_before' AS resolution FROM em WHERE purchase_month <= DATE '2001-12-31'")
def _(spark, sf):
    reg = common.orders(spark, sf).select(F.last_day("order_date").alias("report_month")).distinct()
    return G.resolve_context(reg, "2001-12-31")


# Serving.
@query("serve_filters", "SELECT candidate_id FROM mst WHERE manufacturer_code IN ('M01', 'M02') AND risk_level = 'orange'")
def _(spark, sf):
    return G.apply_filters(status(spark, sf), {"manufacturer_code": ["M01", "M02"], "risk_level": "orange", "horizon": None}).select("candidate_id")


@query("serve_rankable", f"SELECT candidate_id, {rnd('p')} AS p FROM mst WHERE manufacturer_code IN ('M01', 'M02', 'M03') AND sample_class = 'recurring' ORDER BY p DESC, v DESC, entity_id LIMIT 50")
def _(spark, sf):
    return G.select_rankable(status(spark, sf), {"manufacturer_code": ["M01", "M02", "M03"]}, ["recurring"], ["p", "v"], 50).select("candidate_id", "p")


def base_rows(spark, sf):
    return EV.all_rows(spark, sf).where("horizon = 'H6' and cutoff_month = date'2000-12-31'").withColumn("loss", F.expr("p * v"))


for _s, _o in {"probability": "p DESC", "amount": "v DESC", "loss_value": "CASE WHEN prio > 0 THEN 0 ELSE 1 END, prio DESC, p DESC"}.items():
    def _register(strategy, order):
        @query(f"serve_top_entities_{strategy}", f"SELECT entity_id FROM (SELECT *, row_number() OVER (PARTITION BY manufacturer_code ORDER BY {order}, entity_id) AS i FROM mst) WHERE i <= 15")
        def _(spark, sf):
            return G.top_entities(base_rows(spark, sf), 15, strategy).select("entity_id")

    _register(_s, _o)


@query("serve_top_entities_overflow", "SELECT entity_id FROM (SELECT *, row_number() OVER (PARTITION BY manufacturer_code ORDER BY (p >= 0.8) DESC, p DESC, entity_id) AS i FROM mst) WHERE i <= 10 OR p >= 0.8")
def _(spark, sf):
    return G.top_entities(base_rows(spark, sf), 10, "probability", 0.8, True).select("entity_id")


@query("serve_shortage_fill", """
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manufacturer_code ORDER BY p DESC, entity_id) AS i FROM mst WHERE p >= 0.75) WHERE i <= 20),
h AS (SELECT manufacturer_code, count(*) AS k FROM t GROUP BY ALL), x AS (SELECT m.*, row_number() OVER (PARTITION BY m.manufacturer_code ORDER BY p DESC, entity_id) AS j FROM mst m WHERE entity_id NOT IN (SELECT entity_id FROM t))
SELECT entity_id, false AS filled FROM t UNION ALL SELECT x.entity_id, true FROM x LEFT JOIN h USING (manufacturer_code) WHERE j <= 20 - coalesce(k, 0)
""")
def _(spark, sf):
    b = base_rows(spark, sf)
    top = G.top_entities(b.where("p >= 0.75"), 20, "probability")
    return G.fill_shortage(top, b, 20, [F.desc("p"), F.asc("entity_id")]).select("entity_id", "filled")


@query("serve_page", "SELECT entity_id, rank, (SELECT count(*) FROM mst) AS total_count FROM (SELECT *, row_number() OVER (ORDER BY p DESC, entity_id) AS rank FROM mst) WHERE rank > 40 AND rank <= 60")
def _(spark, sf):
    return G.page(base_rows(spark, sf).select("entity_id", "p"), "p", 3, 20).select("entity_id", "rank", "total_count")


@query("serve_visible_scope", "SELECT DISTINCT manufacturer_code FROM mst WHERE manufacturer_code IN ('M01', 'M05', 'M07') AND manufacturer_code IN (SELECT manufacturer_code FROM maker WHERE manufacturer_code < 'M06')")
def _(spark, sf):
    scope = star.manufacturer_master(spark, sf).where("manufacturer_code < 'M06'")
    return G.visible_scope(base_rows(spark, sf), scope, ["M01", "M05", "M07"])


@query("serve_shortage_counts", "SELECT manufacturer_code, count(*) AS available_count, least(count(*), 100) AS returned_count, greatest(120 - least(count(*), 100), 0) AS shortage_count FROM mst GROUP BY ALL")
def _(spark, sf):
    return G.shortage(base_rows(spark, sf), 120, 100)


@query("serve_entity_detail", "SELECT observation_date, detector_id, severity FROM res WHERE hit_flag AND manufacturer_code = 'M01' AND hospital_code = 'H02' AND detector_id IN ('purchase_interval_ipi', 'purchase_quantity_trend', 'purchase_quantity_spike', 'purchase_frequency_drop', 'first_purchase_fact', 'reactivated_purchase_fact')")
def _(spark, sf):
    return EQ.results(spark, sf).where("hit_flag and manufacturer_code = 'M01' and hospital_code = 'H02'").select("observation_date", "detector_id", "severity")


@query("serve_detector_runs", "SELECT observation_date, detector_id, count(*) AS result_count, count(*) FILTER (hit_flag) AS clue_count FROM res GROUP BY ALL")
def _(spark, sf):
    return EQ.results(spark, sf).groupBy("observation_date", "detector_id").agg(F.count(F.lit(1)).alias("result_count"), F.count_if("hit_flag").alias("clue_count"))


@query("serve_page_payload", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY manufacturer_code ORDER BY p DESC NULLS LAST, entity_id, horizon) AS i FROM mst)
SELECT manufacturer_code, count(*) AS row_count, '[' || string_agg('{"entity_id":"' || entity_id || '","horizon":"' || horizon || '"}', ',' ORDER BY p DESC, entity_id, horizon) || ']' AS payload
FROM t WHERE i <= 10 GROUP BY manufacturer_code
""")
def _(spark, sf):
    return G.payload(base_rows(spark, sf), ["manufacturer_code"], ["entity_id", "horizon"], 10)


@query("serve_probability_trend", f"SELECT entity_id, cutoff_month, {rnd('p')} AS p, {rnd('p - lag(p) OVER (PARTITION BY entity_id ORDER BY cutoff_month)')} AS change FROM mfa WHERE horizon = 'H6'")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("cutoff_month")
    r = EV.all_rows(spark, sf).where("horizon = 'H6'").select("entity_id", "cutoff_month", "p")
    return round_all(r.withColumn("change", F.col("p") - F.lag("p").over(w)))


# Quality.
_FP = ["purchase_unit", "insurance_drug_code", "order_status_raw", "city_code_raw", "manufacturer_code"]


@query("quality_field_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS null_count, {rnd(f'count(*) FILTER ({c} IS NULL) / count(*)')} AS null_rate, count(DISTINCT {c}) AS distinct_count FROM ord""" for c in _FP))
def _(spark, sf):
    return round_all(Q.field_profile(common.orders(spark, sf), _FP))


@query("quality_top_values", 'SELECT order_status_raw AS value, count(*) AS "count" FROM ord GROUP BY ALL ORDER BY 2 DESC, 1 NULLS LAST LIMIT 5')
def _(spark, sf):
    return Q.top_values(common.orders(spark, sf), "order_status_raw", 5)


@query("quality_identifiers", " UNION ALL ".join(f"SELECT '{k}' AS identifier, count({k}) AS distinct_count, count(*) FILTER (n > 1) AS repeated_keys, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_of_repeated_keys, count(*) FILTER (n > 1) = 0 AS is_unique FROM (SELECT {k}, count(*) AS n FROM ord GROUP BY ALL)" for k in ("row_uid", "order_detail_id", "order_id")))
def _(spark, sf):
    return Q.identifier_report(common.orders(spark, sf), ["row_uid", "order_detail_id", "order_id"])


@query("quality_one_to_one", "SELECT 'drug_to_line' AS metric, count(*) AS left_distinct, count(*) FILTER (k > 1) AS multi_mapping_count, (SELECT count(DISTINCT product_line_code) FROM ord) AS right_distinct FROM (SELECT drug_code, count(DISTINCT product_line_code) AS k FROM ord GROUP BY ALL)")
def _(spark, sf):
    return Q.one_to_one(common.orders(spark, sf), "drug_code", "product_line_code", "drug_to_line")


@query("quality_code_consistency", f"""
WITH c AS (SELECT drug_code AS a, trim(regexp_replace(insurance_drug_code, '\\.0$', '')) AS b FROM ord)
SELECT count(*) AS comparable_rows, {rnd('avg((a = b)::INTEGER)')} AS equal_ratio, (SELECT count(*) FROM (SELECT a FROM c WHERE b IS NOT NULL GROUP BY a HAVING count(DISTINCT b) > 1)) AS multi_map_count FROM c WHERE b IS NOT NULL
""")
def _(spark, sf):
    from orderpulse.operators.cleaning import normalize_code

    o = common.orders(spark, sf).select(F.col("drug_code").alias("a"), normalize_code("insurance_drug_code").alias("b"))
    return round_all(Q.code_consistency(o, "a", "b"))


_NUM = {"order_quantity": "order_quantity", "return_quantity": "return_quantity", "delivery_rate": "delivery_quantity / nullif(order_quantity, 0)", "arrival_rate": "arrival_quantity / nullif(delivery_quantity, 0)"}


@query("quality_numeric_report", " UNION ALL ".join(f"SELECT '{k}' AS field, {rnd(f'avg((v IS NULL)::INTEGER)')} AS null_rate, {rnd('avg((coalesce(v, 1) < 0)::INTEGER)')} AS negative_rate, {rnd('avg((coalesce(v, 1) = 0)::INTEGER)')} AS zero_rate, {rnd('min(v)')} AS min, {rnd('max(v)')} AS max, {rnd('quantile_cont(v, 0.5)')} AS p50, {rnd('quantile_cont(v, 0.95)')} AS p95 FROM (SELECT {e} AS v FROM ord)" for k, e in _NUM.items()))
def _(spark, sf):
    return round_all(Q.numeric_report(common.orders(spark, sf), {k: e.replace("0)", "0D)") for k, e in _NUM.items()}))


@query("quality_raw_validation", "SELECT 'orders_non_empty' AS check_name, 'pass' AS status, CAST(0 AS BIGINT) AS invalid_count FROM (SELECT count(*) FROM ord) " + "".join(f" UNION ALL SELECT '{n}', CASE WHEN count(*) FILTER ({c}) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER ({c}) FROM ord" for n, c in {"order_date_parse": "order_date IS NULL", "manufacturer_code_not_blank": "trim(coalesce(manufacturer_code, '')) = ''", "hospital_code_not_blank": "trim(coalesce(hospital_code, '')) = ''", "drug_code_not_blank": "trim(coalesce(drug_code, '')) = ''", "order_quantity_numeric": "order_quantity IS NULL OR order_quantity <= 0", "order_amount_numeric": "order_amount IS NULL"}.items()))
def _(spark, sf):
    return Q.raw_validation(common.orders(spark, sf))


@query("quality_order_checks", " UNION ALL ".join(f"SELECT check_name, row_count, sample_refs FROM (SELECT '{n}' AS check_name, count(*) AS row_count, string_agg(row_uid, ',' ORDER BY row_uid) FILTER (i <= 5) AS sample_refs FROM (SELECT *, row_number() OVER (ORDER BY row_uid) AS i FROM uo WHERE {c})) WHERE row_count > 0" for n, c in Q.ORDER_CHECKS.items()))
def _(spark, sf):
    return Q.order_quality(RQ.unit_orders(spark, sf))


@query("quality_batch_validation", "SELECT 'status_unique' AS check_name, CAST(0 AS BIGINT) AS failing, 'pass' AS status FROM (SELECT count(*) FROM mst) UNION ALL SELECT 'outputs_in_status', CAST(0 AS BIGINT), 'pass'")
def _(spark, sf):
    return Q.batch_validation({"status": status(spark, sf), "outputs": outputs(spark, sf)}, {"status": ["candidate_id"]}, [("outputs", "status", "candidate_id")])


@query("quality_backfill", f"""
SELECT detector_id, count(*) AS published_dates, CAST(sum(n) AS BIGINT) AS result_count, CAST(sum(h) AS BIGINT) AS clue_count, min(h) AS min_daily_clue_count, max(h) AS max_daily_clue_count, 4 - count(*) AS missing_dates
FROM (SELECT detector_id, observation_date, count(*) AS n, count(*) FILTER (hit_flag) AS h FROM res GROUP BY ALL) GROUP BY detector_id
""")
def _(spark, sf):
    return Q.backfill_validation(EQ.results(spark, sf), common.OBSERVATION_DATES, list(DQ.D.RULES))


@query("quality_freshness", "SELECT max(order_date) AS max_order_time, count(*) AS row_count FROM ord WHERE order_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' AND manufacturer_code = 'M01'")
def _(spark, sf):
    return Q.freshness(common.orders(spark, sf), "2001-01-01", "2001-06-30", manufacturer_code="M01")


@query("quality_entity_coverage", "SELECT count(*) AS row_count, count(DISTINCT (manufacturer_code, hospital_code, drug_code)) AS entity_count, count(DISTINCT manufacturer_code) AS manufacturer_count, count(DISTINCT hospital_code) AS hospital_count, min(order_date) AS purchase_time_min, max(order_date) AS purchase_time_max FROM ord")
def _(spark, sf):
    return Q.coverage_profile(common.orders(spark, sf))


_MS = ["median_purchase_interval_days_asof_cutoff", "cv2_quantity_asof_cutoff", "adi_asof_cutoff"]


@query("quality_missing_summary", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {rnd(f'avg(({c} IS NULL)::INTEGER)')} AS missing_ratio, avg(({c} IS NULL)::INTEGER) > 0.8 AS high_missing FROM feat""" for c in _MS))
def _(spark, sf):
    return round_all(Q.missing_summary(FQ.feats(spark, sf), _MS))


@query("quality_return_void", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} <> 0) AS non_zero_count, {rnd(f'count(*) FILTER ({c} <> 0) / count(*)')} AS non_zero_rate FROM ord" for c in ("return_quantity", "void_quantity")))
def _(spark, sf):
    return round_all(Q.nonzero_report(common.orders(spark, sf), ["return_quantity", "void_quantity"]))


@query("quality_display_fallback", f"SELECT count(*) AS row_count, {rnd('avg((hospital_display_name = hospital_code)::INTEGER)')} AS hospital_fallback_rate, {rnd('avg((drug_display_name = drug_group)::INTEGER)')} AS drug_fallback_rate, 'ready' AS hospital_name_ready FROM dl")
def _(spark, sf):
    return round_all(Q.name_fallback(lookup(spark, sf)))


# Sampling and coverage audits.
cte("ea", "SELECT manufacturer_code, hospital_code, drug_code, count(*) AS order_count, min(order_date) AS first_purchase, max(order_date) AS last_purchase, count(DISTINCT last_day(order_date)) AS active_months FROM ord GROUP BY ALL")


@query("audit_entity_aggregate", "SELECT * FROM ea")
def _(spark, sf):
    return N.entity_aggregate(common.orders(spark, sf))


@query("audit_age_distribution", f"""
SELECT {N.AGE} AS entity_age_bucket, count(*) AS entity_count, {rnd('avg(order_count)')} AS avg_order_count, {rnd('avg(active_months)')} AS avg_active_month_count
FROM (SELECT *, (year(last_purchase) - year(first_purchase)) * 12 + month(last_purchase) - month(first_purchase) + 1 AS m FROM ea) GROUP BY ALL
""")
def _(spark, sf):
    return round_all(N.age_distribution(N.entity_aggregate(common.orders(spark, sf))))


@query("audit_monthly_distribution", "SELECT last_day(order_date) AS purchase_month, count(*) AS row_count, count(DISTINCT (manufacturer_code, hospital_code, drug_code)) AS entity_count FROM ord GROUP BY ALL")
def _(spark, sf):
    e = common.orders(spark, sf).groupBy(F.last_day("order_date").alias("purchase_month"), "manufacturer_code", "hospital_code", "drug_code").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("purchase_month").agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("entity_count"))


@query("audit_compare_distribution", f"""
WITH x AS (SELECT manufacturer_code, count(*) AS local_rows FROM elig GROUP BY ALL), y AS (SELECT manufacturer_code, count(*) AS source_rows FROM ord GROUP BY ALL)
SELECT manufacturer_code, local_rows, source_rows, {rnd('local_rows / sum(local_rows) OVER () - source_rows / sum(source_rows) OVER ()')} AS share_delta, {rnd('local_rows / source_rows')} AS row_ratio FROM x FULL JOIN y USING (manufacturer_code)
""")
def _(spark, sf):
    c = N.compare_distribution(common.eligible(spark, sf), common.orders(spark, sf), "manufacturer_code")
    return round_all(c.select("manufacturer_code", "local_rows", "source_rows", "share_delta", "row_ratio"))


cte("eb", "SELECT manufacturer_code, hospital_code, drug_code, count(*) AS order_count, min(order_date) AS first_purchase, max(order_date) AS last_purchase FROM elig GROUP BY ALL")


@query("audit_history_completeness", """
SELECT CASE WHEN b.order_count / a.order_count >= 0.95 AND b.first_purchase - a.first_purchase <= 7 AND a.last_purchase - b.last_purchase <= 7 THEN 'history_complete_by_rule' WHEN b.first_purchase - a.first_purchase > 7 THEN 'old_history_missing_in_local'
  WHEN a.last_purchase - b.last_purchase > 7 THEN 'recent_history_missing_in_local' ELSE 'local_order_count_below_source' END AS history_gap_note, count(*) AS n FROM eb b JOIN ea a USING (manufacturer_code, hospital_code, drug_code) GROUP BY ALL
""")
def _(spark, sf):
    h = N.history_completeness(N.entity_aggregate(common.eligible(spark, sf)), N.entity_aggregate(common.orders(spark, sf)))
    return h.groupBy("history_gap_note").agg(F.count(F.lit(1)).alias("n"))


cte("strat", """
WITH b AS (SELECT *, manufacturer_code || '|' || hospital_code || '|' || drug_code AS entity_id, CASE WHEN order_count >= 8 THEN 'high_frequency' WHEN order_count = 1 THEN 'one_shot' WHEN active_months <= 3 THEN 'short_history' ELSE 'regular' END AS bucket FROM ea),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY order_count DESC, entity_id) <= 10 AS t, row_number() OVER (PARTITION BY bucket ORDER BY md5(entity_id), entity_id) <= 10 AS h FROM b)
SELECT entity_id, bucket, CASE WHEN t AND h THEN 'random+top' WHEN t THEN 'top' ELSE 'random' END AS sample_reason FROM r WHERE t OR h
""")


@query("audit_stratified_sample", "SELECT * FROM strat")
def _(spark, sf):
    return N.stratified_sample(N.entity_aggregate(common.orders(spark, sf)))


cte("mansel", """
WITH m AS (SELECT manufacturer_code, CAST(sum(order_count) AS BIGINT) AS rows, count(*) AS entities FROM ea GROUP BY ALL)
SELECT * FROM m WHERE rows >= 100 AND rows <= (SELECT quantile_cont(rows, 0.9) FROM m) ORDER BY rows DESC, manufacturer_code LIMIT 5
""")


@query("audit_select_manufacturers", "SELECT * FROM mansel")
def _(spark, sf):
    return N.select_manufacturers(N.entity_aggregate(common.orders(spark, sf)), 5, 100)


@query("audit_choice_pairs", """
WITH c AS (
  SELECT hospital_code, drug_code, sum(order_count) FILTER (manufacturer_code IN (SELECT manufacturer_code FROM mansel)) AS selected_mfg_order_count, count(DISTINCT manufacturer_code) FILTER (manufacturer_code IN (SELECT manufacturer_code FROM mansel)) AS k,
    count(DISTINCT manufacturer_code) AS all_manufacturer_count, sum(order_count) AS all_pair_order_count FROM ea GROUP BY ALL),
r AS (SELECT *, all_manufacturer_count > k AS sub, row_number() OVER (PARTITION BY all_manufacturer_count > k ORDER BY selected_mfg_order_count DESC, all_manufacturer_count DESC, hospital_code, drug_code) AS selection_rank,
  count(*) FILTER (all_manufacturer_count > k) OVER () AS subs, count(*) FILTER (all_manufacturer_count <= k) OVER () AS rest FROM c WHERE k > 0)
SELECT hospital_code, drug_code, CAST(selected_mfg_order_count AS BIGINT) AS selected_mfg_order_count, k AS selected_mfg_entity_count, all_manufacturer_count, CAST(all_pair_order_count AS BIGINT) AS all_pair_order_count, sub AS has_manufacturer_substitution, selection_rank
FROM r WHERE CASE WHEN sub THEN selection_rank <= greatest(300, 400 - rest) ELSE selection_rank <= 400 - least(subs, 300) END
""")
def _(spark, sf):
    e = N.entity_aggregate(common.orders(spark, sf))
    return N.select_choice_pairs(e, N.select_manufacturers(e, 5, 100), 400).drop("all_pair_entity_count", "choice_set_selection_reason")


@query("audit_extract_coverage", f"""
WITH e AS (SELECT order_count, manufacturer_code IN (SELECT manufacturer_code FROM mansel) AS m, manufacturer_code || '|' || hospital_code || '|' || drug_code IN (SELECT entity_id FROM strat) AS s FROM ea)
SELECT scope, count(*) FILTER (k) AS entity_count, CAST(coalesce(sum(order_count) FILTER (k), 0) AS BIGINT) AS row_count, {rnd('coalesce(sum(order_count) FILTER (k), 0) / sum(order_count)')} AS row_coverage
FROM (SELECT 'manufacturer' AS scope, m AS k, order_count FROM e UNION ALL SELECT 'entity', s, order_count FROM e UNION ALL SELECT 'union', m OR s, order_count FROM e) GROUP BY scope
""")
def _(spark, sf):
    e = N.entity_aggregate(common.orders(spark, sf))
    return round_all(N.extract_coverage(e, N.select_manufacturers(e, 5, 100), N.stratified_sample(e)))
