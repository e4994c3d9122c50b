"""Research rules, baselines, priors and P(alive) queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import candidates as CQ
from orderpulse.catalog import common
from orderpulse.catalog import evaluation as EV
from orderpulse.catalog import features as FQ
from orderpulse.catalog import rules as RQ
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.catalog.features import pr
from orderpulse.functions.exprs import round_all
from orderpulse.operators import features as A
from orderpulse.operators import models as M
from orderpulse.operators import research_rules as R
from orderpulse.schemas import ENTITY

_E = "manufacturer_code, hospital_code, drug_group"
KEY = ["entity_id", "cutoff_month"]


@query("rule_monthly_runtime", " UNION ALL ".join(
    f"""SELECT candidate_id, cutoff_month, '{d}' AS detector_name, ({m}) {c} AS hit_flag, CASE WHEN ({m}) {c} THEN '{s1}' ELSE '{s0}' END AS severity, {rnd(f'CAST({m} AS DOUBLE)')} AS metric_value FROM featx WHERE {scope}"""
    for d, _f, m, c, s1, s0, _c, scope in R.MONTHLY_RULES).replace("0D", "0"))
def _(spark, sf):
    return round_all(R.monthly_rules(FQ.scored(spark, sf)).select("candidate_id", "cutoff_month", "detector_name", "hit_flag", "severity", "metric_value"))


_ST = "survival_state IN ('materially_overdue', 'likely_churn_interval')"
_FL = "CASE survival_state WHEN 'likely_churn_interval' THEN greatest(least(coalesce(overdue_ratio, 0) / 3 * 100, 100), 80) WHEN 'materially_overdue' THEN greatest(least(coalesce(overdue_ratio, 0) / 3 * 100, 100), 60) ELSE least(coalesce(overdue_ratio, 0) / 3 * 100, 100) END"
_CO = "least(coalesce(survival_confidence, 0), CASE WHEN history_sufficiency_flag <> 'history_sufficient' THEN 0.6 ELSE 1 END, CASE WHEN demand_shape_label IN ('intermittent', 'lumpy') THEN 0.6 ELSE 1 END)"


@query("rule_terminal_loss", f"""
SELECT entity_id, cutoff_month, {_ST} AND demand_shape_route <> 'observation_only' AS hit_flag, {rnd(f"CASE WHEN {_ST} AND demand_shape_route <> 'observation_only' THEN {_FL} ELSE 0 END", 6)} AS severity, {rnd(f'({_CO})::DOUBLE', 6)} AS confidence,
  CASE WHEN demand_shape_route = 'observation_only' THEN 'observation_only_guardrail' WHEN {_ST} THEN survival_state ELSE 'not_overdue_enough' END AS reason_code FROM surv
""")
def _(spark, sf):
    return round_all(R.terminal_loss(CQ.refined(spark, sf)).select(*KEY, "hit_flag", "severity", "confidence", "reason_code"), 6)


cte("d36", "SELECT *, (order_count_last_3m_asof_cutoff / 3) / nullif(order_count_last_12m_asof_cutoff / 12, 0) AS d3, (order_count_last_6m_asof_cutoff / 6) / nullif(order_count_last_12m_asof_cutoff / 12, 0) AS d6 FROM surv")


@query("rule_frequency_fluctuation", f"""
SELECT entity_id, cutoff_month, coalesce(d3 < 0.5 OR d6 < 0.6, false) AS hit_flag, {rnd('CASE WHEN coalesce(d3 < 0.5 OR d6 < 0.6, false) THEN greatest(least(greatest((0.5 - d3) / 0.5 * 100, 0), 100), least(greatest((0.6 - d6) / 0.6 * 100, 0), 100)) ELSE 0 END', 6)} AS severity,
  CASE WHEN d3 IS NULL AND d6 IS NULL THEN 'frequency_fields_missing' WHEN d3 < 0.5 AND d6 < 0.6 THEN 'frequency_drop_multi_window' WHEN d3 < 0.5 THEN 'frequency_drop_3m' WHEN d6 < 0.6 THEN 'frequency_drop_6m' ELSE 'no_frequency_drop' END AS reason_code FROM d36
""")
def _(spark, sf):
    return round_all(R.frequency_fluctuation(CQ.refined(spark, sf)).select(*KEY, "hit_flag", "severity", "reason_code"), 6)


cte("qr", "SELECT *, (purchase_quantity_sum_last_3m_asof_cutoff / 3) / nullif(historical_avg_monthly_quantity_asof_cutoff, 0) AS r FROM surv")


@query("rule_quantity_fluctuation", f"""
SELECT entity_id, cutoff_month, coalesce(r < 0.5 OR r > 3, false) AS hit_flag, {rnd('CASE WHEN r < 0.5 THEN least(greatest((0.5 - r) / 0.5 * 100, 0), 100) WHEN r > 3 THEN least((r - 3) / 3 * 100, 100) ELSE 0 END', 6)} AS severity,
  CASE WHEN r IS NULL THEN 'quantity_fields_missing' WHEN r < 0.5 THEN 'quantity_drop' WHEN r > 3 THEN 'quantity_spike' ELSE 'no_quantity_fluctuation' END AS reason_code FROM qr
""")
def _(spark, sf):
    return round_all(R.quantity_fluctuation(CQ.refined(spark, sf)).select(*KEY, "hit_flag", "severity", "reason_code"), 6)


@query("rule_one_shot_new_terminal", "SELECT entity_id, cutoff_month, true AS hit_flag, 'first_seen' AS reason_code FROM feat WHERE sample_class = 'one_shot'")
def _(spark, sf):
    return R.one_shot_new_terminal(CQ.entity_features(spark, sf)).select(*KEY, "hit_flag", "reason_code")


cte("iz", f"""
SELECT *, CASE WHEN purchase_interval_mad_days_asof_cutoff > 0 THEN (months_since_last_purchase_asof_cutoff * 30.4375 - median_purchase_interval_days_asof_cutoff) / purchase_interval_mad_days_asof_cutoff END AS z,
  (coalesce(overdue_ratio >= 2, false) OR {_ST}) AND demand_shape_route <> 'observation_only' AS h FROM surv
""")
# The tail by Simpson's rule over ten deviations in 1,000 steps.
_STEPS = "(SELECT sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(0 - (abs(z) + i / 100) ** 2 / 2)) * 0.01 / 3 / sqrt(2 * pi()) FROM range(0, 1001) t(i))"


@query("rule_interval_overdue_p_value", f"""
SELECT entity_id, cutoff_month, h AS hit_flag, {rnd('z', 6)} AS robust_z FROM iz
""")
def _(spark, sf):
    return round_all(R.interval_overdue_test(CQ.refined(spark, sf)).select(*KEY, "hit_flag", "robust_z"), 6)


@query("rule_interval_tail_probability", f"""
WITH d AS (SELECT DISTINCT z FROM iz WHERE z IS NOT NULL), t AS (SELECT z, {_STEPS} AS u FROM d)
SELECT entity_id, cutoff_month, {rnd('iz.z', 6)} AS robust_z, {rnd('CASE WHEN iz.z >= 0 THEN u ELSE 1 - u END', 6)} AS p_value FROM iz JOIN t ON iz.z = t.z
""")
def _(spark, sf):
    return round_all(R.interval_overdue_test(CQ.refined(spark, sf)).where("p_value is not null").select(*KEY, "robust_z", "p_value"), 6)


# The binomial tail by explicit terms: counts per twelve months are small here.
def _cdf(k, p):
    return f"CASE WHEN o12 <= 0 THEN NULL WHEN {k} >= o12 THEN 1 ELSE (SELECT sum(exp(lgamma(o12 + 1) - lgamma(i + 1) - lgamma(o12 - i + 1) + i * ln({p}) + (o12 - i) * ln(1 - {p}))) FROM range(0, o12 + 1) t(i) WHERE i <= {k}) END"


cte("rd", f"""
SELECT *, {_cdf('o3', '0.25::DOUBLE')} AS p3, {_cdf('o6', '0.5::DOUBLE')} AS p6, (o3 / 3) / greatest((o12 - o3) / 9, 1e-9) AS r3, (o6 / 6) / greatest((o12 - o6) / 6, 1e-9) AS r6
FROM (SELECT entity_id, cutoff_month, CAST(order_count_last_3m_asof_cutoff AS BIGINT) AS o3, CAST(order_count_last_6m_asof_cutoff AS BIGINT) AS o6, CAST(order_count_last_12m_asof_cutoff AS BIGINT) AS o12 FROM feat)
""")
cte("rdh", "SELECT *, coalesce(r3 < 0.6 AND p3 <= 0.10 AND o12 - o3 >= 3, false) AS h3, coalesce(r6 < 0.7 AND p6 <= 0.10 AND o12 - o6 >= 3, false) AS h6 FROM rd")


@query("rule_rate_drop_test", f"""
SELECT entity_id, cutoff_month, h3 OR h6 AS hit_flag, {rnd('least(p3, p6)', 6)} AS p_value, CASE WHEN h3 AND h6 THEN 'frequency_drop_multi_window' WHEN h3 THEN 'frequency_drop_3m_vs_previous_9m' WHEN h6 THEN 'frequency_drop_6m_vs_previous_6m'
  WHEN r3 < 0.6 OR r6 < 0.7 THEN 'frequency_drop_not_statistically_supported' ELSE 'no_frequency_rate_drop' END AS reason_code FROM rdh
""")
def _(spark, sf):
    return round_all(R.rate_drop_test(CQ.entity_features(spark, sf)).select(*KEY, "hit_flag", "p_value", "reason_code"), 6)


@query("rule_evidence_ids", f"""
SELECT entity_id, cutoff_month, horizon, substr(sha256(entity_id || '|' || horizon || '|sales_fluctuation|purchase_quantity_fluctuation_warning|v2|' || cutoff_month || '|' || horizon || '|' ||
  CASE WHEN r IS NULL THEN 'quantity_fields_missing' WHEN r < 0.5 THEN 'quantity_drop' WHEN r > 3 THEN 'quantity_spike' ELSE 'no_quantity_fluctuation' END
  || '|orders_3m=' || CAST(order_count_last_3m_asof_cutoff AS BIGINT)), 1, 16) AS evidence_id FROM qr, (VALUES ('H1'), ('H3'), ('H6'), ('H12')) t(horizon)
""")
def _(spark, sf):
    s = CQ.refined(spark, sf)
    values = s.selectExpr(*KEY, "concat('orders_3m=', cast(order_count_last_3m_asof_cutoff as bigint)) as evidence_values")
    e = R.quantity_fluctuation(s).join(values, KEY).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in ("H1", "H3", "H6", "H12")])))
    e = e.withColumns({"candidate_id": F.concat_ws("|", "entity_id", "horizon"), "detector_version": F.lit("v2")})
    return R.evidence_ids(e).select(*KEY, "horizon", "evidence_id")


@query("rule_benjamini_hochberg", f"""
WITH t AS (SELECT entity_id, cutoff_month, horizon, round(CASE horizon WHEN 'H3' THEN p3 ELSE p6 END, 10) AS p FROM rd, (VALUES ('H3'), ('H6')) h(horizon) WHERE p3 IS NOT NULL),
r AS (SELECT *, p * count(*) OVER (PARTITION BY cutoff_month, horizon) / count(*) OVER (PARTITION BY cutoff_month, horizon ORDER BY p) AS raw FROM t)
SELECT entity_id, cutoff_month, horizon, {rnd('least(min(raw) OVER (PARTITION BY cutoff_month, horizon ORDER BY p DESC), 1)', 6)} AS fdr_q_value FROM r
""")
def _(spark, sf):
    # One test per window, so that the horizons differ: 3 against 9 months for H3, 6 against 6 for H6.
    t = R.rate_drop_test(CQ.entity_features(spark, sf)).selectExpr(*KEY, "detector_name", "stack(2, 'H3', p_value_3m, 'H6', p_value_6m) as (horizon, p_value)")
    return round_all(R.benjamini_hochberg(t, ["cutoff_month", "horizon", "detector_name"]).select(*KEY, "horizon", "fdr_q_value"), 6)


def evidence(spark, sf, months=None):
    s = CQ.refined(spark, sf, months)
    cols = [*KEY, "detector_family", "detector_name", "hit_flag", "data_quality_status"]
    plain = [f(s).withColumn("data_quality_status", F.lit("ok")).select(*cols) for f in (R.terminal_loss, R.frequency_fluctuation, R.quantity_fluctuation, R.interval_overdue_test)]
    out = R.rate_drop_test(CQ.entity_features(spark, sf, months)).select(*cols)
    for p in plain:
        out = out.unionByName(p)
    return out


cte("evd", f"""
SELECT entity_id, cutoff_month, 'terminal_dynamic' AS detector_family, 'terminal_loss_warning' AS detector_name, {_ST} AND demand_shape_route <> 'observation_only' AS hit_flag, 'ok' AS quality FROM surv
UNION ALL SELECT entity_id, cutoff_month, 'sales_fluctuation', 'purchase_frequency_fluctuation_warning', coalesce(d3 < 0.5 OR d6 < 0.6, false), 'ok' FROM d36
UNION ALL SELECT entity_id, cutoff_month, 'sales_fluctuation', 'purchase_quantity_fluctuation_warning', coalesce(r < 0.5 OR r > 3, false), 'ok' FROM qr
UNION ALL SELECT entity_id, cutoff_month, 'terminal_dynamic', 'purchase_interval_overdue_warning', h, 'ok' FROM iz
UNION ALL SELECT entity_id, cutoff_month, 'sales_fluctuation', 'purchase_frequency_decay_rate_test', h3 OR h6, CASE WHEN least(p3, p6) IS NULL OR p3 IS NULL OR p6 IS NULL THEN 'not_evaluable' ELSE 'ok' END FROM rdh
""")


@query("rule_corroboration", """
WITH f AS (
  SELECT *, CASE detector_name WHEN 'terminal_loss_warning' THEN 'terminal' WHEN 'purchase_interval_overdue_warning' THEN 'terminal' WHEN 'purchase_quantity_fluctuation_warning' THEN 'quantity' ELSE 'frequency' END AS fam FROM evd
), g AS (
  SELECT entity_id, cutoff_month, count(DISTINCT fam) FILTER (hit_flag AND quality <> 'not_evaluable') AS effective_family_count, count(*) FILTER (hit_flag) AS hit_count,
    coalesce(bool_or(hit_flag AND detector_name = 'purchase_frequency_decay_rate_test'), false) AS tested FROM f GROUP BY entity_id, cutoff_month
)
SELECT entity_id, cutoff_month, effective_family_count, hit_count, CASE WHEN demand_shape_route = 'observation_only' THEN 'suppressed_by_l2' WHEN effective_family_count = 0 THEN 'none'
  WHEN effective_family_count >= 2 THEN 'multi_signal' WHEN tested THEN 'provisional_fdr_ready' ELSE 'single_signal' END AS corroboration_level
FROM g LEFT JOIN (SELECT entity_id, cutoff_month, demand_shape_route FROM surv) USING (entity_id, cutoff_month)
""")
def _(spark, sf):
    months = common.settled_months(spark, sf)
    guard = CQ.refined(spark, sf, months).selectExpr(*KEY, "if(demand_shape_route = 'observation_only', 'policy_caveat', 'none') as l2_guardrail")
    return R.corroboration(evidence(spark, sf, months), guardrail=guard)


@query("rule_p_value_readiness", """
WITH t AS (
  SELECT 'purchase_frequency_decay_rate_test' AS detector_name, least(p3, p6) AS p, CASE WHEN least(p3, p6) IS NULL THEN 'not_available' ELSE 'conditional_binomial' END AS method, least(p3, p6) IS NOT NULL AS ok FROM rdh
  UNION ALL SELECT 'purchase_interval_overdue_warning', z, CASE WHEN z IS NULL THEN 'not_available_mad_missing' ELSE 'robust_interval_z_normal_approx' END, true FROM iz
)
SELECT detector_name, count(*) FILTER (ok) AS evaluated_row_count, count(p) AS p_value_available_count, count(*) - count(p) AS p_value_missing_count, count(p) AS fdr_eligible_count,
  string_agg(DISTINCT method, ';' ORDER BY method) AS p_value_method, CASE WHEN count(p) > 0 THEN 'ready_for_future_fdr' ELSE 'partial_or_not_ready_for_fdr' END AS readiness_note FROM t GROUP BY detector_name
""")
def _(spark, sf):
    cols = ["detector_name", "p_value", "p_value_method", "fdr_eligible", "data_quality_status"]
    e = R.rate_drop_test(CQ.entity_features(spark, sf)).select(*cols)
    return R.p_value_readiness(e.unionByName(R.interval_overdue_test(CQ.refined(spark, sf)).withColumn("data_quality_status", F.lit("ok")).select(*cols)))


@query("rule_closure_detectors", """
WITH c AS (SELECT *, interval_overdue_baseline AS o, terminal_count_last_12m_asof_cutoff > 0 AND order_count_last_3m_asof_cutoff <= 0 AND months_since_last_purchase_asof_cutoff >= 3 AS t FROM featb)
SELECT entity_id, cutoff_month, 'terminal_loss_warning' AS detector_name, t AS hit_flag, CASE WHEN t THEN 'strong' ELSE 'none' END AS severity FROM c
UNION ALL SELECT entity_id, cutoff_month, 'purchase_interval_overdue_warning', coalesce(o >= 1.2, false), CASE WHEN o >= 1.2 THEN 'strong' ELSE 'none' END FROM c
UNION ALL SELECT entity_id, cutoff_month, 'purchase_frequency_fluctuation_warning', coalesce(frequency_decay_baseline >= 0.5, false), CASE WHEN frequency_decay_baseline >= 0.5 THEN 'medium' ELSE 'none' END FROM c
""")
def _(spark, sf):
    from orderpulse.operators.survival import closure_state

    return R.closure_rules(closure_state(CQ.entity_features(spark, sf))).select(*KEY, "detector_name", "hit_flag", "severity")


@query("rule_family_summary", f"SELECT detector_family, detector_name, count(*) AS evaluated_count, count(*) FILTER (hit_flag) AS hit_count, {rnd('count(*) FILTER (hit_flag) / count(*)')} AS hit_rate FROM evd GROUP BY ALL")
def _(spark, sf):
    return round_all(R.family_summary(evidence(spark, sf)))


def _drop(c):
    return f"coalesce(least(greatest(1 - {c}_last_3m_asof_cutoff / nullif({c}_last_12m_asof_cutoff / 4, 0), 0), 1), 0)"


@query("model_rule_score", f"""
SELECT entity_id, cutoff_month, {rnd(f"0.35 * least(months_since_last_purchase_asof_cutoff / 12, 1) + 0.25 * CASE WHEN median_purchase_interval_days_asof_cutoff <> 0 THEN least(greatest(months_since_last_purchase_asof_cutoff / (median_purchase_interval_days_asof_cutoff / 30.4375) - 1, 0), 1) ELSE 0 END + 0.20 * {_drop('order_count')} + 0.20 * {_drop('purchase_quantity_sum')}")} AS rule_score,
  purchase_count_asof_cutoff >= 3 AND active_month_count_asof_cutoff >= 2 AS recurring_candidate FROM feat
""")
def _(spark, sf):
    return round_all(M.rule_scores(FQ.feats(spark, sf).withColumn("entity_id", A.entity_id(ENTITY))).select(*KEY, "rule_score", "recurring_candidate"))


@query("model_one_shot_silence", f"""
WITH v AS (SELECT *, round(historical_avg_monthly_amount_asof_cutoff + 1.3e-9, 6) AS s FROM feat), q AS (SELECT cutoff_month, quantile_cont(s, 0.8) AS lim FROM v GROUP BY cutoff_month)
SELECT entity_id, cutoff_month, purchase_count_asof_cutoff = 1 AND months_since_first_purchase_asof_cutoff <= 12 AND s >= lim AND months_since_last_purchase_asof_cutoff >= 3 AS one_shot_high_value_silence_flag FROM v JOIN q USING (cutoff_month)
""")
def _(spark, sf):
    f = FQ.feats(spark, sf).withColumns({"entity_id": A.entity_id(ENTITY), "s": F.expr("round(historical_avg_monthly_amount_asof_cutoff + 1.3e-9D, 6)")})
    return M.one_shot_silence(f, ["cutoff_month"], "s").select(*KEY, "one_shot_high_value_silence_flag")


_B = M.BUCKET


@query("model_hazard_baseline", f"""
WITH b AS (SELECT *, {_B.format('recency')} AS rb, {_B.format('n_orders')} AS fb FROM mf), r AS (SELECT horizon, rb, fb, demand_shape_label, avg(y) AS hz FROM b WHERE cutoff_month <= DATE '1999-12-31' GROUP BY ALL)
SELECT entity_id, cutoff_month, b.horizon, {rnd("coalesce(hz, (SELECT avg(y) FROM b WHERE cutoff_month <= DATE '1999-12-31'))")} AS score FROM b LEFT JOIN r ON b.horizon = r.horizon AND b.rb = r.rb AND b.fb = r.fb AND b.demand_shape_label = r.demand_shape_label
""")
def _(spark, sf):
    return round_all(M.hazard_baseline(EV.frame(spark, sf), "cutoff_month <= date'1999-12-31'").select(*KEY, "horizon", "score"))


@query("model_rank_probability", f"""
SELECT entity_id, cutoff_month, horizon, {rnd(f"least(greatest(avg(y) OVER (PARTITION BY horizon, cutoff_month) * (0.5 + coalesce({pr('o8', 'horizon, cutoff_month')}, 0.5)), 0), 1)")} AS probability FROM (SELECT *, round(overdue, 8) AS o8 FROM mf)
""")
def _(spark, sf):
    return round_all(M.rank_probability(EV.frame(spark, sf), "overdue", ["horizon", "cutoff_month"]).select(*KEY, "horizon", "probability"))


_PG = " UNION ALL ".join(
    f"SELECT '{n}' AS group_name, {' || chr(124) || '.join(c)} AS group_key, count(*) AS group_count, CAST(sum(label_repeat_H6) AS BIGINT) AS group_positive_count, {rnd('(sum(label_repeat_H6) + (SELECT avg(label_repeat_H6) FROM fps) * 20) / (count(*) + 20)')} AS smoothed_repeat_rate FROM fps WHERE label_repeat_H6 IS NOT NULL GROUP BY {', '.join(c)}"
    for n, c in M.PRIOR_GROUPS.items())


@query("model_group_priors", _PG)
def _(spark, sf):
    return round_all(M.group_priors(EV.samples(spark, sf), "label_repeat_H6").drop("global_repeat_rate"))


@query("model_interval_proxy", f"SELECT origin_date, org_code, product_line_code, {rnd('1 / (1 + greatest(0, days_since_last_purchase / nullif(median_interval_days, 0) - 0.5))')} AS p_alive, CASE WHEN median_interval_days > 0 THEN CASE WHEN purchase_count_365d >= 2 THEN 0.35 ELSE 0.2 END ELSE 0.1 END::DOUBLE AS confidence FROM usnap")
def _(spark, sf):
    from orderpulse.operators.units import unit_snapshot

    s = unit_snapshot(RQ.unit_orders(spark, sf), RQ.ORIGINS)
    return round_all(M.interval_proxy(s).select("origin_date", *RQ.UNIT, "p_alive", "confidence"))


def p_alive_units(spark, sf):
    o = RQ.unit_orders(spark, sf).withColumn("org_level", F.expr("concat('L', cast(substring(org_code, 2) as int) % 3)"))
    return M.select_p_alive(M.intermittent_proxy(M.interval_survival(o, "2001-06-30", RQ.UNIT)))


cte("pau", """
WITH g AS (SELECT org_code, product_line_code, order_date, min(province_code) AS pv, order_date - lag(order_date) OVER (PARTITION BY org_code, product_line_code ORDER BY order_date) AS gap FROM uo WHERE order_date <= DATE '2001-06-30' GROUP BY org_code, product_line_code, order_date),
o AS (SELECT org_code, product_line_code, count(gap) AS n, avg(gap) AS mg, DATE '2001-06-30' - max(order_date) AS d, min(pv) AS pv, 'L' || CAST(CAST(substr(org_code, 2) AS INTEGER) % 3 AS VARCHAR) AS lv FROM g GROUP BY org_code, product_line_code),
u AS (SELECT *, CASE WHEN n < 2 THEN 'cold_start' WHEN mg <= 35 THEN 'smooth' WHEN mg <= 75 THEN 'erratic' ELSE 'intermittent' END AS dp FROM o),
x AS (SELECT g.gap, u.* FROM g JOIN u USING (org_code, product_line_code) WHERE gap IS NOT NULL),
q AS (SELECT u.org_code, u.product_line_code, u.n, u.d, u.mg, u.dp, x.gap >= u.d AS ge, x.org_code = u.org_code AND x.product_line_code = u.product_line_code AS same,
  x.product_line_code = u.product_line_code AND x.lv = u.lv AND x.pv = u.pv AND x.dp = u.dp AS s1, x.product_line_code = u.product_line_code AND x.pv = u.pv AS s2, x.product_line_code = u.product_line_code AS s3 FROM u, x)
SELECT org_code, product_line_code, n, d, mg, dp, count(*) FILTER (same) AS own_n, count(*) FILTER (same AND ge) AS own_ge, count(*) FILTER (NOT same AND s1) AS n1, count(*) FILTER (NOT same AND s1 AND ge) AS g1,
  count(*) FILTER (NOT same AND s2) AS n2, count(*) FILTER (NOT same AND s2 AND ge) AS g2, count(*) FILTER (NOT same AND s3) AS n3, count(*) FILTER (NOT same AND s3 AND ge) AS g3,
  count(*) FILTER (NOT same) AS n4, count(*) FILTER (NOT same AND ge) AS g4 FROM q GROUP BY org_code, product_line_code, n, d, mg, dp
""")


@query("model_p_alive_survival", f"""
WITH p AS (SELECT *, CASE WHEN n1 >= 20 THEN 'strict' WHEN n2 >= 20 THEN 'product_province' WHEN n3 >= 20 THEN 'product_line' ELSE 'global' END AS cohort_level,
  CASE WHEN n1 >= 20 THEN g1 / n1 WHEN n2 >= 20 THEN g2 / n2 WHEN n3 >= 20 THEN g3 / n3 ELSE g4 / nullif(n4, 0) END AS pc, CASE WHEN n1 >= 20 THEN n1 WHEN n2 >= 20 THEN n2 WHEN n3 >= 20 THEN n3 ELSE n4 END AS cn, own_ge / nullif(own_n, 0) AS pu, n / (n + 5) AS w FROM pau)
SELECT org_code, product_line_code, cohort_level, {rnd('w * coalesce(pu, pc) + (1 - w) * coalesce(pc, pu)', 3)} AS p_alive FROM p
""")
def _(spark, sf):
    o = RQ.unit_orders(spark, sf).withColumn("org_level", F.expr("concat('L', cast(substring(org_code, 2) as int) % 3)"))
    s = M.interval_survival(o, "2001-06-30", RQ.UNIT)
    w = "n / (n + 5D)"
    return round_all(s.selectExpr(*RQ.UNIT, "cohort_level", f"{w} * p_unit + (1 - {w}) * p_cohort as p_alive"), 3)


@query("model_p_alive_selected", f"""
SELECT org_code, product_line_code, dp AS demand_profile, CASE WHEN dp = 'intermittent' THEN 'intermittent_overdue_proxy' ELSE 'interval_survival_proxy' END AS selected_model_name,
  {rnd('CASE WHEN mg IS NOT NULL THEN 1 / (1 + greatest(0, d - mg) / greatest(mg * 1.5, 1)) END', 3)} AS p_intermittent FROM pau
""")
def _(spark, sf):
    s = p_alive_units(spark, sf).withColumn("p_intermittent", F.expr("1D / (1D + greatest(0D, d - mean_gap) / greatest(mean_gap * 1.5D, 1D))"))
    return round_all(s.select(*RQ.UNIT, "demand_profile", "selected_model_name", "p_intermittent"), 3)
