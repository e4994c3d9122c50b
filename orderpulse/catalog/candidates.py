"""Survival and candidate-selection queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import evaluation as EV
from orderpulse.catalog import features as FQ
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.catalog.features import pr
from orderpulse.functions.exprs import round_all
from orderpulse.operators import candidates as K
from orderpulse.operators import features as A
from orderpulse.operators import survival as V
from orderpulse.schemas import ENTITY
from orderpulse.session import cut_lineage

_E = "manufacturer_code, hospital_code, drug_group"
_G = "horizon, cutoff_month"


def entity_features(spark, sf, months=None):
    return cut_lineage(FQ.feats(spark, sf, months=months).withColumn("entity_id", A.entity_id(ENTITY)))


def refined(spark, sf, months=None):
    return V.refine(entity_features(spark, sf, months))


_ROUTES = ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in V.ROUTES)
_PRI = " UNION ALL ".join(
    f"""SELECT cutoff_month, '{n}' AS group_name, {" || '|' || ".join(c) if c else "'global'"} AS group_key, count(*) AS group_count, quantile_cont(med, 0.5) AS median_interval_days, avg(med) AS mean_interval_days
  FROM (SELECT *, median_purchase_interval_days_asof_cutoff AS med FROM feat) WHERE med IS NOT NULL GROUP BY {', '.join(['cutoff_month', *c])}""" for n, c in V.PRIOR_LEVELS)
cte("prior", _PRI)
_JOINS = " ".join(
    f"LEFT JOIN prior p{i} ON p{i}.group_name = '{n}' AND p{i}.cutoff_month = f.cutoff_month AND p{i}.group_key = " + (" || '|' || ".join(f"f.{x}" for x in c) if c else "'global'")
    for i, (n, c) in enumerate(V.PRIOR_LEVELS))
cte("surv", f"""
WITH routes AS (SELECT * FROM (VALUES {_ROUTES}) t(shape, survival_method, confidence_multiplier, allowed_horizons, alert_policy, demand_shape_route)),
f0 AS (SELECT f.* EXCLUDE (history_sufficiency_flag), interval_flag AS history_sufficiency_flag, coalesce(r.survival_method, 'unknown') AS survival_method, coalesce(r.confidence_multiplier, 0.5)::DOUBLE AS confidence_multiplier,
  coalesce(r.allowed_horizons, 'manual_review') AS allowed_horizons, coalesce(r.alert_policy, 'manual_review_required') AS alert_policy, coalesce(r.demand_shape_route, 'unknown') AS demand_shape_route
  FROM feat f JOIN ({FQ._HI.replace('feat)', 'feat)')}) hi ON f.entity_id = hi.entity_id AND f.cutoff_month = hi.cutoff_month LEFT JOIN routes r ON f.demand_shape_label = r.shape),
f1 AS (SELECT f.*, coalesce({', '.join(f'p{i}.median_interval_days' for i in range(6))}) AS prior_days, CASE {' '.join(f"WHEN p{i}.median_interval_days IS NOT NULL THEN '{V.PRIOR_LEVELS[i][0]}'" for i in range(6))} ELSE '' END AS prior_source,
  median_purchase_interval_days_asof_cutoff AS med, least(1, purchase_count_asof_cutoff / 6) AS w FROM f0 f {_JOINS}),
f2 AS (SELECT *, CASE WHEN history_sufficiency_flag = 'history_sufficient' THEN med WHEN history_sufficiency_flag = 'history_medium' AND med IS NOT NULL AND prior_days IS NOT NULL THEN w * med + (1 - w) * prior_days
    WHEN history_sufficiency_flag = 'history_medium' AND med IS NOT NULL THEN med ELSE prior_days END AS expected_days,
  CASE WHEN history_sufficiency_flag = 'history_sufficient' THEN 'entity_median_interval' WHEN history_sufficiency_flag = 'history_medium' AND med IS NOT NULL AND prior_days IS NOT NULL THEN 'entity_group_mixed_interval'
    WHEN history_sufficiency_flag = 'history_medium' AND med IS NOT NULL THEN 'entity_median_interval_low_confidence' WHEN prior_days IS NOT NULL THEN 'group_prior_only' ELSE 'unavailable' END AS expected_source FROM f1),
f3 AS (SELECT *, CASE WHEN expected_days IS NOT NULL THEN months_since_last_purchase_asof_cutoff / greatest(expected_days / 30.4375, 1e-9) END AS overdue_ratio FROM f2)
SELECT *, CASE WHEN history_sufficiency_flag = 'one_shot' THEN 'not_applicable_one_shot' WHEN history_sufficiency_flag = 'history_insufficient' THEN 'insufficient_history'
    WHEN demand_shape_label = 'lumpy' THEN 'low_confidence_lumpy' WHEN overdue_ratio IS NULL THEN 'insufficient_interval_data' WHEN overdue_ratio < 0.8 THEN 'normal_interval' WHEN overdue_ratio < 1.2 THEN 'near_expected_interval'
    WHEN overdue_ratio < 2 THEN 'slightly_overdue' WHEN overdue_ratio < 3 THEN 'materially_overdue' ELSE 'likely_churn_interval' END AS survival_state,
  least(least(purchase_count_asof_cutoff / 6, 1) * confidence_multiplier, CASE WHEN history_sufficiency_flag <> 'history_sufficient' THEN 0.4 ELSE 1 END, CASE WHEN expected_source = 'group_prior_only' THEN 0.5 ELSE 1 END)::DOUBLE AS survival_confidence FROM f3
""")


@query("survival_shape_route", f"SELECT entity_id, cutoff_month, survival_method, confidence_multiplier, allowed_horizons, alert_policy, demand_shape_route FROM surv")
def _(spark, sf):
    return V.with_route(entity_features(spark, sf)).select("entity_id", "cutoff_month", *V.ROUTE_FIELDS)


@query("survival_group_priors", f"SELECT cutoff_month, group_name, group_key, group_count, {rnd('median_interval_days')} AS median_interval_days, {rnd('mean_interval_days', 6)} AS mean_interval_days FROM prior")
def _(spark, sf):
    p = V.group_priors(entity_features(spark, sf))
    return round_all(p, 6)


@query("survival_best_prior", f"SELECT entity_id, cutoff_month, {rnd('prior_days')} AS group_prior_interval_days, prior_source AS group_prior_source FROM surv")
def _(spark, sf):
    f = entity_features(spark, sf)
    return round_all(V.attach_prior(f, V.group_priors(f)).select("entity_id", "cutoff_month", "group_prior_interval_days", "group_prior_source"))


@query("survival_expected_interval", f"SELECT entity_id, cutoff_month, {rnd('expected_days')} AS expected_interval_days, expected_source AS expected_interval_source FROM surv")
def _(spark, sf):
    return round_all(refined(spark, sf).select("entity_id", "cutoff_month", "expected_interval_days", "expected_interval_source"))


@query("survival_state", f"SELECT entity_id, cutoff_month, {rnd('overdue_ratio')} AS overdue_ratio, survival_state FROM surv")
def _(spark, sf):
    return round_all(refined(spark, sf).select("entity_id", "cutoff_month", "overdue_ratio", "survival_state"))


@query("survival_state_closure", f"""
SELECT entity_id, cutoff_month, CASE WHEN one_shot_flag THEN 'one_shot_not_applicable' WHEN o IS NULL THEN 'insufficient_interval_data' WHEN o >= 2 THEN 'high_overdue' WHEN o >= 1.2 THEN 'overdue' WHEN o >= 0.8 THEN 'near_due' ELSE 'on_track' END AS survival_state
FROM (SELECT *, interval_overdue_baseline AS o FROM featb)
""")
def _(spark, sf):
    return V.closure_state(entity_features(spark, sf)).select("entity_id", "cutoff_month", "survival_state")


@query("survival_confidence_review", f"""
SELECT entity_id, cutoff_month, {rnd('survival_confidence')} AS survival_confidence, survival_state IN ('materially_overdue', 'likely_churn_interval') OR demand_shape_label IN ('erratic', 'intermittent', 'lumpy')
  OR history_sufficiency_flag <> 'history_sufficient' OR survival_confidence < 0.7 AS human_review_required FROM surv
""")
def _(spark, sf):
    return round_all(refined(spark, sf).select("entity_id", "cutoff_month", "survival_confidence", "human_review_required"))


# Candidate frames.
cte("cf", "SELECT *, entity_id || '|' || horizon AS candidate_id, p * v AS prio FROM mfa WHERE sample_class = 'recurring'")
cte("pol", f"""
SELECT *, coalesce(pr_p, 0) AS probability_rank_score, coalesce(pr_o, 0) AS interval_rank_score, coalesce(pr_d, 0) AS frequency_rank_score, coalesce(pr_p, 0) * coalesce(pr_v, 0.5) AS business_priority_score
FROM (SELECT *, {pr('p', _G)} AS pr_p, {pr('o8', _G)} AS pr_o, {pr('d8', _G)} AS pr_d, {pr('v', _G)} AS pr_v FROM (SELECT *, round(overdue, 8) AS o8, round(decay, 8) AS d8 FROM cf))
""")


def cand(spark, sf):
    """Recurring rows, materialised once: the policies read them several times."""
    r = EV.all_rows(spark, sf).where("sample_class = 'recurring'")
    return cut_lineage(r.selectExpr("*", "concat(entity_id, '|', horizon) as candidate_id", "p * v as prio"))


_SC = ["probability_rank_score", "interval_rank_score", "frequency_rank_score", "business_priority_score"]


@query("candidates_policy_scores", f"SELECT candidate_id, cutoff_month, {', '.join(rnd(c) + ' AS ' + c for c in _SC)} FROM pol")
def _(spark, sf):
    return round_all(K.policy_scores(cand(spark, sf)).select("candidate_id", "cutoff_month", *_SC))


@query("candidates_full_recurring", f"""
SELECT candidate_id, cutoff_month, p >= 0.7 AS is_high_risk_candidate, row_number() OVER (ORDER BY p DESC, business_priority_score DESC, candidate_id, cutoff_month) AS rank_global,
  row_number() OVER (PARTITION BY manufacturer_code ORDER BY p DESC, business_priority_score DESC, candidate_id, cutoff_month) AS rank_per_manufacturer FROM pol
""")
def _(spark, sf):
    return K.select_recurring(cand(spark, sf)).select("candidate_id", "cutoff_month", "is_high_risk_candidate", "rank_global", "rank_per_manufacturer")


def top_sql(score, pct=0.10):
    return f"row_number() OVER (PARTITION BY {_G} ORDER BY {score} DESC NULLS LAST, {_E}) <= greatest(1, ceil(count(*) OVER (PARTITION BY {_G}) * {pct}))"


@query("candidates_top_pct", f"SELECT candidate_id, cutoff_month, {top_sql('p')} AS is_top FROM cf")
def _(spark, sf):
    return K.top_pct(cand(spark, sf), "p", 0.10).select("candidate_id", "cutoff_month", "is_top")


cte("flags", f"SELECT *, {', '.join(f'{top_sql(s)} AS {n}' for n, s in K.POLICY_SCORES.items())} FROM pol")
cte("flagu", "SELECT *, " + " OR ".join(K.POLICY_SCORES) + " AS multi_recall_union_top10 FROM flags")


def flagged(spark, sf):
    return K.recall_union(cut_lineage(K.policy_scores(cand(spark, sf))))


@query("candidates_recall_union", f"SELECT candidate_id, cutoff_month, {', '.join(K.POLICY_SCORES)}, multi_recall_union_top10 FROM flagu")
def _(spark, sf):
    return flagged(spark, sf).select("candidate_id", "cutoff_month", *K.POLICY_SCORES, "multi_recall_union_top10")


@query("candidates_manufacturer_worklist", f"""
SELECT entity_id, manufacturer_code, horizon, cutoff_month, {rnd('p')} AS p, {rnd('v', 6)} AS v, demand_shape_label FROM (SELECT *, row_number() OVER (PARTITION BY manufacturer_code, {_G} ORDER BY p >= 0.7 DESC, p DESC, entity_id) AS rn FROM cf) WHERE rn <= 20
""")
def _(spark, sf):
    w = K.manufacturer_worklist(cand(spark, sf).withColumn("is_high_risk_candidate", F.col("p") >= 0.7), 20)
    return w.select("entity_id", "manufacturer_code", "horizon", "cutoff_month", "p", "v", "demand_shape_label")


@query("candidates_relative_value", f"""
SELECT candidate_id, cutoff_month, {rnd('greatest(historical_avg_monthly_amount_asof_cutoff * h, 0)', 6)} AS "relative_value_at_risk_H", 'historical_avg_monthly_amount_asof_cutoff' AS relative_value_source, false AS value_missing FROM featx
""")
def _(spark, sf):
    x = A.expand_horizons(FQ.feats(spark, sf))
    r = K.relative_value(x, A.horizon_number())
    return round_all(r.select("candidate_id", "cutoff_month", "relative_value_at_risk_H", "relative_value_source", "value_missing"), 6)


cte("prk", f"""
SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY prio DESC, {_E}) AS rank_global, row_number() OVER (PARTITION BY {_G}, manufacturer_code ORDER BY prio DESC, {_E}) AS rank_within_manufacturer,
  count(*) OVER (PARTITION BY {_G}) AS n FROM cf
""")


@query("candidates_priority_ranks", "SELECT candidate_id, cutoff_month, rank_global, rank_within_manufacturer FROM prk")
def _(spark, sf):
    return K.priority_ranks(cand(spark, sf)).select("candidate_id", "cutoff_month", "rank_global", "rank_within_manufacturer")


cte("sel", f"""
WITH t AS (SELECT *, rank_global <= greatest(1, ceil(n * 0.01)) AS top FROM prk),
s AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY {_G}, manufacturer_code) AS have, count(*) OVER (PARTITION BY {_G}, manufacturer_code) AS avail,
  row_number() OVER (PARTITION BY {_G}, manufacturer_code, top ORDER BY prio DESC, rank_within_manufacturer) AS i FROM t)
SELECT *, CASE WHEN top THEN 'global_top5pct' WHEN avail < 8 THEN 'available_entities_less_than_minimum' ELSE 'manufacturer_min_fill' END AS selection_reason
FROM s WHERE top OR i <= greatest(least(avail, 8) - have, 0)
""")


def selected(spark, sf):
    return K.top_pct_with_fill(cand(spark, sf), 0.01, 8)


@query("candidates_top_pct_min_fill", "SELECT candidate_id, cutoff_month, rank_global, rank_within_manufacturer, selection_reason FROM sel")
def _(spark, sf):
    return selected(spark, sf).select("candidate_id", "cutoff_month", "rank_global", "rank_within_manufacturer", "selection_reason")


@query("candidates_fill_audit", f"SELECT {_G}, selection_reason, count(*) AS selected_row_count, count(DISTINCT manufacturer_code) AS manufacturer_count FROM sel GROUP BY ALL")
def _(spark, sf):
    return K.fill_audit(selected(spark, sf))


@query("candidates_collapse_horizons", f"""
SELECT entity_id, cutoff_month, string_agg(DISTINCT horizon, ',' ORDER BY length(horizon), horizon) AS selected_horizons, string_agg(DISTINCT selection_reason, ';' ORDER BY selection_reason) AS candidate_selection_reasons,
  first(horizon ORDER BY (h = 6)::INTEGER DESC, prio DESC, h) AS primary_horizon, {rnd('first(p ORDER BY (h = 6)::INTEGER DESC, prio DESC, h)')} AS primary_churn_probability,
  first(rank_global ORDER BY (h = 6)::INTEGER DESC, prio DESC, h) AS rank_global_primary_horizon FROM sel GROUP BY entity_id, cutoff_month
""".replace("string_agg(DISTINCT horizon, ',' ORDER BY length(horizon), horizon)", "array_to_string(list_transform(list_sort(list(DISTINCT h)), lambda x: 'H' || x), ',')"))
def _(spark, sf):
    c = K.collapse_horizons(selected(spark, sf))
    return round_all(c.select("entity_id", "cutoff_month", "selected_horizons", "candidate_selection_reasons", "primary_horizon", "primary_churn_probability", "rank_global_primary_horizon"))


@query("candidates_one_shot_attention", f"SELECT {_E}, cutoff_month, first_purchase_month_asof_cutoff AS first_purchase_month, {rnd('historical_avg_monthly_amount_asof_cutoff', 6)} AS one_shot_value_score, false AS probability_available FROM feat WHERE sample_class = 'one_shot'")
def _(spark, sf):
    return round_all(K.one_shot_attention(FQ.feats(spark, sf)).drop("attention_reason"), 6)


cte("ob", """
SELECT *, CASE WHEN demand_shape_label = 'lumpy' THEN 'observation_only' ELSE 'longer_horizon_only' END AS demand_shape_route,
  CASE WHEN demand_shape_label = 'lumpy' THEN 'lumpy_high_risk_low_confidence' ELSE 'intermittent_H3_observation_only' END AS observation_reason
FROM cf WHERE p >= 0.5 AND ((demand_shape_label = 'intermittent' AND h = 3) OR demand_shape_label = 'lumpy')
""")


def observations(spark, sf):
    return K.observation_list(cand(spark, sf), 0.5)


@query("candidates_observation_list", "SELECT candidate_id, cutoff_month, demand_shape_route, observation_reason FROM ob")
def _(spark, sf):
    return observations(spark, sf).select("candidate_id", "cutoff_month", "demand_shape_route", "observation_reason")


@query("candidates_display_ready", f"""
WITH r AS (SELECT *, {pr('p', 'cutoff_month, horizon, manufacturer_code')} AS pq, {pr('v', 'cutoff_month, horizon, manufacturer_code')} AS vq FROM ob),
k AS (SELECT *, row_number() OVER (PARTITION BY manufacturer_code ORDER BY (horizon = 'H12')::INTEGER DESC, greatest(pq, vq) DESC, p DESC, entity_id, horizon) AS rn FROM r
  WHERE cutoff_month = (SELECT max(cutoff_month) FROM ob) AND history_sufficiency_flag <> 'history_insufficient' AND (horizon = 'H12' OR pq >= 0.8 OR vq >= 0.8 OR demand_shape_route = 'observation_only'))
SELECT candidate_id, CASE WHEN horizon = 'H12' THEN 'primary_horizon_H12' WHEN pq >= 0.8 THEN 'probability_top20pct' WHEN vq >= 0.8 THEN 'value_top20pct' ELSE 'explicit_observation_only_guardrail' END AS display_ready_reason FROM k WHERE rn <= 20
""")
def _(spark, sf):
    return K.display_ready(observations(spark, sf)).select("candidate_id", "display_ready_reason")


@query("candidates_display_audit", """
SELECT 'raw' AS filter_stage, count(*) AS row_count FROM ob UNION ALL SELECT 'latest_cutoff', count(*) FROM ob WHERE cutoff_month = (SELECT max(cutoff_month) FROM ob)
UNION ALL SELECT 'history_sufficiency', count(*) FROM ob WHERE cutoff_month = (SELECT max(cutoff_month) FROM ob) AND history_sufficiency_flag <> 'history_insufficient'
""")
def _(spark, sf):
    return K.display_audit(observations(spark, sf))


@query("candidates_pool_overlap", """
WITH u AS (SELECT DISTINCT entity_id, 'recurring' AS pool FROM sel UNION ALL SELECT DISTINCT entity_id, 'observation' FROM ob UNION ALL SELECT DISTINCT entity_id, 'one_shot' FROM feat WHERE sample_class = 'one_shot')
SELECT pools, count(*) AS entity_count FROM (SELECT entity_id, string_agg(pool, '+' ORDER BY pool) AS pools FROM u GROUP BY entity_id) GROUP BY pools
""")
def _(spark, sf):
    one = entity_features(spark, sf).where("sample_class = 'one_shot'")
    return K.pool_overlap({"recurring": selected(spark, sf), "observation": observations(spark, sf), "one_shot": one}, ["entity_id"])


@query("candidates_row_decomposition", """
SELECT count(*) AS row_count, count(DISTINCT (entity_id, cutoff_month)) AS entity_cutoff_count, count(DISTINCT entity_id) AS entity_count, count(DISTINCT manufacturer_code) AS manufacturer_count,
  count(DISTINCT cutoff_month) AS cutoff_count, 'multiple_horizons_per_entity_cutoff;multiple_cutoffs_per_entity' AS expansion_reasons FROM ob
""")
def _(spark, sf):
    return K.row_decomposition(observations(spark, sf))


_POLS = [*K.POLICY_SCORES, "multi_recall_union_top10"]
cte("peval", " UNION ALL ".join(
    f"""SELECT {_G}, '{f}' AS policy, count(*) FILTER ({f}) AS candidate_count, count(*) FILTER ({f}) / count(*) AS candidate_rate, coalesce(sum(y) FILTER ({f}), 0) / nullif(sum(y), 0) AS recall,
  (sum(y) FILTER ({f}) / nullif(count(*) FILTER ({f}), 0)) / nullif(sum(y) FILTER (NOT {f}) / nullif(count(*) FILTER (NOT {f}), 0), 0) AS lift_vs_rest, count(DISTINCT manufacturer_code) FILTER ({f}) AS manufacturer_coverage
  FROM flagu WHERE closed GROUP BY {_G}""" for f in _POLS))


def evaluated(spark, sf):
    return K.policy_evaluation(flagged(spark, sf).where("closed"), _POLS)


@query("candidates_policy_evaluation", f"SELECT {_G}, policy, candidate_count, {rnd('candidate_rate')} AS candidate_rate, {rnd('recall')} AS recall, {rnd('lift_vs_rest', 6)} AS lift_vs_rest, manufacturer_coverage FROM peval")
def _(spark, sf):
    e = evaluated(spark, sf)
    return round_all(e.withColumn("lift_vs_rest", F.expr("round(lift_vs_rest + 1.3e-9D, 6)")))


_PAIRS = [(a, b) for i, a in enumerate(_POLS) for b in _POLS[i + 1:]]


@query("candidates_policy_overlap", " UNION ALL ".join(
    f"""SELECT {_G}, '{a}' AS policy, '{b}' AS other_policy, count(*) FILTER ({a} AND {b}) AS overlap_count, count(*) FILTER ({a} OR {b}) AS union_count, {rnd(f'count(*) FILTER ({a} AND {b}) / nullif(count(*) FILTER ({a} OR {b}), 0)', 6)} AS jaccard,
  {rnd(f'count(*) FILTER ({a} AND {b}) / nullif(count(*) FILTER ({a}), 0)', 6)} AS share_of_policy FROM flagu GROUP BY {_G}""" for a, b in _PAIRS))
def _(spark, sf):
    return round_all(K.policy_overlap(flagged(spark, sf), _POLS), 6)


@query("candidates_policy_recommendation", f"""
WITH m AS (SELECT policy, avg(recall) AS r, avg(lift_vs_rest) AS l, avg(candidate_rate) AS c FROM peval GROUP BY policy)
SELECT policy, {rnd('r', 6)} AS mean_recall, {rnd('l', 6)} AS mean_lift, {rnd('c', 6)} AS mean_rate, row_number() OVER (ORDER BY round(r, 6) DESC, round(l, 6) DESC, policy) = 1 AS is_recommended FROM m
""")
def _(spark, sf):
    return round_all(K.recommend_policy(evaluated(spark, sf)), 6)


@query("candidates_worklist_capacity", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY manufacturer_code, {_G} ORDER BY p DESC, entity_id) AS i FROM cf WHERE closed)
SELECT horizon, capacity, count(*) AS rows_kept, {rnd('avg(y)')} AS positive_rate FROM r, (VALUES (20), (50)) t(capacity) WHERE i <= capacity GROUP BY ALL
""")
def _(spark, sf):
    return round_all(K.worklist_capacity(cand(spark, sf).where("closed")))


@query("candidates_capped_scope", """
SELECT entity_id, cutoff_month FROM mfa WHERE horizon = 'H6' AND sample_class = 'recurring'
UNION ALL SELECT entity_id, cutoff_month FROM (SELECT *, row_number() OVER (PARTITION BY manufacturer_code, sample_class ORDER BY v DESC, entity_id) AS i FROM mfa WHERE horizon = 'H6' AND sample_class <> 'recurring' AND cutoff_month = DATE '2000-12-31') WHERE i <= 10
""")
def _(spark, sf):
    h6 = EV.all_rows(spark, sf).where("horizon = 'H6' and (sample_class = 'recurring' or cutoff_month = date'2000-12-31')")
    return K.capped_scope(h6).select("entity_id", "cutoff_month")


@query("candidates_probability_gate", """
SELECT entity_id, cutoff_month, horizon, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.45 THEN 'medium' ELSE 'low' END AS model_confidence_bucket,
  CASE WHEN sample_class = 'one_shot' OR history_sufficiency_flag = 'history_insufficient' THEN 'hidden_data_insufficient'
    WHEN history_sufficiency_flag = 'history_sufficient' AND demand_shape_label NOT IN ('intermittent', 'lumpy', 'cold_start', 'unknown') AND p >= 0.45 THEN 'probability_allowed'
    WHEN history_sufficiency_flag = 'history_medium' OR demand_shape_label IN ('intermittent', 'lumpy') OR p < 0.45 THEN 'risk_band_only' ELSE 'observation_only' END AS probability_display_level,
  concat_ws('|', CASE WHEN sample_class = 'one_shot' THEN 'one_shot_not_recurring_churn' END, CASE WHEN history_sufficiency_flag IN ('history_insufficient', 'history_medium') THEN history_sufficiency_flag END,
    CASE WHEN demand_shape_label IN ('intermittent', 'lumpy', 'cold_start', 'unknown') THEN 'demand_shape_' || demand_shape_label END, 'selected_subset_not_full_universe') AS reason_code FROM mfa
""")
def _(spark, sf):
    return K.availability_gate(EV.all_rows(spark, sf)).select("entity_id", "cutoff_month", "horizon", "model_confidence_bucket", "probability_display_level", "reason_code")


_HC = ["n_orders", "n_months", "age", "adi"]


@query("candidates_history_audit", " UNION ALL ".join(
    f"""SELECT demand_shape_label, '{c}' AS "column", count(*) AS row_count, {rnd(f'avg({c})', 6)} AS mean, {rnd(f'quantile_cont({c}, 0.25)', 6)} AS p25, {rnd(f'quantile_cont({c}, 0.5)', 6)} AS median, {rnd(f'quantile_cont({c}, 0.75)', 6)} AS p75,
  {rnd(f'count(*) FILTER ({c} IS NULL) / count(*)', 6)} AS missing_rate, {rnd(f'count(*) FILTER ({c} < 3) / count(*)', 6)} AS share_below_3 FROM ob GROUP BY demand_shape_label""" for c in _HC))
def _(spark, sf):
    return round_all(K.history_audit(observations(spark, sf), _HC), 6)


@query("candidates_bucket_audit", """
SELECT demand_shape_label, observation_reason, 'probability' AS metric, CASE WHEN p >= 0.9 THEN '>=0.9' WHEN p >= 0.8 THEN '0.8-0.9' WHEN p >= 0.7 THEN '0.7-0.8' ELSE '<0.7' END AS bucket, count(*) AS row_count FROM ob GROUP BY ALL
UNION ALL SELECT demand_shape_label, observation_reason, 'value', CASE WHEN v IS NULL THEN 'missing' WHEN v <= 0 THEN '0' WHEN v < 1000 THEN '<1k' WHEN v < 10000 THEN '1k-10k' ELSE '>=10k' END, count(*) FROM ob GROUP BY ALL
""")
def _(spark, sf):
    return K.bucket_audit(observations(spark, sf))


@query("candidates_policy_by_manufacturer", f"""
SELECT manufacturer_code, count(*) AS row_count, count(*) FILTER (multi_recall_union_top10) AS candidate_count, {rnd('count(*) FILTER (multi_recall_union_top10) / count(*)')} AS candidate_rate,
  {rnd('avg(y) FILTER (multi_recall_union_top10)')} AS candidate_positive_rate FROM flagu WHERE closed GROUP BY manufacturer_code
""")
def _(spark, sf):
    return round_all(K.policy_by_manufacturer(flagged(spark, sf).where("closed"), "multi_recall_union_top10"))
