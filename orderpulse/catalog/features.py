"""Cutoff-feature queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.catalog.common import CUTOFFS
from orderpulse.functions import shapes
from orderpulse.functions.exprs import round_all
from orderpulse.operators import facts, scoring
from orderpulse.operators import features as A
from orderpulse.schemas import ENTITY

KEY = [*ENTITY, "cutoff_month"]
_CUTS = ", ".join(f"(DATE '{c}')" for c in CUTOFFS)
cte("cuts", f"SELECT * FROM (VALUES {_CUTS}) t(cutoff_month)")
cte("emg", """
SELECT *, purchase_month - lag(purchase_month) OVER (PARTITION BY manufacturer_code, hospital_code, drug_group ORDER BY purchase_month) AS gap_days
FROM em
""")
_WIN = []
for _m in (1, 3, 6, 12):
    _f = f"FILTER (purchase_month >= last_day((cutoff_month - INTERVAL {_m - 1} MONTH)::DATE))"
    for _c in A.WINDOW_MEASURES:
        _WIN.append(f"coalesce(sum({_c}) {_f}, 0) AS {_c}_last_{_m}m_asof_cutoff")
    _WIN.append(f"count(*) {_f} AS active_months_last_{_m}m_asof_cutoff")
_LAST = ", ".join(
    f"last({c} ORDER BY purchase_month) AS {c}"
    for c in ("province_code", "city_code", "county_code", "hospital_level_code", "ownership_type_code", "drug_category_code")
)
_MG = "((year(cutoff_month) - year({0})) * 12 + month(cutoff_month) - month({0}))"
cte("seen", f"""
SELECT *, {_MG.format('last_purchase_month_asof_cutoff')} AS months_since_last_purchase_asof_cutoff,
  {_MG.format('first_purchase_month_asof_cutoff')} AS months_since_first_purchase_asof_cutoff,
  {_MG.format('first_purchase_month_asof_cutoff')} + 1 AS months_observed_asof_cutoff,
  CASE WHEN {_MG.format('last_purchase_month_asof_cutoff')} > 12 THEN 'unmonitorable'
    WHEN active_month_count_asof_cutoff = 1 THEN 'one_shot' ELSE 'recurring' END AS sample_class
FROM (SELECT manufacturer_code, hospital_code, drug_group, cutoff_month, CAST(sum(order_count) AS BIGINT) AS purchase_count_asof_cutoff,
  count(*) AS active_month_count_asof_cutoff, min(purchase_month) AS first_purchase_month_asof_cutoff,
  max(purchase_month) AS last_purchase_month_asof_cutoff, {', '.join(_WIN)},
  quantile_cont(gap_days, 0.5) AS median_purchase_interval_days_asof_cutoff,
  quantile_cont(gap_days, 0.75) - quantile_cont(gap_days, 0.25) AS purchase_interval_iqr_asof_cutoff,
  avg(gap_days) AS mean_purchase_interval_days_asof_cutoff, stddev_samp(gap_days) AS std_purchase_interval_days_asof_cutoff, mad(gap_days::DOUBLE) AS purchase_interval_mad_days_asof_cutoff,
  (stddev_samp(purchase_quantity_sum) / nullif(avg(purchase_quantity_sum), 0)) ** 2 AS cv2_quantity_asof_cutoff, {_LAST},
  last(last_order_phase_code_in_month ORDER BY purchase_month) AS last_order_phase_code_asof_cutoff,
  last(last_delivery_state_code_in_month ORDER BY purchase_month) AS last_delivery_state_code_asof_cutoff,
  last(last_order_failure_flag_in_month ORDER BY purchase_month) AS last_order_failure_flag_asof_cutoff
FROM emg JOIN cuts ON purchase_month <= cutoff_month GROUP BY ALL)
""")
cte("feat", """
SELECT *, CASE WHEN cold_start_flag THEN 'cold_start'
    WHEN adi_asof_cutoff <= 1.32 AND cv2_quantity_asof_cutoff <= 0.49 THEN 'smooth'
    WHEN adi_asof_cutoff <= 1.32 AND cv2_quantity_asof_cutoff > 0.49 THEN 'erratic'
    WHEN adi_asof_cutoff > 1.32 AND cv2_quantity_asof_cutoff <= 0.49 THEN 'intermittent'
    WHEN adi_asof_cutoff > 1.32 AND cv2_quantity_asof_cutoff > 0.49 THEN 'lumpy' ELSE 'unknown' END AS demand_shape_label
FROM (SELECT *, active_month_count_asof_cutoff / months_observed_asof_cutoff AS active_month_ratio_asof_cutoff,
  months_observed_asof_cutoff / active_month_count_asof_cutoff AS adi_asof_cutoff,
  (purchase_count_asof_cutoff < 3 OR active_month_count_asof_cutoff < 2 OR months_observed_asof_cutoff < 3) AS cold_start_flag,
  least(purchase_count_asof_cutoff / 12, 1.0) AS confidence_score,
  CASE WHEN purchase_count_asof_cutoff < 3 OR active_month_count_asof_cutoff < 2 OR months_observed_asof_cutoff < 3 THEN 'history_insufficient'
    WHEN purchase_count_asof_cutoff >= 6 AND active_month_count_asof_cutoff >= 4 AND months_observed_asof_cutoff >= 12 THEN 'history_sufficient'
    ELSE 'history_medium' END AS history_sufficiency_flag,
  purchase_amount_sum_last_12m_asof_cutoff / 12 AS historical_avg_monthly_amount_asof_cutoff,
  purchase_quantity_sum_last_12m_asof_cutoff / 12 AS historical_avg_monthly_quantity_asof_cutoff,
  active_month_count_asof_cutoff = 1 AS one_shot_flag,
  manufacturer_code || '|' || hospital_code || '|' || drug_group AS entity_id
FROM seen WHERE sample_class <> 'unmonitorable')
""")


def pr(value: str, by: str = "cutoff_month") -> str:
    """Average percent rank in SQL; null for a null value."""
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"CASE WHEN {value} IS NULL THEN NULL ELSE (rank() OVER ({part} ORDER BY {value} NULLS LAST) "
        f"+ (count(*) OVER ({part + ',' if part else 'PARTITION BY'} {value}) - 1) / 2.0) / count({value}) OVER ({part}) END"
    )


cte("featb", """
SELECT *, CAST(months_since_last_purchase_asof_cutoff AS DOUBLE) AS recency_only_baseline,
  1.0 - (order_count_last_3m_asof_cutoff / 3.0) / nullif(order_count_last_12m_asof_cutoff / 12.0, 0) AS frequency_decay_baseline,
  months_since_last_purchase_asof_cutoff / CASE WHEN median_purchase_interval_days_asof_cutoff > 0 THEN median_purchase_interval_days_asof_cutoff / 30.4375 END AS interval_overdue_baseline,
  (order_count_last_3m_asof_cutoff / 3.0) / nullif(order_count_last_12m_asof_cutoff / 12.0, 0) AS frequency_ratio,
  purchase_quantity_sum_last_3m_asof_cutoff / nullif(purchase_quantity_sum_last_12m_asof_cutoff / 4.0, 0) AS quantity_ratio
FROM feat
""")
cte("featx", f"""
SELECT *, entity_id || '|' || horizon AS candidate_id, historical_avg_monthly_amount_asof_cutoff * h AS value_at_risk_proxy,
  least(greatest(0.35 * least(greatest(months_since_last_purchase_asof_cutoff, 0), 24) / 24
    + 0.25 * least(greatest(coalesce(interval_overdue_baseline, 0), 0), 4) / 4
    + 0.20 * (1 - least(greatest(coalesce(frequency_ratio, 1), 0), 1))
    + 0.20 * (1 - least(greatest(coalesce(quantity_ratio, 1), 0), 1)), 0.01), 0.99) AS churn_probability_H
FROM featb, (VALUES ('H3', 3), ('H6', 6), ('H12', 12)) t(horizon, h)
""")


def base(spark, sf):
    return A.asof_base(common.entity_month(spark, sf), CUTOFFS)


def feats(spark, sf, tiers=False, months=None):
    return A.cutoff_features(common.entity_month(spark, sf) if months is None else months, CUTOFFS, tiers=tiers)


def expand_scored(f):
    """Horizon-expanded features with baseline scores and the rule probability; no rank columns."""
    f = f.selectExpr(
        "*", "cast(months_since_last_purchase_asof_cutoff as double) as recency_only_baseline",
        "1.0D - (order_count_last_3m_asof_cutoff / 3.0D) / nullif(order_count_last_12m_asof_cutoff / 12.0D, 0D) as frequency_decay_baseline",
        """months_since_last_purchase_asof_cutoff / if(median_purchase_interval_days_asof_cutoff > 0,
           median_purchase_interval_days_asof_cutoff / 30.4375D, null) as interval_overdue_baseline""",
    ).withColumn("current_interval_over_median", F.col("interval_overdue_baseline"))
    x = A.runtime_ratios(A.expand_horizons(f))
    return x.withColumn("churn_probability_H", scoring.rule_probability())


def scored(spark, sf, months=None):
    return expand_scored(feats(spark, sf, months=months))


@query("feature_candidate_universe", """
SELECT s.manufacturer_code, s.hospital_code, s.drug_group, s.cutoff_month, first_purchase_month_asof_cutoff AS first_purchase_month,
  last_purchase_month_asof_cutoff, months_since_last_purchase_asof_cutoff AS months_since_last_purchase, 'monitorable' AS candidate_policy
FROM seen s WHERE months_since_last_purchase_asof_cutoff <= 12
""")
def _(spark, sf):
    return A.candidate_universe(common.events(spark, sf), CUTOFFS)


@query("feature_candidate_report", """
SELECT cutoff_month, count(*) AS all_seen_entity_count, count(*) FILTER (months_since_last_purchase_asof_cutoff <= 12) AS monitorable_entity_count,
  count(*) FILTER (months_since_last_purchase_asof_cutoff > 12) AS excluded_by_monitor_gap_count FROM seen GROUP BY cutoff_month
""")
def _(spark, sf):
    return A.candidate_report(A.candidate_universe(common.events(spark, sf), CUTOFFS, "all_seen"))


_COUNTERS = [
    "purchase_count_asof_cutoff", "active_month_count_asof_cutoff", "first_purchase_month_asof_cutoff",
    "last_purchase_month_asof_cutoff", "months_since_last_purchase_asof_cutoff",
    "months_since_first_purchase_asof_cutoff", "months_observed_asof_cutoff", "sample_class",
]


@query("feature_asof_counters", f"SELECT {', '.join(KEY + _COUNTERS)} FROM seen")
def _(spark, sf):
    return base(spark, sf).select(*KEY, *_COUNTERS)


@query("feature_scope_report", """
SELECT cutoff_month, count(*) AS all_seen_entity_count, count(*) FILTER (sample_class <> 'unmonitorable') AS monitorable_entity_count,
  count(*) FILTER (sample_class = 'unmonitorable') AS excluded_by_monitor_gap_count, count(*) FILTER (sample_class = 'one_shot') AS one_shot_entity_count,
  count(*) FILTER (sample_class = 'recurring') AS recurring_entity_count FROM seen GROUP BY cutoff_month
""")
def _(spark, sf):
    return A.scope_report(base(spark, sf))


@query("feature_unmonitorable_audit", f"""
SELECT {', '.join(KEY + _COUNTERS[:5] + _COUNTERS[6:])} FROM seen WHERE sample_class = 'unmonitorable'
""")
def _(spark, sf):
    return A.unmonitorable_audit(base(spark, sf))


_WINDOW_COLS = [f"{c}_last_{m}m_asof_cutoff" for m in (1, 3, 6, 12) for c in [*A.WINDOW_MEASURES, "active_months"]]


def _window_sql(c):
    if "amount" in c:
        return f"{rnd(c, 4)} AS {c}"
    if "quantity" in c:
        return f"CAST({c} AS DOUBLE) AS {c}"
    return f"CAST({c} AS BIGINT) AS {c}"


@query("feature_trailing_windows", f"SELECT {', '.join(KEY)}, {', '.join(_window_sql(c) for c in _WINDOW_COLS)} FROM feat")
def _(spark, sf):
    return round_all(feats(spark, sf).select(*KEY, *_WINDOW_COLS), 4)


_STATUS = [
    "province_code", "city_code", "county_code", "hospital_level_code", "ownership_type_code", "drug_category_code",
    "last_order_phase_code_asof_cutoff", "last_delivery_state_code_asof_cutoff", "last_order_failure_flag_asof_cutoff",
]


@query("feature_latest_status", "SELECT " + ", ".join(KEY + _STATUS[:6]) + ", " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in _STATUS[6:8]) + ", last_order_failure_flag_asof_cutoff FROM seen")
def _(spark, sf):
    return base(spark, sf).select(*KEY, *_STATUS)


_INTERVAL = [
    "median_purchase_interval_days_asof_cutoff", "mean_purchase_interval_days_asof_cutoff",
    "std_purchase_interval_days_asof_cutoff", "purchase_interval_iqr_asof_cutoff",
]


@query("feature_interval_statistics", f"SELECT {', '.join(KEY)}, {', '.join(rnd(c) + ' AS ' + c for c in _INTERVAL)} FROM seen")
def _(spark, sf):
    return round_all(base(spark, sf).select(*KEY, *_INTERVAL))


_DEMAND = ["active_month_ratio_asof_cutoff", "adi_asof_cutoff", "cv2_quantity_asof_cutoff", "confidence_score"]


@query("feature_demand_shape", f"""
SELECT {', '.join(KEY)}, {', '.join(rnd(c) + ' AS ' + c for c in _DEMAND)}, cold_start_flag, demand_shape_label, history_sufficiency_flag FROM feat
""")
def _(spark, sf):
    return round_all(feats(spark, sf).select(*KEY, *_DEMAND, "cold_start_flag", "demand_shape_label", "history_sufficiency_flag"))


@query("feature_demand_profile_research", f"""
WITH g AS (SELECT *, ((year(purchase_month) - year(p)) * 12 + month(purchase_month) - month(p)) * 30.4375::DOUBLE AS gap FROM (
  SELECT *, lag(purchase_month) OVER (PARTITION BY manufacturer_code, hospital_code, drug_group ORDER BY purchase_month) AS p FROM em)),
a AS (SELECT manufacturer_code, hospital_code, drug_group, cutoff_month, CAST(sum(order_count) AS BIGINT) AS n, count(*) AS a,
  ((year(cutoff_month) - year(min(purchase_month))) * 12 + month(cutoff_month) - month(min(purchase_month))) + 1 AS m, quantile_cont(gap, 0.5) AS med, avg(gap) AS mean, stddev_pop(gap) AS sd,
  quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25) AS iqr,
  (stddev_pop(purchase_quantity_sum) / nullif(avg(purchase_quantity_sum), 0)) ** 2 AS cv2
  FROM g JOIN cuts ON purchase_month <= cutoff_month GROUP BY manufacturer_code, hospital_code, drug_group, cutoff_month)
SELECT manufacturer_code, hospital_code, drug_group, cutoff_month, n AS purchase_count_asof_cutoff, a AS active_month_count_asof_cutoff,
  m AS months_observed_asof_cutoff, {rnd('med')} AS median_purchase_interval_days_asof_cutoff, {rnd('mean')} AS mean_purchase_interval_days_asof_cutoff,
  {rnd('sd')} AS std_purchase_interval_days_asof_cutoff, {rnd('iqr')} AS purchase_interval_iqr_asof_cutoff, {rnd('cv2')} AS cv2_quantity_asof_cutoff,
  {rnd('m / a')} AS adi_asof_cutoff, {rnd('a / m')} AS active_month_ratio_asof_cutoff, (n < 3 OR a < 2 OR m < 3) AS cold_start_flag,
  {rnd('least(1.0, n / 12)')} AS confidence_score, CASE WHEN n < 3 OR a < 2 OR m < 3 THEN 'cold_start'
   WHEN m / a <= 1.32 THEN CASE WHEN cv2 <= 0.49 THEN 'smooth' ELSE 'erratic' END
   WHEN cv2 <= 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_pattern_type_asof_cutoff FROM a
""")
def _(spark, sf):
    return round_all(A.demand_profile(common.entity_month(spark, sf), CUTOFFS))


_HI = """
SELECT entity_id, cutoff_month, CASE WHEN one_shot_flag THEN 'one_shot' WHEN n < 3 OR a < 2 OR med IS NULL THEN 'history_insufficient'
    WHEN n >= 3 AND a >= 2 AND wild THEN 'history_medium' ELSE 'history_sufficient' END AS interval_flag,
  CASE WHEN one_shot_flag THEN 'one_shot_not_applicable_for_m3' WHEN med IS NULL THEN 'median_purchase_interval_missing'
    WHEN a < 2 THEN 'active_month_count_asof_cutoff_lt_2' WHEN n < 3 THEN 'purchase_count_asof_cutoff_lt_3'
    WHEN wild THEN 'interval_variance_or_cv2_high' ELSE 'entity_interval_available' END AS interval_reason,
  CASE WHEN n < 3 OR a < 2 THEN 'history_insufficient' WHEN m < 12 OR cv2 IS NULL THEN 'history_medium' ELSE 'history_sufficient' END AS observation_flag,
  CASE WHEN a < 2 THEN 'active_month_count_asof_cutoff_lt_2' WHEN n < 3 THEN 'purchase_count_asof_cutoff_lt_3'
    WHEN m < 12 OR cv2 IS NULL THEN 'short_months_observed_or_partial_interval_statistics'
    ELSE 'purchase_count>=3_and_active_month_count>=2' END AS observation_reason
FROM (SELECT *, purchase_count_asof_cutoff AS n, active_month_count_asof_cutoff AS a, months_observed_asof_cutoff AS m,
  median_purchase_interval_days_asof_cutoff AS med, cv2_quantity_asof_cutoff AS cv2,
  coalesce(median_purchase_interval_days_asof_cutoff > 0 AND std_purchase_interval_days_asof_cutoff / median_purchase_interval_days_asof_cutoff > 1, false)
  OR coalesce(median_purchase_interval_days_asof_cutoff > 0 AND purchase_interval_iqr_asof_cutoff / median_purchase_interval_days_asof_cutoff > 1, false)
  OR coalesce(cv2_quantity_asof_cutoff > 1, false) AS wild FROM feat)
"""


@query("feature_history_sufficiency", _HI)
def _(spark, sf):
    f1, r1 = shapes.history_interval()
    f2, r2 = shapes.history_observation()
    f = A.expand_horizons(feats(spark, sf), [3])
    return f.select(
        "entity_id", "cutoff_month", f1.alias("interval_flag"), r1.alias("interval_reason"),
        f2.alias("observation_flag"), r2.alias("observation_reason"),
    )


@query("feature_choice_context", f"""
WITH p AS (SELECT hospital_code, drug_group, cutoff_month, CAST(sum(purchase_count_asof_cutoff) AS BIGINT) AS t, count(DISTINCT manufacturer_code) AS k,
  CAST(sum(order_count_last_12m_asof_cutoff) AS BIGINT) AS t12, CAST(sum(order_count_last_3m_asof_cutoff) AS BIGINT) AS t3 FROM seen GROUP BY ALL)
SELECT f.manufacturer_code, f.hospital_code, f.drug_group, f.cutoff_month, t AS hospital_drug_order_count_asof_cutoff,
  k AS hospital_drug_active_manufacturer_count_asof_cutoff, {rnd('purchase_count_asof_cutoff / t')} AS manufacturer_share_within_hospital_drug_asof_cutoff,
  CAST(t - purchase_count_asof_cutoff AS DOUBLE) AS competitor_order_count_asof_cutoff,
  CAST(t12 - order_count_last_12m_asof_cutoff AS DOUBLE) AS competitor_order_count_last_12m_asof_cutoff,
  CAST(t3 - order_count_last_3m_asof_cutoff AS DOUBLE) AS competitor_order_count_last_3m_asof_cutoff, k > 1 AS manufacturer_substitution_context_available
FROM feat f JOIN p USING (hospital_code, drug_group, cutoff_month)
""")
def _(spark, sf):
    b = base(spark, sf)
    out = A.choice_context(b.where(F.col("sample_class") != "unmonitorable"), b)
    return round_all(
        out.select(
            *KEY, "hospital_drug_order_count_asof_cutoff", "hospital_drug_active_manufacturer_count_asof_cutoff",
            "manufacturer_share_within_hospital_drug_asof_cutoff", "competitor_order_count_asof_cutoff",
            "competitor_order_count_last_12m_asof_cutoff", "competitor_order_count_last_3m_asof_cutoff",
            "manufacturer_substitution_context_available",
        )
    )


_VAR = ["historical_avg_monthly_amount_asof_cutoff", "historical_avg_monthly_quantity_asof_cutoff"]


@query("feature_value_at_risk", f"""
SELECT {', '.join(KEY)}, {', '.join(rnd(c, 6) + ' AS ' + c for c in _VAR)},
  {rnd('historical_avg_monthly_amount_asof_cutoff * 6', 6)} AS value_at_risk_amount_raw_H6_asof_cutoff,
  {rnd('greatest(historical_avg_monthly_amount_asof_cutoff * 12, 0)', 6)} AS value_at_risk_amount_nonnegative_H12_asof_cutoff,
  {rnd('greatest(historical_avg_monthly_quantity_asof_cutoff * 3, 0)', 6)} AS value_at_risk_quantity_nonnegative_H3_asof_cutoff,
  historical_avg_monthly_amount_asof_cutoff < 0 AS negative_value_at_risk_amount_flag FROM feat
""")
def _(spark, sf):
    return round_all(
        feats(spark, sf).select(
            *KEY, *_VAR, "value_at_risk_amount_raw_H6_asof_cutoff", "value_at_risk_amount_nonnegative_H12_asof_cutoff",
            "value_at_risk_quantity_nonnegative_H3_asof_cutoff", "negative_value_at_risk_amount_flag",
        ), 6,
    )


@query("feature_value_tier", f"""
SELECT {', '.join(KEY)}, CASE WHEN 3 * (r - 1) < n - 1 THEN 'low' WHEN 3 * (r - 1) < 2 * (n - 1) THEN 'mid' ELSE 'high' END AS entity_value_tier_asof_cutoff
FROM (SELECT *, row_number() OVER (PARTITION BY cutoff_month ORDER BY v, manufacturer_code, hospital_code, drug_group) AS r,
  count(*) OVER (PARTITION BY cutoff_month) AS n FROM (SELECT *, round(historical_avg_monthly_amount_asof_cutoff, 6) AS v FROM feat))
""")
def _(spark, sf):
    f = feats(spark, sf)
    c = "historical_avg_monthly_amount_asof_cutoff"
    return A.with_value_tier(f.withColumn(c, F.round(c, 6))).select(*KEY, "entity_value_tier_asof_cutoff")


@query("feature_baseline_scores", f"""
WITH s AS (SELECT *, round(interval_overdue_baseline, 8) AS o8, round(frequency_decay_baseline, 8) AS d8 FROM featb)
SELECT entity_id, cutoff_month, recency_only_baseline, {rnd('frequency_decay_baseline')} AS frequency_decay_baseline,
  {rnd('interval_overdue_baseline')} AS interval_overdue_baseline,
  {rnd(f"0.6 * ({pr('o8')}) + 0.25 * ({pr('d8')}) + 0.15 * ({pr('recency_only_baseline')})")} AS hybrid_interval_frequency_score
FROM s
""")
def _(spark, sf):
    f = A.baseline_scores(A.expand_horizons(feats(spark, sf), [3]))
    return round_all(
        f.select(
            "entity_id", "cutoff_month", "recency_only_baseline", "frequency_decay_baseline", "interval_overdue_baseline",
            "hybrid_interval_frequency_score",
        )
    )


@query("feature_runtime_sidecar", f"""
WITH x AS (SELECT * REPLACE (round(value_at_risk_proxy, 6) AS value_at_risk_proxy) FROM featx),
r AS (SELECT *, {pr('value_at_risk_proxy')} AS vr FROM x)
SELECT candidate_id, cutoff_month, {rnd('frequency_ratio', 6)} AS frequency_ratio, {rnd('quantity_ratio', 6)} AS quantity_ratio,
  {rnd('value_at_risk_proxy', 6)} AS value_at_risk_proxy, CASE WHEN vr <= 0.5 THEN 'low' WHEN vr <= 0.8 THEN 'medium' ELSE 'high' END AS potential_value_level,
  {rnd('CASE WHEN one_shot_flag THEN vr ELSE 0 END', 6)} AS one_shot_attention_score,
  CASE WHEN sample_class = 'recurring' THEN 'probability_allowed' ELSE 'hidden_one_shot' END AS probability_display_level FROM r
""")
def _(spark, sf):
    out = A.runtime_sidecar(A.expand_horizons(feats(spark, sf)))
    return round_all(
        out.select(
            "candidate_id", "cutoff_month", "frequency_ratio", "quantity_ratio", "value_at_risk_proxy",
            "potential_value_level", "one_shot_attention_score", "probability_display_level",
        ), 6,
    )


@query("feature_horizon_expansion", "SELECT candidate_id, entity_id, horizon, cutoff_month, sample_class FROM featx")
def _(spark, sf):
    return A.expand_horizons(feats(spark, sf)).select("candidate_id", "entity_id", "horizon", "cutoff_month", "sample_class")


@query("feature_status_rates", f"""
SELECT {', '.join(KEY)}, {rnd('failed_count_last_6m_asof_cutoff / nullif(order_count_last_6m_asof_cutoff, 0)')} AS failed_rate_last_6m_asof_cutoff,
  {rnd('received_count_last_6m_asof_cutoff / nullif(order_count_last_6m_asof_cutoff, 0)')} AS received_rate_last_6m_asof_cutoff FROM feat
""")
def _(spark, sf):
    return round_all(
        A.status_rates(feats(spark, sf)).select(*KEY, "failed_rate_last_6m_asof_cutoff", "received_rate_last_6m_asof_cutoff")
    )


@query("feature_coverage_completion", """
WITH b AS (SELECT DISTINCT manufacturer_code, hospital_code, drug_code AS drug_group FROM ord WHERE order_date <= DATE '2000-12-31'),
f AS (SELECT * FROM feat WHERE cutoff_month = DATE '2000-12-31')
SELECT b.manufacturer_code || '|' || b.hospital_code || '|' || b.drug_group AS entity_id, coalesce(purchase_count_asof_cutoff, 0) AS purchase_count_asof_cutoff,
  coalesce(active_month_count_asof_cutoff, 0) AS active_month_count_asof_cutoff, coalesce(one_shot_flag, false) AS one_shot_flag
FROM b LEFT JOIN f USING (manufacturer_code, hospital_code, drug_group)
""")
def _(spark, sf):
    f = A.expand_horizons(A.cutoff_features(common.entity_month(spark, sf), [common.CUTOFF], tiers=False), [3])
    e = facts.monthly_entities(common.orders(spark, sf), common.CUTOFF, common.CUTOFF, horizons=[3])
    out = A.coverage_completion(f, e.drop("cutoff_month", "cutoff_date"), [*ENTITY, "horizon"])
    return out.select("entity_id", "purchase_count_asof_cutoff", "active_month_count_asof_cutoff", "one_shot_flag")


_STAB = [
    "normalized_recency_by_adi", "normalized_recency_by_median_interval", "recency_excess_over_median_interval",
    "recency_ratio_to_months_observed", "frequency_decay_3m_vs_12m", "frequency_decay_6m_vs_12m",
    "frequency_decay_6m_vs_prior_6m",
]


@query("feature_stability", f"""
WITH s AS (SELECT *, months_since_last_purchase_asof_cutoff AS r, median_purchase_interval_days_asof_cutoff / 30.4375 AS med,
  months_observed_asof_cutoff AS m, order_count_last_3m_asof_cutoff AS o3, order_count_last_6m_asof_cutoff AS o6, order_count_last_12m_asof_cutoff AS o12 FROM feat)
SELECT {', '.join(KEY)}, {rnd('r / greatest(coalesce(adi_asof_cutoff, 1), 1)')} AS normalized_recency_by_adi,
  {rnd('r / greatest(coalesce(med, 1), 1)')} AS normalized_recency_by_median_interval, {rnd('r - med')} AS recency_excess_over_median_interval,
  {rnd('least(greatest(r / greatest(m, 1), 0), 20)')} AS recency_ratio_to_months_observed,
  {rnd('least((o3 / 3.0) / greatest(o12 / 12.0, 1e-9), 20)')} AS frequency_decay_3m_vs_12m,
  {rnd('least((o6 / 6.0) / greatest(o12 / 12.0, 1e-9), 20)')} AS frequency_decay_6m_vs_12m,
  {rnd('least((o6 / 6.0) / greatest(greatest(o12 - o6, 0) / 6.0, 1e-9), 20)')} AS frequency_decay_6m_vs_prior_6m,
  CASE WHEN m <= 6 THEN '0-6' WHEN m <= 12 THEN '7-12' WHEN m <= 24 THEN '13-24' WHEN m <= 60 THEN '25-60' ELSE '60+' END AS months_observed_bucket,
  CASE WHEN m >= 12 THEN 1.0 ELSE 0.0 END::DOUBLE AS cohort_maturity_flag,
  CASE WHEN adi_asof_cutoff IS NULL OR cv2_quantity_asof_cutoff IS NULL THEN '__MISSING__' WHEN adi_asof_cutoff < 1.32 AND cv2_quantity_asof_cutoff < 0.49 THEN 'smooth'
    WHEN adi_asof_cutoff < 1.32 THEN 'erratic' WHEN cv2_quantity_asof_cutoff < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_shape_label FROM s
""")
def _(spark, sf):
    return round_all(
        A.stability_features(feats(spark, sf)).select(
            *KEY, *_STAB, "months_observed_bucket", "cohort_maturity_flag", "demand_shape_label"
        )
    )


MODEL_COLUMNS = ["months_since_last_purchase_asof_cutoff", "adi_asof_cutoff", "purchase_count_asof_cutoff", "cold_start_flag", "province_code", "region_risk"]
MODEL_TYPES = {"months_since_last_purchase_asof_cutoff": "float", "adi_asof_cutoff": "float", "purchase_count_asof_cutoff": "int", "cold_start_flag": "bool", "province_code": "str", "region_risk": "float"}


@query("feature_model_frame", f"""
SELECT candidate_id, cutoff_month, CAST(months_since_last_purchase_asof_cutoff AS DOUBLE) AS months_since_last_purchase_asof_cutoff,
  {rnd('adi_asof_cutoff')} AS adi_asof_cutoff, purchase_count_asof_cutoff, cold_start_flag, province_code, 0.5::DOUBLE AS region_risk FROM featx
""")
def _(spark, sf):
    m = A.model_frame(A.expand_horizons(feats(spark, sf)), MODEL_COLUMNS, {"region_risk": 0.5}, MODEL_TYPES)
    return round_all(m.select(F.concat_ws("|", "entity_id", "horizon").alias("candidate_id"), "cutoff_month", *MODEL_COLUMNS))


@query("score_rule_baseline", f"SELECT candidate_id, cutoff_month, {rnd('churn_probability_H')} AS churn_probability_H, 'dry_run_only' AS score_caveat FROM featx")
def _(spark, sf):
    s = scoring.score_rule_baseline(scored(spark, sf))
    return round_all(s.select("candidate_id", "cutoff_month", "churn_probability_H", "score_caveat"))


LINEAR = {"months_since_last_purchase_asof_cutoff": 0.3, "order_count_last_3m_asof_cutoff": -0.8, "interval_overdue_baseline": 0.25}
_Z = "{b} + {k} * (0.3 * months_since_last_purchase_asof_cutoff - 0.8 * order_count_last_3m_asof_cutoff + 0.25 * coalesce(interval_overdue_baseline, 0))"


@query("score_linear", f"SELECT candidate_id, cutoff_month, {rnd('1 / (1 + exp(-(' + _Z.format(b=-1.0, k=1) + ')))')} AS churn_probability_H FROM featx")
def _(spark, sf):
    s = scoring.score_linear(scored(spark, sf), -1.0, LINEAR, "linear")
    return round_all(s.select("candidate_id", "cutoff_month", "churn_probability_H"))


@query("score_linear_per_horizon", f"""
SELECT candidate_id, cutoff_month, {rnd("CASE horizon WHEN 'H3' THEN 1 / (1 + exp(-(" + _Z.format(b=-0.5, k=1) + "))) WHEN 'H6' THEN 1 / (1 + exp(-(" + _Z.format(b=-1.0, k=0.5) + "))) ELSE 1 / (1 + exp(-(" + _Z.format(b=-1.5, k=0.25) + "))) END")} AS churn_probability_H FROM featx
""")
def _(spark, sf):
    models = {
        h: (b, {c: w * k for c, w in LINEAR.items()}) for h, b, k in [("H3", -0.5, 1), ("H6", -1.0, 0.5), ("H12", -1.5, 0.25)]
    }
    s = scoring.score_linear_per_horizon(scored(spark, sf), models, "linear")
    return round_all(s.select("candidate_id", "cutoff_month", "churn_probability_H"))


# Two text columns are declared as numbers: only figures among their values survive the type.
@query("quality_feature_parity", """
SELECT 'months_since_last_purchase_asof_cutoff' AS required_feature, count(*) FILTER (months_since_last_purchase_asof_cutoff IS NULL) AS missing_before,
  count(*) FILTER (months_since_last_purchase_asof_cutoff IS NULL) AS missing_after, 'runtime_generated' AS production_imputation, 'available_from_raw_feature_engineering' AS parity_status FROM feat
UNION ALL SELECT 'median_purchase_interval_days_asof_cutoff', count(*) FILTER (median_purchase_interval_days_asof_cutoff IS NULL), count(*) FILTER (median_purchase_interval_days_asof_cutoff IS NULL), 'runtime_generated', 'available_from_raw_feature_engineering' FROM feat
UNION ALL SELECT 'sample_class', count(*) FILTER (sample_class IS NULL), count(*) FILTER (TRY_CAST(sample_class AS DOUBLE) IS NULL), 'runtime_generated', 'available_from_raw_feature_engineering' FROM feat
UNION ALL SELECT 'province_code', count(*) FILTER (province_code IS NULL), count(*) FILTER (TRY_CAST(province_code AS DOUBLE) IS NULL), 'runtime_generated', 'available_from_raw_feature_engineering' FROM feat
UNION ALL SELECT 'region_risk', 0, 0, 'schema_default', 'generated_from_schema_default'
""")
def _(spark, sf):
    types = {"months_since_last_purchase_asof_cutoff": "int", "median_purchase_interval_days_asof_cutoff": "float", "sample_class": "float", "province_code": "int", "region_risk": "float"}
    return A.parity_report(feats(spark, sf), list(types), {"region_risk": 0.5}, types)
