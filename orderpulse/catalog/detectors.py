"""Snapshot, daily rule, result and config queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.catalog.common import OBSERVATION_DATES
from orderpulse.functions.exprs import round_all
from orderpulse.operators import detectors as D
from orderpulse.operators import snapshot as S
from orderpulse.schemas import ORDER_ENTITY
from orderpulse.session import cut_lineage

KEY = ["observation_date", *ORDER_ENTITY]
_K = "manufacturer_code, hospital_code, drug_code"
_OK = "observation_date, " + _K
cte("obs", "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in OBSERVATION_DATES) + ") t(observation_date)")
cte("pday", f"""
SELECT {_K}, order_date, sum(order_quantity) AS quantity, sum(order_amount) AS amount, min(order_id) AS first_id,
  order_date - lag(order_date) OVER (PARTITION BY {_K} ORDER BY order_date) AS gap FROM elig GROUP BY {_K}, order_date
""")
cte("hday", """
SELECT *, order_date > observation_date - 90 AS rec, order_date > observation_date - 365 AND order_date <= observation_date - 90 AS bas
FROM pday JOIN obs ON order_date <= observation_date
""")
cte("snapbase", f"""
WITH a AS (SELECT {_OK}, count(*) AS purchase_count_total, min(order_date) AS first_purchase_date, max(order_date) AS last_purchase,
  max(order_date) FILTER (order_date < observation_date) AS previous_purchase_date, quantile_cont(gap, 0.5) AS med,
  coalesce(sum(quantity) FILTER (rec), 0) AS recent_quantity, coalesce(sum(quantity) FILTER (bas), 0) AS baseline_quantity,
  coalesce(sum(amount) FILTER (rec), 0) AS recent_amount, coalesce(sum(amount) FILTER (bas), 0) AS baseline_amount,
  count(*) FILTER (rec) AS recent_order_count, count(*) FILTER (bas) AS baseline_order_count,
  max(first_id) FILTER (order_date = observation_date) AS current_order_id,
  sum(quantity) FILTER (order_date = observation_date) AS current_purchase_quantity
  FROM hday GROUP BY ALL),
m AS (SELECT {_OK.replace(', ', ', h.').replace('observation_date', 'h.observation_date')}, coalesce(quantile_cont(abs(gap - med), 0.5), 0) AS historical_interval_mad FROM hday h JOIN a USING ({_OK}) GROUP BY ALL),
mo AS (SELECT {_OK}, date_trunc('month', order_date) AS mon, sum(quantity) AS q FROM hday GROUP BY ALL),
s AS (SELECT {_OK}, count(*) AS active_month_count, min(mon) AS fm, avg(q) AS qm, coalesce(stddev_samp(q), 0) AS qs FROM mo GROUP BY ALL),
f AS (SELECT {_K}, first(order_id ORDER BY order_date, order_id, row_uid) AS first_order_id, first(order_quantity ORDER BY order_date, order_id, row_uid) AS first_purchase_quantity,
  first(order_amount ORDER BY order_date, order_id, row_uid) AS first_purchase_amount FROM elig GROUP BY ALL),
u AS (SELECT {_OK}, last(purchase_unit ORDER BY order_date, order_id, row_uid) FILTER (purchase_unit IS NOT NULL) AS purchase_unit,
  count(DISTINCT purchase_unit) AS entity_purchase_unit_count FROM elig JOIN obs ON order_date <= observation_date GROUP BY ALL)
SELECT *, coalesce(med, 0) AS historical_interval_median, observation_date - last_purchase AS days_since_last_purchase,
  observation_date - previous_purchase_date AS silence_days, current_order_id IS NOT NULL AS current_purchase_flag,
  recent_order_count / 3 AS recent_frequency, baseline_order_count / 9 AS purchase_frequency_baseline,
  recent_quantity / 3 / CASE WHEN baseline_quantity > 0 THEN baseline_quantity / 9 END AS quantity_ratio,
  recent_amount / 3 / CASE WHEN baseline_amount > 0 THEN baseline_amount / 9 END AS amount_ratio,
  recent_order_count / 3 / CASE WHEN baseline_order_count > 0 THEN baseline_order_count / 9 END AS frequency_ratio,
  (year(observation_date) - year(fm)) * 12 + month(observation_date) - month(fm) + 1 AS months_observed,
  ((year(observation_date) - year(fm)) * 12 + month(observation_date) - month(fm) + 1) / active_month_count AS adi,
  coalesce((qs / CASE WHEN qm > 0 THEN qm END) ** 2, 0) AS cv2_quantity,
  CASE WHEN ((year(observation_date) - year(fm)) * 12 + month(observation_date) - month(fm) + 1) / active_month_count < 1.32
    THEN CASE WHEN coalesce((qs / CASE WHEN qm > 0 THEN qm END) ** 2, 0) < 0.49 THEN 'smooth' ELSE 'erratic' END
    WHEN coalesce((qs / CASE WHEN qm > 0 THEN qm END) ** 2, 0) < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_shape_label
FROM a JOIN m USING ({_OK}) JOIN s USING ({_OK}) JOIN u USING ({_OK}) JOIN f USING ({_K})
""")
cte("cur", f"""
SELECT observation_date, {_K}, count(DISTINCT order_id) AS current_order_count, quantile_cont(purchase_unit_price, 0.5) AS current_unit_price
FROM elig JOIN obs ON order_date = observation_date GROUP BY ALL
""")
cte("ownp", f"""
SELECT *, recent_price AS median_price, max_price / CASE WHEN min_price > 0 THEN min_price END AS price_spread_ratio,
  recent_price / CASE WHEN baseline_price > 0 THEN baseline_price END AS price_ratio FROM (
SELECT observation_date, {_K}, purchase_unit,
  nullif(count(DISTINCT order_id) FILTER (order_date > observation_date - 90), 0) AS price_recent_order_count,
  nullif(count(DISTINCT order_id) FILTER (order_date <= observation_date - 90), 0) AS price_baseline_order_count,
  quantile_cont(purchase_unit_price, 0.5) FILTER (order_date > observation_date - 90) AS recent_price,
  quantile_cont(purchase_unit_price, 0.5) FILTER (order_date <= observation_date - 90) AS baseline_price,
  min(purchase_unit_price) FILTER (order_date > observation_date - 90) AS min_price,
  max(purchase_unit_price) FILTER (order_date > observation_date - 90) AS max_price
FROM elig JOIN obs ON order_date <= observation_date AND order_date > observation_date - 365
WHERE purchase_unit_price > 0 AND purchase_unit IS NOT NULL GROUP BY ALL)
""")
cte("mkt", """
SELECT observation_date, drug_code, purchase_unit, quantile_cont(purchase_unit_price, 0.05) AS market_reference_price,
  count(DISTINCT order_id) AS reference_order_count, count(DISTINCT hospital_code) AS reference_hospital_count
FROM elig JOIN obs ON order_date < observation_date WHERE purchase_unit_price > 0 AND purchase_unit IS NOT NULL GROUP BY ALL
""")
cte("snap", f"""
SELECT b.*, coalesce(current_order_count, 0) AS current_order_count, current_unit_price, price_recent_order_count, price_baseline_order_count, recent_price,
  baseline_price, median_price, min_price, max_price, price_spread_ratio, price_ratio, market_reference_price, reference_order_count, reference_hospital_count
FROM snapbase b LEFT JOIN cur USING ({_OK}) LEFT JOIN ownp USING ({_OK}, purchase_unit) LEFT JOIN mkt USING (observation_date, drug_code, purchase_unit)
""")

_MOD_DOWN = "CASE demand_shape_label WHEN 'smooth' THEN 1.0::DOUBLE WHEN 'erratic' THEN 0.85 WHEN 'intermittent' THEN 0.75 ELSE 0.65 END"
_MOD_UP = "CASE demand_shape_label WHEN 'smooth' THEN 1.0::DOUBLE WHEN 'erratic' THEN 1.15 WHEN 'intermittent' THEN 1.3 ELSE 1.5 END"
_Z = "CASE WHEN historical_interval_median > 0 THEN greatest((days_since_last_purchase - historical_interval_median) / greatest(historical_interval_mad, 3), 0) ELSE 0 END"
_UNIT = "WHEN entity_purchase_unit_count > 1 THEN 'multiple_purchase_units_for_entity' WHEN purchase_unit IS NULL THEN 'purchase_unit_missing'"
# rule: reason, hit, score, confidence, current, baseline, comparison, threshold, operator
_RULES = {
    "purchase_interval_ipi": (
        "CASE WHEN historical_interval_median <= 0 OR purchase_count_total < 4 THEN 'insufficient_history' END", f"({_Z}) >= 1.5",
        f"CASE WHEN ({_Z}) <= 1.5 THEN 0 ELSE least((({_Z}) - 1.5) / 2 * 100, 100) END", "purchase_count_total / 12",
        "days_since_last_purchase", "historical_interval_median", _Z, "1.5", "'>='"),
    "purchase_quantity_trend": (
        "CASE WHEN quantity_ratio IS NULL OR baseline_quantity < 1 THEN 'insufficient_history' END", f"quantity_ratio <= 0.6::DOUBLE * ({_MOD_DOWN})",
        f"(0.6::DOUBLE * ({_MOD_DOWN}) - quantity_ratio) / (0.6::DOUBLE * ({_MOD_DOWN})) * 100", "purchase_count_total / 6",
        "recent_quantity", "baseline_quantity", "quantity_ratio", f"0.6::DOUBLE * ({_MOD_DOWN})", "'<='"),
    "purchase_quantity_spike": (
        "CASE WHEN quantity_ratio IS NULL OR baseline_quantity < 1 THEN 'insufficient_history' END", f"quantity_ratio >= 3.0::DOUBLE * ({_MOD_UP})",
        f"(quantity_ratio / (3.0::DOUBLE * ({_MOD_UP})) - 1) * 100", "purchase_count_total / 6",
        "recent_quantity", "baseline_quantity", "quantity_ratio", f"3.0::DOUBLE * ({_MOD_UP})", "'>='"),
    "purchase_frequency_drop": (
        "CASE WHEN frequency_ratio IS NULL OR purchase_frequency_baseline < 1 THEN 'insufficient_history' END", f"frequency_ratio <= 0.6::DOUBLE * ({_MOD_DOWN})",
        f"(0.6::DOUBLE * ({_MOD_DOWN}) - frequency_ratio) / (0.6::DOUBLE * ({_MOD_DOWN})) * 100", "purchase_frequency_baseline / 2",
        "recent_frequency", "purchase_frequency_baseline", "frequency_ratio", f"0.6::DOUBLE * ({_MOD_DOWN})", "'<='"),
    "purchase_frequency_spike": (
        "CASE WHEN frequency_ratio IS NULL OR purchase_frequency_baseline < 1 THEN 'insufficient_history' END", f"frequency_ratio >= 2.0::DOUBLE * ({_MOD_UP})",
        f"(frequency_ratio / (2.0::DOUBLE * ({_MOD_UP})) - 1) * 100", "purchase_frequency_baseline / 2",
        "recent_frequency", "purchase_frequency_baseline", "frequency_ratio", f"2.0::DOUBLE * ({_MOD_UP})", "'>='"),
    "low_price_warning": (
        f"""CASE {_UNIT} WHEN NOT current_purchase_flag THEN 'no_purchase_on_observation_date' WHEN coalesce(current_unit_price, 0) <= 0 THEN 'purchase_unit_price_missing_or_nonpositive'
          WHEN coalesce(reference_order_count, 0) < 30 OR coalesce(reference_hospital_count, 0) < 5 THEN 'insufficient_reference'
          WHEN coalesce(market_reference_price, 0) <= 0 THEN 'threshold_missing' END""",
        "current_unit_price < market_reference_price", "(market_reference_price - current_unit_price) / market_reference_price * 100", "reference_order_count / 100",
        "current_unit_price", "market_reference_price", "current_unit_price / market_reference_price", "market_reference_price", "'<'"),
    "order_price_spread_warning": (
        f"CASE {_UNIT} WHEN coalesce(median_price, 0) <= 0 THEN 'purchase_unit_price_missing_or_nonpositive' WHEN coalesce(price_recent_order_count, 0) < 2 OR price_spread_ratio IS NULL THEN 'insufficient_history' END",
        "price_spread_ratio >= 1.8", "(price_spread_ratio / 1.8 - 1) * 100", "price_recent_order_count / 10",
        "max_price", "min_price", "price_spread_ratio", "1.8", "'>='"),
    "purchase_price_level_shift": (
        f"""CASE {_UNIT} WHEN coalesce(recent_price, 0) <= 0 THEN 'purchase_unit_price_missing_or_nonpositive'
          WHEN coalesce(price_recent_order_count, 0) < 2 OR coalesce(price_baseline_order_count, 0) < 5 OR price_ratio IS NULL THEN 'insufficient_history' END""",
        "(price_ratio >= 1.25 OR price_ratio <= 0.8)", "CASE WHEN price_ratio >= 1.25 OR price_ratio <= 0.8 THEN abs(ln(price_ratio)) * 100 ELSE 0 END",
        "(coalesce(price_recent_order_count, 0) + coalesce(price_baseline_order_count, 0)) / 20",
        "recent_price", "baseline_price", "price_ratio", "CASE WHEN price_ratio >= 1.25 THEN 1.25 ELSE 0.8 END", "CASE WHEN price_ratio >= 1.25 THEN '>=' ELSE '<=' END"),
    "first_purchase_fact": (
        "CASE WHEN first_purchase_date <> observation_date THEN 'no_first_purchase_on_observation_date' END", "true", "100", "1.0",
        "1.0", "NULL", "NULL", "1.0", "'fact'"),
    "reactivated_purchase_fact": (
        "CASE WHEN NOT current_purchase_flag THEN 'no_purchase_on_observation_date' WHEN silence_days IS NULL THEN 'no_previous_purchase' END",
        "silence_days > 180", "(silence_days / 180 - 1) * 100", "1.0", "silence_days", "180", "silence_days", "180", "'>'"),
}


def _rule_sql(d: str) -> str:
    reason, hit, score, conf, cur, base, comp, thr, op = _RULES[d]
    ok = lambda e: f"CASE WHEN r IS NULL THEN CAST({e} AS DOUBLE) END"
    return f"""SELECT {_OK}, purchase_unit, demand_shape_label, '{d}' AS detector_id, r IS NULL AND coalesce(h, false) AS hit_flag,
  CASE WHEN r IS NOT NULL THEN 'not_evaluable' WHEN s >= 80 THEN 'high' WHEN s >= 40 THEN 'medium' WHEN h THEN 'low' ELSE 'stable' END AS severity,
  {ok(f'round(greatest(least({conf}, 1.0), 0), 4)')} AS confidence,
  CASE WHEN r IS NULL THEN 'applicable' WHEN r = 'insufficient_reference' THEN r ELSE 'inapplicable' END AS eligibility_status, r AS inapplicable_reason,
  {ok(cur)} AS current_value, {ok(base)} AS baseline_value, {ok(comp)} AS comparison_value, {ok(thr)} AS threshold_value, CASE WHEN r IS NULL THEN {op} END AS threshold_operator
  FROM (SELECT *, {reason} AS r, {hit} AS h, least(greatest({score}, 0), 100) AS s FROM snap)"""


cte("res", "\nUNION ALL ".join(_rule_sql(d) for d in _RULES))


def snap(spark, sf):
    return S.detector_snapshot(common.eligible(spark, sf), OBSERVATION_DATES)


def results(spark, sf, detectors=None):
    return D.detector_results(snap(spark, sf), detectors)


def _base(spark, sf):
    return S.base_snapshot(S.prepared(common.eligible(spark, sf)), OBSERVATION_DATES)


def _snap_query(name, cols, digits=8, src=_base, table="snapbase"):
    """Register one group of snapshot columns; a column may carry a SQL type after a colon."""
    names = [c.split(":")[0] for c in cols]
    typed = []
    for c in cols:
        n, _, t = c.partition(":")
        typed.append(f"{rnd(n, digits)} AS {n}" if t == "f" else f"CAST({n} AS BIGINT) AS {n}" if t == "i" else n)
    sql = f"SELECT {_OK}, {', '.join(typed)} FROM {table}"

    @query(name, sql)
    def _(spark, sf):
        return round_all(src(spark, sf).select(*KEY, *names), digits)


_snap_query("snapshot_asof_totals", ["purchase_unit", "entity_purchase_unit_count:i", "purchase_count_total:i", "first_purchase_date", "last_purchase", "days_since_last_purchase:i"])
_snap_query("snapshot_gap_median_mad", ["historical_interval_median:f", "historical_interval_mad:f"])
_snap_query("snapshot_windows", ["recent_quantity:f", "baseline_quantity:f", "recent_amount:f", "baseline_amount:f", "recent_order_count:i", "baseline_order_count:i"], 4)
_snap_query("snapshot_rate_ratios", ["recent_frequency:f", "purchase_frequency_baseline:f", "quantity_ratio:f", "amount_ratio:f", "frequency_ratio:f"])
_snap_query("snapshot_first_purchase", ["first_order_id", "first_purchase_quantity:f", "first_purchase_amount:f"], 4)
_snap_query("snapshot_silence", ["previous_purchase_date", "silence_days:i", "current_purchase_flag", "current_order_id", "current_purchase_quantity:f"])
_snap_query("snapshot_demand_shape", ["active_month_count:i", "months_observed:i", "adi:f", "cv2_quantity:f", "demand_shape_label"])


@query("snapshot_current_day", f"SELECT {_OK}, current_order_count, {rnd('current_unit_price')} AS current_unit_price FROM cur")
def _(spark, sf):
    return round_all(S.current_facts(S.prepared(common.eligible(spark, sf)), OBSERVATION_DATES))


_OWN = ["recent_price", "baseline_price", "median_price", "min_price", "max_price", "price_spread_ratio", "price_ratio"]


@query("snapshot_own_price", f"SELECT {_OK}, purchase_unit, price_recent_order_count, price_baseline_order_count, {', '.join(rnd(c) + ' AS ' + c for c in _OWN)} FROM ownp")
def _(spark, sf):
    return round_all(S.own_price_evidence(S.prepared(common.eligible(spark, sf)), OBSERVATION_DATES))


@query("snapshot_market_reference", f"SELECT observation_date, drug_code, purchase_unit, {rnd('market_reference_price')} AS market_reference_price, reference_order_count, reference_hospital_count FROM mkt")
def _(spark, sf):
    return round_all(S.market_reference(S.prepared(common.eligible(spark, sf)), OBSERVATION_DATES))


_RES = ["confidence", "current_value", "baseline_value", "comparison_value", "threshold_value"]
_RES_TEXT = ["purchase_unit", "hit_flag", "severity", "eligibility_status", "inapplicable_reason", "threshold_operator"]


def _register_rule(d):
    @query(f"detector_{d}", f"""
SELECT {_OK}, {', '.join(_RES_TEXT)}, {', '.join(rnd(c, 6) + ' AS ' + c for c in _RES)} FROM res WHERE detector_id = '{d}'
""")
    def _(spark, sf):
        price = d in ("low_price_warning", "order_price_spread_warning", "purchase_price_level_shift")
        if price:
            source = snap(spark, sf)
        else:
            source = _base(spark, sf).withColumns({"drug_group": F.col("drug_code"), "data_history_start": F.lit(None).cast("date")})
        return round_all(D.detector_results(source, [d]).select(*KEY, *_RES_TEXT, *_RES), 6)


for _d in D.RULES:
    _register_rule(_d)


@query("detector_result_table", """
SELECT observation_date, detector_id, eligibility_status, severity, hit_flag, count(*) AS n, count(DISTINCT manufacturer_code || '|' || hospital_code || '|' || drug_code) AS entities
FROM res GROUP BY ALL
""")
def _(spark, sf):
    r = results(spark, sf)
    return r.groupBy("observation_date", "detector_id", "eligibility_status", "severity", "hit_flag").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(*ORDER_ENTITY).alias("entities")
    )


@query("detector_shape_modifier", f"""
SELECT demand_shape_label, ({_MOD_DOWN}) AS drop_modifier, ({_MOD_UP}) AS spike_modifier, count(*) AS n FROM snapbase GROUP BY ALL
""")
def _(spark, sf):
    b = _base(spark, sf)
    p, q = D.default_params("purchase_quantity_trend"), D.default_params("purchase_quantity_spike")
    return b.selectExpr(
        "demand_shape_label", f"{D.shape_modifier(p('demand_shape_modifiers'))} as drop_modifier",
        f"{D.shape_modifier(q('demand_shape_modifiers'))} as spike_modifier",
    ).groupBy("demand_shape_label", "drop_modifier", "spike_modifier").agg(F.count(F.lit(1)).alias("n"))


@query("detector_price_eligibility", f"""
SELECT observation_date, CASE {_UNIT} WHEN NOT current_purchase_flag THEN 'no_purchase_on_observation_date'
  WHEN coalesce(current_unit_price, 0) <= 0 THEN 'purchase_unit_price_missing_or_nonpositive' END AS reason, count(*) AS n
FROM snapbase LEFT JOIN cur USING ({_OK}) GROUP BY ALL
""")
def _(spark, sf):
    rows = S.prepared(common.eligible(spark, sf))
    s = S.base_snapshot(rows, OBSERVATION_DATES).join(S.current_facts(rows, OBSERVATION_DATES), KEY, "left")
    return s.selectExpr("observation_date", f"{D.price_reason('current_unit_price', True)} as reason").groupBy(
        "observation_date", "reason"
    ).agg(F.count(F.lit(1)).alias("n"))


cte("clue", f"""
WITH mon AS (SELECT manufacturer_code, hospital_code, drug_group AS drug_code, entity_id, max(churn_probability_H) AS p, max(value_at_risk_proxy) AS v
  FROM featx WHERE cutoff_month = DATE '2000-12-31' AND horizon = 'H6' AND sample_class = 'recurring' GROUP BY ALL),
h AS (SELECT r.*, CASE WHEN comparison_value IS NULL OR threshold_value IS NULL THEN 100
  WHEN threshold_operator IN ('>', '>=') THEN least(greatest((comparison_value / threshold_value - 1) * 100, 1), 100)
  WHEN threshold_operator IN ('<', '<=') THEN least(greatest((threshold_value - comparison_value) / abs(threshold_value) * 100, 1), 100) ELSE 100 END AS detector_score,
  m.entity_id AS risk_entity_id, m.p AS monthly_risk_probability, m.v AS monthly_loss_value
  FROM res r LEFT JOIN mon m USING ({_K}) WHERE hit_flag)
SELECT *, row_number() OVER (PARTITION BY observation_date ORDER BY round(detector_score, 6) * 100000 + coalesce(confidence, -1) * 0.01 DESC,
  'run|' || observation_date || '|' || detector_id || '|' || manufacturer_code || '|' || hospital_code || '|' || drug_code || '|' || coalesce(purchase_unit, '')) AS display_rank,
  risk_entity_id IS NOT NULL AS is_monthly_high_risk_entity FROM h
""")


def monthly_context(spark, sf):
    from orderpulse.catalog import features as FQ

    return cut_lineage(
        FQ.scored(spark, sf, common.settled_months(spark, sf, attributes=False))
        .where("cutoff_month = date'2000-12-31' and horizon = 'H6' and sample_class = 'recurring'")
        .groupBy("manufacturer_code", "hospital_code", F.col("drug_group").alias("drug_code"), F.col("entity_id").alias("risk_entity_id"))
        .agg(F.max("churn_probability_H").alias("monthly_risk_probability"), F.max("value_at_risk_proxy").alias("monthly_loss_value"))
    )


def results_once(spark, sf):
    """Rule results materialised: hits, ranks and summaries read them several times."""
    return cut_lineage(results(spark, sf))


def clue_table(spark, sf):
    return D.clues(results_once(spark, sf), monthly_context(spark, sf))


@query("detector_clues", f"""
SELECT {_OK}, detector_id, display_rank, {rnd('detector_score', 6)} AS detector_score, confidence, severity, risk_entity_id,
  is_monthly_high_risk_entity, {rnd('monthly_risk_probability', 6)} AS monthly_risk_probability, {rnd('monthly_loss_value', 6)} AS monthly_loss_value FROM clue
""")
def _(spark, sf):
    c = clue_table(spark, sf)
    c = round_all(c.select(*KEY, "detector_id", "display_rank", "detector_score", F.col("confidence").cast("decimal(6,4)").alias("confidence"), "severity", "risk_entity_id",
        "is_monthly_high_risk_entity", "monthly_risk_probability", "monthly_loss_value"), 6)
    return c.withColumn("confidence", F.col("confidence").cast("double"))


@query("detector_attached_evidence", f"""
SELECT risk_entity_id, observation_date, detector_id, {rnd('detector_score', 6)} AS detector_score FROM clue WHERE is_monthly_high_risk_entity
""")
def _(spark, sf):
    return round_all(D.attached_evidence(clue_table(spark, sf)).select("risk_entity_id", "observation_date", "detector_id", "detector_score"), 6)


@query("detector_run_summary", f"""
SELECT 'run' AS run_id, observation_date, count(DISTINCT ({_K})) AS scanned_entity_count, string_agg(DISTINCT detector_id, ',' ORDER BY detector_id) AS enabled_detectors,
  (SELECT count(*) FROM clue c WHERE c.observation_date = res.observation_date) AS clue_count,
  (SELECT count(*) FROM clue c WHERE c.observation_date = res.observation_date AND is_monthly_high_risk_entity) AS high_risk_clue_count
FROM res GROUP BY observation_date
""")
def _(spark, sf):
    r = results_once(spark, sf)
    return D.run_summary(r, D.clues(r, monthly_context(spark, sf)))


def profiles(spark, sf):
    m = common.orders(spark, sf).select("manufacturer_code").distinct()
    base = D.config_profiles(m)
    # Two generations for one rule: the older profile ends where the newer one starts.
    old = base.where("detector_id = 'purchase_interval_ipi'").withColumns(
        {"effective_to": F.to_date(F.lit("2000-09-30")), "config_id": F.concat("config_id", F.lit("-old"))}
    )
    new = base.where("detector_id = 'purchase_interval_ipi'").withColumn("effective_from", F.to_date(F.lit("2000-10-01")))
    retired = F.when((F.col("detector_id") == "low_price_warning") & (F.col("manufacturer_code") == "M03"), "retired").otherwise(F.col("status"))
    return base.where("detector_id <> 'purchase_interval_ipi'").unionByName(old).unionByName(new).withColumn("status", retired)


_PARAMS = {d: D._parameters_json(d) for d in D.RULES}
cte("prof", "\nUNION ALL ".join(
    f"""SELECT manufacturer_code, '{d}' AS detector_id, '{d}_v1' AS detector_version,
  sha256('{d}|{d}_v1|' || manufacturer_code || '|{p}') AS config_hash FROM maker WHERE manufacturer_code IN (SELECT DISTINCT manufacturer_code FROM ord)"""
    for d, p in _PARAMS.items()))
cte("rprof", """
SELECT o.observation_date, p.*, detector_id || '-' || manufacturer_code || '-' || substr(config_hash, 1, 12)
  || CASE WHEN detector_id = 'purchase_interval_ipi' AND observation_date <= DATE '2000-09-30' THEN '-old' ELSE '' END AS config_id
FROM prof p, obs o WHERE NOT (detector_id = 'low_price_warning' AND manufacturer_code = 'M03')
""")


@query("config_profiles", "SELECT manufacturer_code, detector_id, detector_version, config_hash FROM prof")
def _(spark, sf):
    m = common.orders(spark, sf).select("manufacturer_code")
    return D.config_profiles(m).select("manufacturer_code", "detector_id", "detector_version", "config_hash")


@query("config_resolution", "SELECT observation_date, manufacturer_code, detector_id, config_id FROM rprof")
def _(spark, sf):
    return D.resolve_profiles(profiles(spark, sf), OBSERVATION_DATES).select("observation_date", "manufacturer_code", "detector_id", "config_id")


@query("config_missing", """
SELECT observation_date, 'low_price_warning' AS detector_id, 'M03' AS manufacturer_code FROM obs WHERE EXISTS (SELECT 1 FROM ord WHERE manufacturer_code = 'M03')
""")
def _(spark, sf):
    p = profiles(spark, sf)
    return D.missing_profiles(D.resolve_profiles(p, OBSERVATION_DATES), common.orders(spark, sf), list(D.RULES), OBSERVATION_DATES)


@query("config_run_snapshot", "SELECT 'run' AS run_id, observation_date, detector_id, manufacturer_code, config_id, config_hash, detector_version FROM rprof")
def _(spark, sf):
    return D.run_config_snapshot(D.resolve_profiles(profiles(spark, sf), OBSERVATION_DATES), "run").select(
        "run_id", "observation_date", "detector_id", "manufacturer_code", "config_id", "config_hash", "detector_version"
    )


@query("detector_results_with_profiles", """
SELECT r.observation_date, r.detector_id, count(*) AS n, count(*) FILTER (p.config_id IS NOT NULL AND hit_flag) AS hits,
  count(*) FILTER (p.config_id IS NULL) AS config_missing
FROM res r LEFT JOIN rprof p ON r.observation_date = p.observation_date AND r.detector_id = p.detector_id AND r.manufacturer_code = p.manufacturer_code
GROUP BY r.observation_date, r.detector_id
""")
def _(spark, sf):
    resolved = D.resolve_profiles(profiles(spark, sf), OBSERVATION_DATES)
    r = D.detector_results(snap(spark, sf), profiles=resolved)
    return r.groupBy("observation_date", "detector_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit_flag").alias("hits"),
        F.count_if(F.col("eligibility_status") == "config_missing").alias("config_missing"),
    )


@query("quality_detector_component", """
SELECT r.observation_date, r.detector_id, count(*) AS result_count, count(*) FILTER (p.config_id IS NULL) AS config_missing_count,
  count(*) FILTER (p.config_id IS NOT NULL AND hit_flag) AS clue_count,
  CASE WHEN r.detector_id = 'low_price_warning' THEN 'config_missing_count,config_reference_missing,manufacturer_scope_mismatch' ELSE '' END AS failed_checks
FROM res r LEFT JOIN rprof p ON r.observation_date = p.observation_date AND r.detector_id = p.detector_id AND r.manufacturer_code = p.manufacturer_code
WHERE r.detector_id IN ('purchase_interval_ipi', 'low_price_warning', 'first_purchase_fact') GROUP BY r.observation_date, r.detector_id
""")
def _(spark, sf):
    resolved = D.resolve_profiles(profiles(spark, sf), OBSERVATION_DATES)
    some = ["purchase_interval_ipi", "low_price_warning", "first_purchase_fact"]
    resolved = resolved.where(F.col("detector_id").isin(some))
    r = cut_lineage(D.detector_results(snap(spark, sf), some, profiles=resolved))
    c = D.clues(r, monthly_context(spark, sf))
    return D.result_quality(r, c, resolved).select(
        "observation_date", "detector_id", "result_count", "config_missing_count", "clue_count",
        F.array_join("failed_checks", ",").alias("failed_checks"),
    )


@query("quality_detector_gate", """
SELECT * FROM (VALUES ('terminal_loss_warning', 'enabled_rule_v1', true), ('purchase_interval_overdue_warning', 'enabled_rule_v1', true),
 ('purchase_frequency_fluctuation_warning', 'enabled_rule_v1', true),
 ('purchase_quantity_fluctuation_warning', (SELECT CASE WHEN avg(CASE WHEN purchase_quantity_sum_last_3m_asof_cutoff IS NOT NULL THEN 1.0 ELSE 0 END) > 0.8 THEN 'weak_enabled_review_required' ELSE 'deferred_missing_data' END FROM feat), true),
 ('new_terminal_detection', 'enabled_rule_v1', true),
 ('delayed_response_warning', (SELECT CASE WHEN avg(CASE WHEN delivery_date >= order_date THEN 1.0 ELSE 0 END) >= 0.5 THEN 'enabled_rule_v1' ELSE 'deferred_missing_data' END FROM ord), false),
 ('rejection_response_warning', 'deferred_missing_data', false), ('low_delivery_rate_warning', 'interface_only', false),
 ('low_price_purchase_warning', 'weak_enabled_review_required', false), ('order_price_spread_warning', 'weak_enabled_review_required', false),
 ('sku_narrowing_warning', 'deferred_missing_mapping', false), ('wallet_share_decline_warning', 'deferred_missing_mapping', false),
 ('purchase_amount_trend_warning', 'internal_only', false)) t(detector_name, gate_status, enable_frontend_display)
""")
def _(spark, sf):
    from orderpulse.catalog import features as FQ
    from orderpulse.operators.features import expand_horizons, runtime_ratios

    f = runtime_ratios(expand_horizons(FQ.feats(spark, sf), [3]))
    late = common.orders(spark, sf).selectExpr(
        "if(delivery_date >= order_date, delivery_date, null) as delivery_date", "delivery_date as arrival_date"
    )
    return D.quality_gate(f, late, common.orders(spark, sf).select("purchase_unit_price"), {"enable_price_detectors": True})
