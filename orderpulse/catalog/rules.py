"""Order-level and unit-level rule queries (hospital x drug as the unit)."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.functions.exprs import round_all
from orderpulse.operators import order_rules as R
from orderpulse.operators import units as U
from orderpulse.operators.order_rules import UNIT
from orderpulse.sources import star

AS_OF = "2001-03-31"
ORIGINS = ["2000-06-30", "2001-03-31"]
_U = "org_code, product_line_code"
cte("uo", """
SELECT row_uid, order_id, hospital_code AS org_code, drug_code AS product_line_code, drug_code, sku_code, order_date, order_quantity AS purchase_qty,
  order_amount AS purchase_amount, purchase_unit_price / CASE WHEN conversion_factor > 0 THEN conversion_factor ELSE 1 END AS comparable_unit_price,
  conversion_factor, delivery_quantity AS delivery_qty, arrival_quantity AS receipt_qty, void_quantity AS void_qty, delivery_date,
  order_status_raw AS order_status, province_code FROM ord
""")


def unit_orders(spark, sf):
    return common.orders(spark, sf).selectExpr(
        "row_uid", "order_id", "hospital_code as org_code", "drug_code as product_line_code", "drug_code", "sku_code", "order_date",
        "order_quantity as purchase_qty", "order_amount as purchase_amount",
        "purchase_unit_price / if(conversion_factor > 0, conversion_factor, 1) as comparable_unit_price", "conversion_factor",
        "delivery_quantity as delivery_qty", "arrival_quantity as receipt_qty", "void_quantity as void_qty", "delivery_date",
        "order_status_raw as order_status", "province_code",
    )


@query("order_rule_low_price", f"""
SELECT row_uid, {rnd('comparable_unit_price')} AS comparable_unit_price, warning_price,
  {rnd('greatest(35, least(100, (warning_price - comparable_unit_price) / greatest(warning_price, 0.01) * 100))')} AS severity
FROM (SELECT *, CASE product_line_code WHEN 'Brand#5' THEN 300.0::DOUBLE WHEN 'Brand#9' THEN 50 ELSE 150 END AS warning_price FROM uo) WHERE comparable_unit_price < warning_price
""")
def _(spark, sf):
    r = R.low_price_orders(unit_orders(spark, sf), 150.0, {"Brand#5": 300.0, "Brand#9": 50.0})
    return round_all(r.select("row_uid", "comparable_unit_price", "warning_price", "severity"))


@query("order_rule_price_spread", f"""
WITH g AS (SELECT {_U}, min(comparable_unit_price) AS min_price, max(comparable_unit_price) AS max_price,
  string_agg(row_uid, ',' ORDER BY comparable_unit_price, row_uid) FILTER (rn <= 5) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY {_U} ORDER BY comparable_unit_price, row_uid) AS rn FROM uo) GROUP BY ALL)
SELECT {_U}, {rnd('min_price')} AS min_price, {rnd('max_price')} AS max_price, {rnd('max_price / min_price')} AS spread_ratio, samples,
  {rnd('least(100, greatest(45, (max_price / min_price / 1.8 - 1) * 80 + 45))')} AS severity FROM g WHERE max_price / min_price >= 1.8
""")
def _(spark, sf):
    r = R.price_spread_groups(unit_orders(spark, sf)).withColumn("samples", F.array_join("samples", ","))
    return round_all(r.select(*UNIT, "min_price", "max_price", "spread_ratio", "samples", "severity"))


_PAT = R.REFUSAL


@query("order_rule_delivery_refusal", f"""
SELECT {_U}, count(*) AS matched_order_count, count(*) FILTER (order_status = '拒收') AS refused FROM uo
WHERE regexp_matches(coalesce(order_status, ''), '{_PAT}') GROUP BY ALL
""")
def _(spark, sf):
    r = R.delivery_refusals(unit_orders(spark, sf))
    return r.select(*UNIT, "matched_order_count", F.coalesce(F.try_element_at("matched_statuses", F.lit("拒收")), F.lit(0)).alias("refused"))


@query("order_rule_low_delivery_rate", f"""
SELECT {_U}, {rnd('d / q')} AS delivery_rate, {rnd('least(100, greatest(35, (0.8 - d / q) / 0.8 * 100))')} AS severity
FROM (SELECT {_U}, sum(delivery_qty) AS d, sum(purchase_qty) AS q FROM uo GROUP BY ALL) WHERE q > 0 AND d / q < 0.8
""")
def _(spark, sf):
    return round_all(R.low_delivery_rate_groups(unit_orders(spark, sf)).select(*UNIT, "delivery_rate", "severity"))


@query("order_rule_delivery_delay", f"""
SELECT {_U}, count(*) AS late_orders, {rnd('quantile_cont(d, 0.5)')} AS median_delay_days, max(d) AS max_delay_days,
  {rnd('least(100, greatest(35, quantile_cont(d, 0.5) / 7 * 35))')} AS severity
FROM (SELECT *, delivery_date - order_date AS d FROM uo) WHERE d > 7 GROUP BY ALL
""")
def _(spark, sf):
    return round_all(R.delivery_delay_groups(unit_orders(spark, sf)).select(*UNIT, "late_orders", "median_delay_days", "max_delay_days", "severity"))


@query("order_rule_sales_fluctuation", f"""
WITH a AS (SELECT {_U}, coalesce(sum(purchase_qty) FILTER (order_date >= DATE '{AS_OF}' - 30), 0) / 30 AS rq, count(*) FILTER (order_date >= DATE '{AS_OF}' - 30) / 30 AS rf,
  coalesce(sum(purchase_qty) FILTER (order_date >= DATE '{AS_OF}' - 120 AND order_date < DATE '{AS_OF}' - 30), 0) / 90 AS bq,
  count(*) FILTER (order_date >= DATE '{AS_OF}' - 120 AND order_date < DATE '{AS_OF}' - 30) / 90 AS bf FROM uo GROUP BY ALL),
l AS (SELECT {_U}, 'purchase_qty_spike' AS detector_id, rq AS n, bq AS d FROM a WHERE bf > 0 UNION ALL SELECT {_U}, 'purchase_qty_drop', bq, rq FROM a WHERE bf > 0
  UNION ALL SELECT {_U}, 'purchase_freq_spike', rf, bf FROM a WHERE bf > 0 UNION ALL SELECT {_U}, 'purchase_freq_drop', bf, rf FROM a WHERE bf > 0),
r AS (SELECT *, CASE WHEN d > 0 THEN n / d WHEN detector_id LIKE '%drop' AND n > 0 THEN 18 END AS ratio FROM l)
SELECT {_U}, detector_id, {rnd('ratio')} AS ratio, ratio IS NOT NULL AS hit, {rnd('CASE WHEN ratio IS NULL THEN 0 ELSE least(100, greatest(35, (ratio / 1.8 - 1) * 60 + 45)) END')} AS severity
FROM r WHERE ratio IS NULL OR ratio >= 1.8
""")
def _(spark, sf):
    return round_all(R.sales_fluctuation(unit_orders(spark, sf), AS_OF).select(*UNIT, "detector_id", "ratio", "hit", "severity"))


@query("order_rule_low_delivery_rate_rows", f"""
SELECT row_uid, t AS threshold, {rnd('delivery_qty / purchase_qty')} AS delivery_rate, {rnd('least(100, (t - delivery_qty / purchase_qty) / t * 100)')} AS severity
FROM (SELECT *, CASE province_code WHEN '01' THEN 0.7::DOUBLE WHEN '02' THEN 0.9 ELSE 0.8 END AS t FROM uo) WHERE purchase_qty > 0 AND delivery_qty / purchase_qty < t
""")
def _(spark, sf):
    r = R.low_delivery_rate_orders(unit_orders(spark, sf), 0.8, {"01": 0.7, "02": 0.9})
    return round_all(r.select("row_uid", "threshold", "delivery_rate", "severity"))


@query("order_rule_delivery_delay_hours", f"""
SELECT row_uid, CAST((delivery_date - order_date) * 24 AS DOUBLE) AS delay_hours, {rnd('least(100, greatest(35, (delivery_date - order_date) * 24 / 48 * 35))')} AS severity
FROM uo WHERE (delivery_date - order_date) * 24 > 48
""")
def _(spark, sf):
    return round_all(R.delivery_delay_orders(unit_orders(spark, sf)).select("row_uid", "delay_hours", "severity"))


@query("order_rule_rejected_rows", "SELECT row_uid, order_status FROM uo WHERE regexp_matches(coalesce(order_status, ''), '拒收|撤销')")
def _(spark, sf):
    return R.rejected_orders(unit_orders(spark, sf), ["拒收", "撤销"]).select("row_uid", "order_status")


@query("order_rule_low_price_auto_mean", f"""
SELECT row_uid, {rnd('w', 4)} AS warning_price FROM uo, (SELECT avg(comparable_unit_price) * 0.9 AS w FROM uo WHERE comparable_unit_price > 0) WHERE comparable_unit_price < w
""")
def _(spark, sf):
    return round_all(R.low_price_auto(unit_orders(spark, sf)).select("row_uid", "warning_price"), 4)


@query("order_rule_low_price_auto_quantile", f"""
SELECT row_uid, {rnd('w')} AS warning_price FROM uo, (SELECT quantile_cont(comparable_unit_price, 0.1) AS w FROM uo WHERE comparable_unit_price > 0) WHERE comparable_unit_price < w
""")
def _(spark, sf):
    return round_all(R.low_price_auto(unit_orders(spark, sf), "quantile").select("row_uid", "warning_price"))


@query("order_rule_price_spread_by_line", f"""
SELECT product_line_code, {rnd('min(comparable_unit_price)')} AS min_price, {rnd('max(comparable_unit_price)')} AS max_price FROM uo GROUP BY ALL
HAVING max(comparable_unit_price) / min(comparable_unit_price) >= 1.8
""")
def _(spark, sf):
    r = R.price_spread_groups(unit_orders(spark, sf), by=["product_line_code"], samples=10)
    return round_all(r.select("product_line_code", "min_price", "max_price"))


@query("order_rule_terminal_lost", f"""
WITH d AS (SELECT {_U}, order_date, order_date - lag(order_date) OVER (PARTITION BY {_U} ORDER BY order_date) AS gap FROM (SELECT DISTINCT {_U}, order_date FROM uo)),
a AS (SELECT {_U}, max(order_date) AS last_order_date, avg(gap) AS c, count(gap) AS k FROM d GROUP BY ALL HAVING count(gap) > 0),
q AS (SELECT {_U}, avg(purchase_qty) AS avg_purchase_qty FROM uo GROUP BY ALL)
SELECT {_U}, last_order_date, {rnd('c')} AS avg_cycle, {rnd('avg_purchase_qty')} AS avg_purchase_qty, {rnd('c * 1.5')} AS threshold, DATE '{AS_OF}' + 120 - last_order_date AS days_since,
  {rnd(f"least(100, greatest(45, (DATE '{AS_OF}' + 120 - last_order_date) / greatest(c * 1.5, 1) * 40))")} AS severity
FROM a JOIN q USING ({_U}) WHERE DATE '{AS_OF}' + 120 - last_order_date > c * 1.5
""")
def _(spark, sf):
    r = R.terminal_lost(unit_orders(spark, sf), "2001-07-29")
    return round_all(r.select(*UNIT, "last_order_date", "avg_cycle", "avg_purchase_qty", "threshold", "days_since", "severity"))


@query("order_rule_new_terminal", f"""
WITH d AS (SELECT {_U}, order_date, lag(order_date) OVER (PARTITION BY {_U} ORDER BY order_date) AS prev FROM (SELECT DISTINCT {_U}, order_date FROM uo)),
m AS (SELECT {_U}, max(order_date) AS latest_order_date, last(prev ORDER BY order_date) AS prev FROM d GROUP BY ALL),
q AS (SELECT {_U}, order_date, last(purchase_qty ORDER BY row_uid) AS purchase_qty FROM uo GROUP BY ALL)
SELECT m.{_U.replace(', ', ', m.')}, latest_order_date, purchase_qty, latest_order_date - prev AS days_since_previous, purchase_qty >= 10 AS hit
FROM m JOIN q ON m.org_code = q.org_code AND m.product_line_code = q.product_line_code AND q.order_date = m.latest_order_date
WHERE latest_order_date >= DATE '2001-07-20' - 30 AND coalesce(latest_order_date - prev, 60) >= 60
""")
def _(spark, sf):
    r = R.new_terminal_or_comeback(unit_orders(spark, sf), "2001-07-20", comeback_days=60, min_qty=10.0)
    return r.select(*UNIT, "latest_order_date", "purchase_qty", "days_since_previous", "hit")


def _fluct(kind, value, spike):
    return f"""
WITH a AS (SELECT {_U}, coalesce(sum({value}) FILTER (order_date > DATE '{AS_OF}' - 60 AND order_date <= DATE '{AS_OF}'), 0) AS current_value,
  coalesce(sum({value}) FILTER (order_date > DATE '{AS_OF}' - 120 AND order_date <= DATE '{AS_OF}' - 60), 0) AS previous_value FROM uo GROUP BY ALL),
b AS (SELECT *, CASE WHEN previous_value > 0 THEN current_value / previous_value END AS ratio, CASE WHEN previous_value > 0 THEN (previous_value - current_value) / previous_value END AS dr FROM a)
SELECT {_U}, CAST(current_value AS DOUBLE) AS current_value, CAST(previous_value AS DOUBLE) AS previous_value, {rnd('ratio')} AS ratio,
  CASE WHEN dr >= 0.5 THEN 'SALES_{kind}_DROP' WHEN ratio >= {spike} THEN 'SALES_{kind}_SPIKE' WHEN ratio IS NOT NULL THEN 'SALES_{kind}_STABLE'
    WHEN current_value > 0 THEN 'SALES_{kind}_FROM_ZERO_BASELINE' ELSE 'SALES_{kind}_NO_ACTIVITY_BOTH_WINDOWS' END AS reason_code,
  {rnd(f"CASE WHEN dr >= 0.5 THEN least(100, greatest(45, dr * 100)) WHEN ratio >= {spike} THEN least(100, greatest(45, ratio * 20)) WHEN ratio IS NULL AND current_value > 0 THEN 45 ELSE 0 END")} AS severity
FROM b"""


@query("order_rule_quantity_fluctuation", _fluct("QTY", "purchase_qty", 3))
def _(spark, sf):
    r = R.adjacent_window_fluctuation(unit_orders(spark, sf), AS_OF, 60, "QTY")
    return round_all(r.select(*UNIT, "current_value", "previous_value", "ratio", "reason_code", "severity"))


@query("order_rule_frequency_fluctuation", _fluct("FREQ", "1", 2))
def _(spark, sf):
    r = R.adjacent_window_fluctuation(unit_orders(spark, sf), AS_OF, 60, "FREQ")
    return round_all(r.select(*UNIT, "current_value", "previous_value", "ratio", "reason_code", "severity"))


@query("unit_list", f"""
SELECT DISTINCT org_code, 'product_line' AS analysis_grain, product_line_code AS target_code FROM uo WHERE order_date <= DATE '{AS_OF}'
UNION SELECT DISTINCT org_code, 'sku', drug_code FROM uo WHERE order_date <= DATE '{AS_OF}'
""")
def _(spark, sf):
    return U.units_as_of(unit_orders(spark, sf), AS_OF)


_ORIG = ", ".join(f"(DATE '{o}')" for o in ORIGINS)
_SNAP_UNIT = [
    "days_since_last_purchase", "first_purchase_days_ago", "median_interval_days", "mean_interval_days", "std_interval_days", "last_interval_days",
    "interval_z_score", "overdue_ratio", "purchase_count_30d", "purchase_count_90d", "purchase_count_365d", "qty_60d", "qty_180d", "amount_90d",
    "active_days_365d", "refusal_status_count_90d", "qty_recent_vs_base_ratio", "amount_recent_vs_base_ratio", "freq_recent_vs_base_ratio",
    "avg_comparable_unit_price_90d", "min_comparable_unit_price_90d", "price_recent_vs_base_ratio", "delivery_rate_90d", "receipt_rate_90d",
    "sku_count_90d", "sku_count_365d", "sku_shrink_ratio",
]
_B = "order_date > o - 365 AND order_date <= o - 90"
cte("usnap", f"""
WITH e AS (SELECT * FROM uo, (VALUES {_ORIG}) t(o) WHERE purchase_qty > 0 AND coalesce(void_qty, 0) = 0 AND order_date <= o),
g AS (SELECT o, {_U}, order_date, order_date - lag(order_date) OVER (PARTITION BY o, {_U} ORDER BY order_date) AS gap FROM (SELECT DISTINCT o, {_U}, order_date FROM e)),
i AS (SELECT o, {_U}, quantile_cont(gap, 0.5) AS median_interval_days, avg(gap) AS mean_interval_days, stddev_samp(gap) AS std_interval_days,
  last(gap ORDER BY order_date) AS last_interval_days FROM g GROUP BY ALL),
a AS (SELECT o, {_U}, o - max(order_date) AS days_since_last_purchase, o - min(order_date) AS first_purchase_days_ago,
  count(*) FILTER (order_date > o - 30) AS purchase_count_30d, count(*) FILTER (order_date > o - 90) AS purchase_count_90d, count(*) FILTER (order_date > o - 365) AS purchase_count_365d,
  coalesce(sum(purchase_qty) FILTER (order_date > o - 60), 0) AS qty_60d, coalesce(sum(purchase_qty) FILTER (order_date > o - 180), 0) AS qty_180d,
  coalesce(sum(purchase_amount) FILTER (order_date > o - 90), 0) AS amount_90d, count(DISTINCT order_date) FILTER (order_date > o - 365) AS active_days_365d,
  count(*) FILTER (order_date > o - 90 AND regexp_matches(coalesce(order_status, ''), '{U.REFUSED}')) AS refusal_status_count_90d,
  sum(purchase_qty) FILTER (order_date > o - 90) / nullif(sum(purchase_qty) FILTER ({_B}), 0) AS qty_recent_vs_base_ratio,
  sum(purchase_amount) FILTER (order_date > o - 90) / nullif(sum(purchase_amount) FILTER ({_B}), 0) AS amount_recent_vs_base_ratio,
  count(*) FILTER (order_date > o - 90) / nullif(count(*) FILTER ({_B}), 0) AS freq_raw, avg(comparable_unit_price) FILTER (order_date > o - 90) AS avg_comparable_unit_price_90d,
  min(comparable_unit_price) FILTER (order_date > o - 90) AS min_comparable_unit_price_90d,
  avg(comparable_unit_price) FILTER (order_date > o - 90) / nullif(avg(comparable_unit_price) FILTER ({_B}), 0) AS price_recent_vs_base_ratio,
  sum(delivery_qty) FILTER (order_date > o - 90) / nullif(sum(purchase_qty) FILTER (order_date > o - 90), 0) AS delivery_rate_90d,
  sum(receipt_qty) FILTER (order_date > o - 90) / nullif(sum(purchase_qty) FILTER (order_date > o - 90), 0) AS receipt_rate_90d,
  count(DISTINCT sku_code) FILTER (order_date > o - 90) AS sku_count_90d, count(DISTINCT sku_code) FILTER (order_date > o - 365) AS sku_count_365d FROM e GROUP BY o, {_U})
SELECT o AS origin_date, *, (days_since_last_purchase - mean_interval_days) / nullif(std_interval_days, 0) AS interval_z_score,
  days_since_last_purchase / nullif(median_interval_days, 0) AS overdue_ratio, CASE WHEN purchase_count_90d > 0 THEN freq_raw END AS freq_recent_vs_base_ratio,
  (sku_count_365d - sku_count_90d) / nullif(sku_count_365d, 0) AS sku_shrink_ratio FROM a JOIN i USING (o, {_U})
""")
_INT = {"days_since_last_purchase", "first_purchase_days_ago", "last_interval_days", "purchase_count_30d", "purchase_count_90d", "purchase_count_365d",
        "active_days_365d", "refusal_status_count_90d", "sku_count_90d", "sku_count_365d"}


@query("unit_snapshot_features", f"SELECT origin_date, {_U}, " + ", ".join(c if c in _INT else f"{rnd(c, 6)} AS {c}" for c in _SNAP_UNIT) + " FROM usnap")
def _(spark, sf):
    return round_all(U.unit_snapshot(unit_orders(spark, sf), ORIGINS).select("origin_date", *UNIT, *_SNAP_UNIT), 6)


cte("utemp", f"""
WITH p AS (SELECT * FROM uo WHERE order_date <= DATE '{AS_OF}'),
g AS (SELECT {_U}, order_date - lag(order_date) OVER (PARTITION BY {_U} ORDER BY order_date) AS gap FROM (SELECT DISTINCT {_U}, order_date FROM p)),
m AS (SELECT {_U}, quantile_cont(gap, 0.5) AS historical_median_ipi FROM g WHERE gap > 0 GROUP BY ALL),
d AS (SELECT {_U}, quantile_cont(abs(gap - historical_median_ipi), 0.5) AS historical_mad_ipi FROM g JOIN m USING ({_U}) WHERE gap > 0 GROUP BY ALL),
a AS (SELECT {_U}, count(*) FILTER (order_date > DATE '{AS_OF}' - 90) AS recent_order_count,
  count(*) FILTER (order_date > DATE '{AS_OF}' - 365 AND order_date <= DATE '{AS_OF}' - 90) AS baseline_order_count,
  coalesce(sum(purchase_qty) FILTER (order_date > DATE '{AS_OF}' - 90), 0) AS recent_qty,
  coalesce(sum(purchase_qty) FILTER (order_date > DATE '{AS_OF}' - 365 AND order_date <= DATE '{AS_OF}' - 90), 0) AS baseline_qty,
  count(DISTINCT sku_code) FILTER (order_date > DATE '{AS_OF}' - 90) AS recent_active_sku_count,
  count(DISTINCT sku_code) FILTER (order_date > DATE '{AS_OF}' - 365 AND order_date <= DATE '{AS_OF}' - 90) AS baseline_active_sku_count,
  min(order_date) AS first_order_date, max(order_date) AS last_order_date, (DATE '{AS_OF}' - max(order_date))::DOUBLE AS inactive_days FROM p GROUP BY ALL)
SELECT *, recent_order_count > 0 AS has_recent_order, baseline_order_count > 0 AS has_baseline_order FROM a LEFT JOIN m USING ({_U}) LEFT JOIN d USING ({_U})
""")
_TEMP = ["recent_order_count", "baseline_order_count", "recent_active_sku_count", "baseline_active_sku_count", "first_order_date", "last_order_date", "has_recent_order", "has_baseline_order"]
_TEMPF = ["recent_qty", "baseline_qty", "inactive_days", "historical_median_ipi", "historical_mad_ipi"]


def temporal(spark, sf):
    return U.temporal_window(unit_orders(spark, sf), AS_OF)


@query("unit_temporal_window", f"SELECT {_U}, {', '.join(_TEMP)}, {', '.join(rnd(c) + ' AS ' + c for c in _TEMPF)} FROM utemp")
def _(spark, sf):
    return round_all(temporal(spark, sf).select(*UNIT, *_TEMP, *_TEMPF))


cte("ushape", f"""
WITH m AS (SELECT {_U}, date_trunc('month', order_date) AS m, sum(purchase_qty) AS q FROM uo WHERE order_date > DATE '{AS_OF}' - 365 AND order_date <= DATE '{AS_OF}' GROUP BY ALL),
a AS (SELECT {_U}, count(*) FILTER (q > 0) AS k, avg(q) FILTER (q > 0) AS mean, stddev_pop(q) FILTER (q > 0) AS sd FROM m GROUP BY ALL),
s AS (SELECT {_U}, CASE WHEN k >= 3 THEN 13 / k END AS adi, CASE WHEN k >= 3 THEN coalesce((sd / nullif(mean, 0)) ** 2, 0) END AS cv2,
  CASE WHEN k >= 3 THEN least(1, 0.45 + k / 12) ELSE 0.2 END::DOUBLE AS demand_shape_confidence FROM a)
SELECT *, CASE WHEN adi IS NULL THEN 'unknown' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_shape FROM s
""")


@query("unit_demand_shape", f"SELECT {_U}, {rnd('adi')} AS adi, {rnd('cv2')} AS cv2, {rnd('demand_shape_confidence')} AS demand_shape_confidence, demand_shape FROM ushape")
def _(spark, sf):
    return round_all(U.zero_filled_shape(unit_orders(spark, sf), AS_OF))


@query("unit_cohort_context", f"""
WITH c AS (SELECT {_U}, region_code || '|' || hospital_level AS cohort_key, recent_qty, baseline_qty FROM utemp JOIN hosp ON org_code = hospital_code),
m AS (SELECT cohort_key, count(*) AS cohort_size, quantile_cont(recent_qty, 0.5) AS r, quantile_cont(baseline_qty, 0.5) AS b FROM c GROUP BY ALL)
SELECT {_U}, cohort_key, cohort_size, {rnd('r')} AS cohort_recent_qty_median, {rnd('b')} AS cohort_baseline_qty_median FROM c JOIN m USING (cohort_key)
""")
def _(spark, sf):
    c = U.cohort_context(temporal(spark, sf).select(*UNIT, "recent_qty", "baseline_qty"), star.hospital_master(spark, sf))
    return round_all(c.select(*UNIT, "cohort_key", "cohort_size", "cohort_recent_qty_median", "cohort_baseline_qty_median"))


@query("unit_drug_grouping", f"""
SELECT DISTINCT u.org_code, u.product_line_code AS target_code, d.product_line_code, coalesce(d.product_line_name, u.product_line_code) AS product_line_name,
  CASE WHEN d.drug_code IS NULL THEN 'MISSING_DRUG_GROUP_MAPPING' ELSE '' END AS warnings
FROM uo u LEFT JOIN drug d ON u.product_line_code = d.drug_code WHERE order_date <= DATE '{AS_OF}'
""")
def _(spark, sf):
    units = U.units_as_of(unit_orders(spark, sf), AS_OF, ["sku"])
    g = U.drug_grouping(units, star.product_line_mapping(spark, sf))
    return g.select("org_code", "target_code", "product_line_code", "product_line_name", F.array_join("warnings", ",").alias("warnings"))


cte("usub", f"""
WITH j AS (SELECT t.*, d.product_line_code AS group_code FROM utemp t LEFT JOIN drug d ON t.product_line_code = d.drug_code),
g AS (SELECT org_code, group_code, sum(recent_qty) AS gr, sum(baseline_qty) AS gb, count(*) AS members FROM j WHERE group_code IS NOT NULL GROUP BY ALL)
SELECT org_code, product_line_code, recent_qty AS own_recent_qty, baseline_qty AS own_baseline_qty, coalesce(gr, recent_qty) AS same_group_recent_qty,
  coalesce(gb, baseline_qty) AS same_group_baseline_qty, coalesce(members - 1, 0) AS substitute_candidate_count,
  coalesce((gr - recent_qty) - (gb - baseline_qty), 0) AS substitute_qty_delta, CASE WHEN coalesce(members, 1) > 1 THEN 0.5 ELSE 0.1 END::DOUBLE AS substitution_feature_confidence
FROM j LEFT JOIN g USING (org_code, group_code)
""")


@query("unit_substitution_features", "SELECT * FROM usub")
def _(spark, sf):
    return U.substitution_features(temporal(spark, sf), star.product_line_mapping(spark, sf))


@query("unit_seasonality", f"""
SELECT {_U}, coalesce(sum(purchase_qty) FILTER (order_date > DATE '{AS_OF}' - 90 AND order_date <= DATE '{AS_OF}'), 0) AS current_period_qty,
  coalesce(sum(purchase_qty) FILTER (order_date > DATE '2000-03-31' - 90 AND order_date <= DATE '2000-03-31'), 0) AS same_period_last_year_qty,
  {rnd(f"coalesce(sum(purchase_qty) FILTER (order_date > DATE '{AS_OF}' - 90 AND order_date <= DATE '{AS_OF}'), 0) / nullif(sum(purchase_qty) FILTER (order_date > DATE '2000-03-31' - 90 AND order_date <= DATE '2000-03-31'), 0)")} AS yoy_qty_ratio
FROM uo GROUP BY ALL
""")
def _(spark, sf):
    return round_all(U.seasonality(unit_orders(spark, sf), AS_OF))


# Refill priors per product line: the median purchase gap over all hospitals, known for two thirds of the lines.
cte("uprior", f"""
SELECT product_line_code, quantile_cont(historical_median_ipi, 0.5) AS typical_refill_days FROM utemp
WHERE CAST(substr(product_line_code, 7) AS INTEGER) % 3 > 0 GROUP BY ALL
""")


def unit_table(spark, sf):
    t = temporal(spark, sf)
    priors = t.where("cast(substring(product_line_code, 7) as int) % 3 > 0").groupBy("product_line_code").agg(
        F.percentile("historical_median_ipi", 0.5).alias("typical_refill_days")
    )
    j = t.join(U.zero_filled_shape(unit_orders(spark, sf), AS_OF).drop("cv2"), UNIT, "left").join(
        U.substitution_features(t, star.product_line_mapping(spark, sf)), UNIT
    )
    return U.cycle_prior(j, priors).withColumn("demand_shape", F.coalesce("demand_shape", F.lit("unknown")))


@query("unit_cycle_prior", f"""
SELECT {_U}, {rnd('typical_refill_days')} AS typical_refill_days, CASE WHEN typical_refill_days IS NULL THEN 0 ELSE 0.5 END::DOUBLE AS cycle_prior_confidence
FROM utemp LEFT JOIN uprior USING (product_line_code)
""")
def _(spark, sf):
    return round_all(unit_table(spark, sf).select(*UNIT, "typical_refill_days", "cycle_prior_confidence"))


_TMC = "CASE WHEN demand_shape IN ('intermittent', 'lumpy') THEN 1.35::DOUBLE WHEN demand_shape = 'unknown' THEN 1.2 ELSE 1 END"
_CMC = "CASE WHEN demand_shape IN ('intermittent', 'lumpy') THEN 0.75::DOUBLE WHEN demand_shape = 'unknown' THEN 0.65 ELSE 1 END"
cte("urule", f"""
WITH t AS (SELECT *, {_TMC} AS tm, {_CMC} AS cm FROM (SELECT utemp.*, adi, coalesce(demand_shape, 'unknown') AS demand_shape, typical_refill_days, own_recent_qty, own_baseline_qty,
   same_group_recent_qty, same_group_baseline_qty, substitution_feature_confidence FROM utemp LEFT JOIN ushape USING ({_U}) LEFT JOIN uprior USING (product_line_code) JOIN usub USING ({_U}))),
v AS (SELECT *, greatest(30, greatest(coalesce(typical_refill_days, nullif(historical_median_ipi, 0), adi, 30), 1) * 1.5 * tm) AS lim,
  (inactive_days - historical_median_ipi) / (1.4826 * greatest(historical_mad_ipi, 1)) AS z, CASE WHEN typical_refill_days IS NOT NULL THEN greatest(typical_refill_days, 1) * 1.5 END AS cl,
  baseline_order_count / (275 / 30.4375) AS br, CASE WHEN baseline_order_count > 0 THEN (recent_order_count / (90 / 30.4375)) / (baseline_order_count / (275 / 30.4375)) END AS rr,
  CASE WHEN baseline_active_sku_count <= 0 THEN 0 ELSE greatest(0, (baseline_active_sku_count - recent_active_sku_count) / baseline_active_sku_count) END AS sh,
  CASE WHEN own_baseline_qty > 0 THEN own_recent_qty / own_baseline_qty ELSE 1 END AS orr, CASE WHEN same_group_baseline_qty > 0 THEN same_group_recent_qty / same_group_baseline_qty ELSE 1 END AS gr FROM t)
SELECT {_U}, 'inactive_terminal' AS detector_name, 'interval' AS family, false AS missing, inactive_days >= lim AS hit,
  CASE WHEN inactive_days >= lim THEN least(100, 45 + (inactive_days / lim - 1) * 55) ELSE greatest(0, inactive_days / lim * 30) END AS severity, CASE WHEN inactive_days >= lim THEN 0.85 ELSE 0.45 END * cm AS confidence FROM v
UNION ALL SELECT {_U}, 'ip_interval', 'interval', historical_median_ipi IS NULL, coalesce(z >= 2 * tm, false),
  CASE WHEN z >= 2 * tm THEN least(100, 35 + (z - 2 * tm) / greatest(3 * tm, 1) * 65) ELSE 0 END, CASE WHEN historical_median_ipi IS NULL THEN 0 WHEN z >= 2 * tm THEN 0.8 * cm ELSE 0.45 * cm END FROM v
UNION ALL SELECT {_U}, 'cycle_deviation', 'cycle', typical_refill_days IS NULL, coalesce(inactive_days >= cl, false),
  CASE WHEN inactive_days >= cl THEN least(100, 50 + (inactive_days / cl - 1) * 50) ELSE 0 END, CASE WHEN typical_refill_days IS NULL THEN 0 WHEN inactive_days >= cl THEN 0.4 ELSE 0.1 END FROM v
UNION ALL SELECT {_U}, 'frequency_drop', 'frequency', false, br >= 0.5 AND coalesce(rr, 1) < 0.6, CASE WHEN br >= 0.5 AND coalesce(rr, 1) < 0.6 THEN least(100, (1 - rr / 0.6) * 100) ELSE 0 END,
  CASE WHEN br >= 0.5 AND coalesce(rr, 1) < 0.6 THEN 0.82 ELSE 0.5 END FROM v
UNION ALL SELECT {_U}, 'sku_shrink', 'portfolio', false, baseline_active_sku_count >= 2 AND sh >= 0.34, CASE WHEN baseline_active_sku_count >= 2 AND sh >= 0.34 THEN least(100, sh * 100) ELSE 0 END,
  CASE WHEN baseline_active_sku_count >= 2 AND sh >= 0.34 THEN 0.8 ELSE 0.45 END FROM v
UNION ALL SELECT {_U}, 'new_terminal', 'new_terminal', false, has_recent_order AND NOT has_baseline_order, CASE WHEN has_recent_order AND NOT has_baseline_order THEN 42 ELSE 0 END,
  CASE WHEN has_recent_order AND NOT has_baseline_order THEN 0.9 ELSE 0.5 END FROM v
UNION ALL SELECT {_U}, 'substitution_risk', 'substitution', false, own_baseline_qty > 0 AND orr < 0.7 AND gr >= 0.9 AND substitution_feature_confidence >= 0.3,
  CASE WHEN own_baseline_qty > 0 AND orr < 0.7 AND gr >= 0.9 AND substitution_feature_confidence >= 0.3 THEN 55 ELSE 0 END,
  CASE WHEN own_baseline_qty > 0 AND orr < 0.7 AND gr >= 0.9 AND substitution_feature_confidence >= 0.3 THEN substitution_feature_confidence ELSE least(substitution_feature_confidence, 0.25) END FROM v
""")


def rule_rows(spark, sf):
    return U.unit_rules(unit_table(spark, sf))


for _r in U.FAMILIES:
    def _register(name):
        @query(f"unit_rule_{name}", f"SELECT {_U}, missing, hit, {rnd('CAST(severity AS DOUBLE)', 6)} AS severity, {rnd('CAST(confidence AS DOUBLE)', 6)} AS confidence FROM urule WHERE detector_name = '{name}'")
        def _(spark, sf):
            r = rule_rows(spark, sf).where(F.col("detector_name") == name)
            return round_all(r.select(*UNIT, "missing", "hit", "severity", "confidence"), 6)

    _register(_r)


@query("unit_rule_fusion", f"""
WITH f AS (SELECT {_U}, family, max(severity) FILTER (hit) AS best, sum(CASE WHEN hit THEN confidence ELSE 0 END) AS cs, count(*) FILTER (hit) AS h, count(*) FILTER (missing) AS m FROM urule GROUP BY ALL),
u AS (SELECT {_U}, coalesce(max(best), 0) AS s, count(best) AS k, sum(cs) / nullif(sum(h), 0) AS mc, sum(m) AS w, coalesce(string_agg(family, ',' ORDER BY family) FILTER (best IS NOT NULL), '') AS triggered_families FROM f GROUP BY ALL),
c AS (SELECT *, greatest(0, coalesce(mc, 0) - least(0.3, w * 0.02)) AS conf FROM u)
SELECT {_U}, {rnd('CAST(s AS DOUBLE)', 6)} AS rule_score, {rnd('CAST(conf AS DOUBLE)', 6)} AS confidence, triggered_families,
  CASE WHEN round(conf, 9) < 0.4 OR s <= 0 THEN 'none' WHEN k >= 2 OR s >= 70 THEN 'orange' WHEN s >= 35 THEN 'yellow' ELSE 'none' END AS risk_level FROM c
""")
def _(spark, sf):
    f = U.fuse(rule_rows(spark, sf))
    return round_all(f.select(*UNIT, "rule_score", "confidence", "triggered_families", "risk_level"), 6)


@query("unit_clue_candidates", f"""
WITH o AS (SELECT {_U}, 'price_spread' AS detector_id, 'price_warning' AS category, 'price_spread' AS family, least(100, greatest(45, (max(comparable_unit_price) / min(comparable_unit_price) / 20 - 1) * 80 + 45)) AS severity, 0.8 AS confidence
  FROM uo GROUP BY ALL HAVING max(comparable_unit_price) / min(comparable_unit_price) >= 20),
b AS (SELECT * FROM o UNION ALL SELECT {_U}, detector_name, 'terminal_dynamic', family, severity, confidence FROM urule WHERE hit),
u AS (SELECT {_U}, max(severity) AS s, max(confidence) AS c, count(*) AS evidence_count, bool_or(category = 'price_warning') AS p, count(DISTINCT category || '/' || family) AS k,
  string_agg(DISTINCT detector_id, ',' ORDER BY detector_id) AS triggered_detectors FROM b GROUP BY ALL),
v AS (SELECT *, CASE WHEN p THEN 'price_warning' ELSE 'terminal_dynamic' END AS category FROM u)
SELECT {_U}, category, {rnd('CAST(s AS DOUBLE)', 6)} AS rule_score, evidence_count, triggered_detectors, k AS family_count,
  CASE WHEN p AND s >= 85 THEN 'red' WHEN k >= 2 OR s >= 55 THEN 'orange' ELSE 'yellow' END AS risk_level,
  'RISK-' || substr(md5(org_code || '|product_line|' || product_line_code || '|{AS_OF}|v0|' || category), 1, 12) AS card_id FROM v
""")
def _(spark, sf):
    units = rule_rows(spark, sf).where("hit").selectExpr(*UNIT, "detector_name as detector_id", "'terminal_dynamic' as category", "family", "severity", "confidence")
    spread = R.price_spread_groups(unit_orders(spark, sf), 20.0).where("hit").selectExpr(
        *UNIT, "'price_spread' as detector_id", "'price_warning' as category", "'price_spread' as family", "severity", "0.8D as confidence"
    )
    c = U.clue_candidates(units, spread, AS_OF)
    return round_all(c.select(*UNIT, "category", "rule_score", "evidence_count", "triggered_detectors", "family_count", "risk_level", "card_id"), 6)
