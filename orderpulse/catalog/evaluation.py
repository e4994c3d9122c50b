"""Label, split and metric queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog import features as FQ
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.catalog.common import CUTOFFS
from orderpulse.catalog.features import pr
from orderpulse.functions.exprs import nudge, round_all
from orderpulse.operators import features as A
from orderpulse.operators import labels as L
from orderpulse.operators import metrics as E
from orderpulse.operators.ranking import pct_rank
from orderpulse.schemas import ENTITY

KEY = [*ENTITY, "cutoff_month"]
_E = "manufacturer_code, hospital_code, drug_group"
_ADD = "last_day((cutoff_month + INTERVAL {} MONTH)::DATE)"
cte("lab", f"""
SELECT f.*, (SELECT max(purchase_month) FROM em) AS last_month, {', '.join(
    f"coalesce((nxt <= {_ADD.format(h)})::INTEGER, 0) AS label_alive_H{h}, 1 - coalesce((nxt <= {_ADD.format(h)})::INTEGER, 0) AS label_die_H{h}, "
    f"{_ADD.format(h)} <= (SELECT max(purchase_month) FROM em) AS label_window_closed_H{h}" for h in (3, 6, 12))}
FROM featx f LEFT JOIN (SELECT e.manufacturer_code, e.hospital_code, e.drug_group, c.cutoff_month, min(purchase_month) AS nxt
  FROM em e JOIN cuts c ON purchase_month > c.cutoff_month GROUP BY ALL) n USING (manufacturer_code, hospital_code, drug_group, cutoff_month)
""")
cte("mfa", f"""
SELECT entity_id, manufacturer_code, hospital_code, drug_group, cutoff_month, horizon, h, round(churn_probability_H + {nudge(8)!r}, 8) AS p,
  CASE horizon WHEN 'H3' THEN label_die_H3 WHEN 'H6' THEN label_die_H6 ELSE label_die_H12 END AS y,
  CASE horizon WHEN 'H3' THEN label_window_closed_H3 WHEN 'H6' THEN label_window_closed_H6 ELSE label_window_closed_H12 END AS closed,
  round(greatest(value_at_risk_proxy, 0) + {nudge(6)!r}, 6) AS v, recency_only_baseline AS recency, frequency_decay_baseline AS decay, interval_overdue_baseline AS overdue,
  sample_class, demand_shape_label, history_sufficiency_flag, purchase_count_asof_cutoff AS n_orders, active_month_count_asof_cutoff AS n_months,
  months_observed_asof_cutoff AS age, first_purchase_month_asof_cutoff AS first_month, province_code, drug_category_code, hospital_level_code,
  median_purchase_interval_days_asof_cutoff AS med, cv2_quantity_asof_cutoff AS cv2, adi_asof_cutoff AS adi
FROM lab
""")
cte("mf", "SELECT *, p * v AS prio, (p >= 0.5)::INTEGER AS is_candidate FROM mfa WHERE closed")


def labelled(spark, sf, months=None):
    """`months`: settled entity months, which tell the months of purchases as the events do."""
    f = FQ.feats(spark, sf, months=months)
    ev = common.events(spark, sf) if months is None else months
    return L.with_closure(L.alive_labels(f, ev, CUTOFFS), ev)


def all_rows(spark, sf, months=None):
    x = FQ.expand_scored(labelled(spark, sf, months))
    pick = "case horizon when 'H3' then {0}_H3 when 'H6' then {0}_H6 else {0}_H12 end"
    return x.selectExpr(
        "entity_id", *KEY, "horizon", "cast(substring(horizon, 2) as int) as h", f"round(churn_probability_H + {nudge(8)!r}D, 8) as p",
        pick.format("label_die") + " as y", pick.format("label_window_closed") + " as closed",
        f"round(greatest(value_at_risk_proxy, 0D) + {nudge(6)!r}D, 6) as v", "recency_only_baseline as recency", "frequency_decay_baseline as decay",
        "interval_overdue_baseline as overdue", "sample_class", "demand_shape_label", "history_sufficiency_flag",
        "purchase_count_asof_cutoff as n_orders", "active_month_count_asof_cutoff as n_months", "months_observed_asof_cutoff as age",
        "first_purchase_month_asof_cutoff as first_month", "province_code", "drug_category_code", "hospital_level_code",
        "median_purchase_interval_days_asof_cutoff as med", "cv2_quantity_asof_cutoff as cv2", "adi_asof_cutoff as adi",
    )


def frame(spark, sf, months=None):
    return all_rows(spark, sf, months).where("closed").selectExpr("*", "p * v as prio", "cast(p >= 0.5 as int) as is_candidate")


_LAB = [f"label_{k}_H{h}" for h in (3, 6, 12) for k in ("alive", "die", "window_closed")]


@query("label_alive", f"SELECT {_E}, cutoff_month, {', '.join(_LAB)} FROM lab WHERE horizon = 'H3'")
def _(spark, sf):
    return labelled(spark, sf).select(*KEY, *_LAB)


@query("label_closure_audit", f"""
SELECT horizon, count(*) AS row_count, count(*) FILTER (closed) AS closed_label_rows, coalesce(CAST(sum(y) FILTER (closed) AS BIGINT), 0) AS die_count_closed,
  {rnd('avg(y) FILTER (closed)')} AS positive_rate_closed FROM mfa GROUP BY horizon
""")
def _(spark, sf):
    return round_all(L.closure_audit(labelled(spark, sf)))


@query("label_long_by_horizon", "SELECT manufacturer_code, hospital_code, drug_group, cutoff_month, horizon, 1 - y AS label_alive, y AS label_die, closed AS label_window_closed FROM mfa")
def _(spark, sf):
    return L.long_labels(labelled(spark, sf), KEY)


ORIGINS = ["2000-06-30", "2000-12-31", "2001-06-30"]


@query("label_churn_days", """
WITH e AS (SELECT org_code, product_line_code, order_date, count(*) AS n FROM uo WHERE purchase_qty > 0 AND coalesce(void_qty, 0) = 0 GROUP BY ALL),
o AS (SELECT * FROM (VALUES (DATE '2000-06-30'), (DATE '2000-12-31'), (DATE '2001-06-30')) t(origin_date))
SELECT origin_date, org_code, product_line_code, coalesce(CAST(sum(n) FILTER (order_date > origin_date AND order_date <= origin_date + 45) AS BIGINT), 0) AS future_purchase_count,
  CASE WHEN origin_date + 45 <= (SELECT max(order_date) FROM uo) THEN CASE WHEN coalesce(sum(n) FILTER (order_date > origin_date AND order_date <= origin_date + 45), 0) > 0 THEN 0 ELSE 1 END END AS "label_churn_H",
  CASE WHEN origin_date + 45 <= (SELECT max(order_date) FROM uo) THEN 'known' ELSE 'label_unknown' END AS label_status
FROM e, o GROUP BY origin_date, org_code, product_line_code HAVING count(*) FILTER (order_date <= origin_date) > 0
""")
def _(spark, sf):
    from orderpulse.catalog import rules

    return L.churn_in_days(rules.unit_orders(spark, sf), ORIGINS, 45, rules.UNIT).select(
        "origin_date", *rules.UNIT, "future_purchase_count", "label_churn_H", "label_status"
    )


cte("fps", f"""
WITH d AS (SELECT {_E}, purchase_time, first(raw_sensitive_purchase_quantity ORDER BY order_detail_id, row_uid) AS q, first(raw_sensitive_purchase_amount ORDER BY order_detail_id, row_uid) AS a,
  first(raw_sensitive_delivery_quantity ORDER BY order_detail_id, row_uid) AS dq, first(raw_sensitive_arrival_quantity ORDER BY order_detail_id, row_uid) AS aq,
  first(drug_category_code ORDER BY order_detail_id, row_uid) AS drug_category_code, first(province_code ORDER BY order_detail_id, row_uid) AS province_code,
  first(hospital_level_code ORDER BY order_detail_id, row_uid) AS hospital_level_code FROM evt GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS i, lead(purchase_time) OVER w AS second_purchase_time FROM d WINDOW w AS (PARTITION BY {_E} ORDER BY purchase_time))
SELECT {_E}, purchase_time AS first_purchase_time, last_day(purchase_time) AS first_purchase_month, second_purchase_time, q AS first_purchase_quantity, a AS first_purchase_amount,
  dq / nullif(q, 0) AS delivery_rate, aq / nullif(q, 0) AS arrival_rate, greatest(dq - aq, 0) AS return_quantity, drug_category_code, province_code, hospital_level_code,
  {', '.join(f"(purchase_time + INTERVAL {h} MONTH)::DATE <= (SELECT max(purchase_time) FROM evt) AS label_window_closed_H{h}, CASE WHEN (purchase_time + INTERVAL {h} MONTH)::DATE <= (SELECT max(purchase_time) FROM evt) THEN coalesce((second_purchase_time <= (purchase_time + INTERVAL {h} MONTH)::DATE)::INTEGER, 0) END AS label_repeat_H{h}" for h in (3, 6, 12))}
FROM r WHERE i = 1
""")
_FPS = ["first_purchase_time", "first_purchase_month", "second_purchase_time", "first_purchase_quantity", "return_quantity", *[f"label_{k}_H{h}" for h in (3, 6, 12) for k in ("window_closed", "repeat")]]


def samples(spark, sf):
    return L.first_purchase_samples(common.events(spark, sf))


@query("label_first_purchase_repeat", f"SELECT {_E}, {', '.join(_FPS)}, {rnd('first_purchase_amount', 6)} AS first_purchase_amount, {rnd('delivery_rate', 6)} AS delivery_rate, {rnd('arrival_rate', 6)} AS arrival_rate FROM fps")
def _(spark, sf):
    return round_all(samples(spark, sf).select(*ENTITY, *_FPS, "first_purchase_amount", "delivery_rate", "arrival_rate"), 6)


_SPLIT = f"""CASE WHEN {_ADD.format('h')} <= DATE '2000-03-31' THEN 'train' WHEN cutoff_month <= DATE '2000-03-31' THEN 'purge'
  WHEN {_ADD.format('h')} <= DATE '2000-09-30' THEN 'valid' WHEN cutoff_month <= DATE '2000-09-30' THEN 'purge' WHEN cutoff_month <= DATE '2001-06-30' THEN 'test' ELSE 'unused' END"""
_SPLIT = _SPLIT.replace("INTERVAL h MONTH", "INTERVAL (h) MONTH")


def split_rows(spark, sf):
    return L.purged_split(all_rows(spark, sf).withColumnRenamed("y", "label_die"), "2000-03-31", "2000-09-30", "2001-06-30")


@query("split_purged_audit", f"""
SELECT horizon, split, count(*) AS row_count, count(DISTINCT cutoff_month) AS cutoff_count, count(DISTINCT entity_id) AS entity_count, CAST(sum(y) AS BIGINT) AS positive_count,
  min(cutoff_month) AS cutoff_min, max(cutoff_month) AS cutoff_max FROM (SELECT *, {_SPLIT} AS split FROM mfa) GROUP BY horizon, split
""")
def _(spark, sf):
    return L.split_audit(split_rows(spark, sf))


def _month_split(name, train_end):
    @query(name, f"""
WITH m AS (SELECT first_purchase_month AS m, row_number() OVER (ORDER BY first_purchase_month) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT first_purchase_month FROM fps)),
b AS (SELECT CASE WHEN count(*) FILTER (m <= DATE '{train_end}') > 0 AND count(*) FILTER (m > DATE '{train_end}') > 0 THEN DATE '{train_end}'
  ELSE max(m) FILTER (i = greatest(1, floor(k * 0.75)::INTEGER)) END AS border FROM m)
SELECT CASE WHEN first_purchase_month <= border THEN 'train' ELSE 'test' END AS split, count(*) AS n, max(first_purchase_month) AS last_month FROM fps, b GROUP BY ALL
""")
    def _(spark, sf):
        s = L.split_by_month(samples(spark, sf), "first_purchase_month", train_end)
        return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("first_purchase_month").alias("last_month"))


_month_split("split_by_month", "1996-12-31")
_month_split("split_by_month_fallback", "2022-12-31")


@query("split_holdout_window", """
SELECT CASE WHEN order_date <= DATE '2000-06-30' THEN 'train' WHEN order_date > DATE '2000-07-30' AND order_date <= DATE '2001-01-30' THEN 'holdout' ELSE 'outside' END AS part, count(*) AS n FROM ord GROUP BY ALL
""")
def _(spark, sf):
    w = L.holdout_window("2000-06-30", 6, 1)
    d = F.col("order_date")
    part = F.when(d <= w["train_end"], "train").when((d >= w["holdout_start"]) & (d <= w["holdout_end"]), "holdout").otherwise("outside")
    return common.orders(spark, sf).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("split_walk_forward", """
SELECT o::DATE AS origin_date, count(*) AS orders_before FROM generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2001-06-30', INTERVAL 90 DAY) t(o) JOIN ord ON order_date <= o::DATE GROUP BY ALL
""")
def _(spark, sf):
    # Orders per day first; each day then counts for the origins on or after it.
    origins = F.expr("filter(sequence(date'1999-01-01', date'2001-06-30', interval 90 days), d -> d >= order_date)")
    days = common.orders(spark, sf).groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    counted = days.withColumn("origin_date", F.explode(origins)).groupBy("origin_date").agg(F.sum("n").alias("orders_before"))
    return L.walk_forward_dates(spark, "1999-01-01", "2001-06-30", 90).join(counted, "origin_date")


@query("training_frame", f"""
WITH e AS (SELECT org_code, product_line_code, order_date FROM uo WHERE purchase_qty > 0 AND coalesce(void_qty, 0) = 0)
SELECT origin_date, org_code, product_line_code, days_since_last_purchase, purchase_count_90d,
  CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.org_code = u.org_code AND e.product_line_code = u.product_line_code AND order_date > u.origin_date AND order_date <= u.origin_date + 45) THEN 0 ELSE 1 END AS "label_churn_H"
FROM usnap u
""")
def _(spark, sf):
    from orderpulse.catalog import rules
    from orderpulse.operators.units import unit_snapshot

    o = rules.unit_orders(spark, sf)
    snap = unit_snapshot(o, rules.ORIGINS).select("origin_date", *rules.UNIT, "days_since_last_purchase", "purchase_count_90d")
    return L.training_frame(snap, L.churn_in_days(o, rules.ORIGINS, 45, rules.UNIT), ["origin_date", *rules.UNIT])


@query("label_key_check", "SELECT CAST(0 AS BIGINT) AS features_without_label, CAST(0 AS BIGINT) AS labels_without_features FROM (SELECT count(*) FROM feat)")
def _(spark, sf):
    return L.label_key_check(FQ.feats(spark, sf), labelled(spark, sf))


@query("label_scope_flags", """
SELECT cutoff_month, CASE WHEN purchase_count_asof_cutoff >= 3 AND active_month_count_asof_cutoff >= 2 THEN 'recurring' WHEN purchase_count_asof_cutoff = 1 THEN 'one_shot' ELSE 'low_history' END AS scope, count(*) AS n FROM feat GROUP BY ALL
""")
def _(spark, sf):
    return L.scope_flags(FQ.feats(spark, sf)).groupBy("cutoff_month", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("label_trainability", """
SELECT horizon, split, count(*) AS row_count, count(DISTINCT entity_id) AS entity_count, CAST(sum(y) AS BIGINT) AS positive_count, count(DISTINCT m.cutoff_month) AS cutoffs_present,
  max(need) - count(DISTINCT m.cutoff_month) AS cutoffs_missing, CASE WHEN max(need) = count(DISTINCT m.cutoff_month) AND count(*) >= 100 AND sum(y) >= 20 THEN 'trainable' ELSE 'blocked' END AS gate
FROM mf m JOIN (VALUES ('train', DATE '1999-06-30', 2), ('train', DATE '1999-12-31', 2), ('test', DATE '2000-06-30', 2), ('test', DATE '2000-12-31', 2)) t(split, cutoff_month, need) ON m.cutoff_month = t.cutoff_month
GROUP BY horizon, split
""")
def _(spark, sf):
    rows = all_rows(spark, sf).withColumnsRenamed({"y": "label_die", "closed": "label_window_closed"})
    return L.trainability(rows, {"train": CUTOFFS[:2], "test": CUTOFFS[2:]})


@query("label_definition_stress", f"""
WITH b AS (SELECT demand_shape_label, horizon, y, n_orders FROM mf), pol AS (SELECT * FROM (VALUES ('current'), ('exclude_lumpy'), ('exclude_intermittent_short_horizon'), ('exclude_low_history')) t(policy)),
x AS (SELECT *, CASE policy WHEN 'current' THEN true WHEN 'exclude_lumpy' THEN demand_shape_label <> 'lumpy'
  WHEN 'exclude_intermittent_short_horizon' THEN NOT (demand_shape_label = 'intermittent' AND horizon = 'H3') ELSE n_orders >= 3 END AS keep FROM b, pol)
SELECT demand_shape_label, horizon, policy, count(*) FILTER (keep) AS kept_rows, count(*) FILTER (NOT keep) AS affected_rows,
  coalesce(CAST(sum(y) FILTER (keep) AS BIGINT), 0) AS positive_count, {rnd('avg(y) FILTER (keep)')} AS die_rate FROM x GROUP BY demand_shape_label, horizon, policy
""")
def _(spark, sf):
    rows = all_rows(spark, sf).withColumnsRenamed({"y": "label_die", "closed": "label_window_closed", "n_orders": "purchase_count_asof_cutoff"})
    return round_all(L.definition_stress(rows))


# Probability metrics.
_G = "horizon, cutoff_month"
BY = ["horizon", "cutoff_month"]
_Q = "least(greatest(p, 1e-15), 1 - 1e-15)"
_PROB = f"""count(*) AS row_count, CAST(sum(y) AS BIGINT) AS positive_count, {rnd('avg(y)')} AS positive_rate, {rnd('avg((p - y) * (p - y))')} AS brier_score,
  {rnd(f'avg(-(y * ln({_Q}) + (1 - y) * ln(1 - {_Q})))')} AS log_loss"""


@query("metric_brier_log_loss", f"SELECT {_G}, {_PROB} FROM mf GROUP BY {_G}")
def _(spark, sf):
    return round_all(E.probability_metrics(frame(spark, sf), BY))


def auc_sql(src: str, by: str, score: str = "p", y: str = "y") -> str:
    return f"""SELECT {by}, (sum(r) FILTER ({y} = 1) - sum({y}) * (sum({y}) + 1) / 2.0) / nullif(sum({y})::DOUBLE * sum(1 - {y}), 0) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS r FROM {src} WHERE {score} IS NOT NULL) GROUP BY {by}"""


@query("metric_roc_auc", f"WITH a AS ({auc_sql('mf', _G)}) SELECT {_G}, {rnd('auc')} AS roc_auc FROM a")
def _(spark, sf):
    return round_all(E.roc_auc(frame(spark, sf), BY))


_ORD = f"PARTITION BY {_G} ORDER BY p DESC, {_E}"


@query("metric_pr_auc", f"""
WITH r AS (SELECT *, row_number() OVER w AS r, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER (PARTITION BY {_G}) AS t FROM mf WINDOW w AS ({_ORD}))
SELECT {_G}, {rnd('sum((tp / r + CASE WHEN r > 1 THEN (tp - 1) / (r - 1) ELSE 1 END) / 2) / max(t)')} AS pr_auc, {rnd('sum(tp / r) / max(t)')} AS average_precision FROM r WHERE y = 1 GROUP BY {_G}
""")
def _(spark, sf):
    return round_all(E.pr_metrics(frame(spark, sf), BY))


_BIN = "greatest(ceil(p * 10)::INTEGER - 1, 0)"


@query("metric_calibration_curve", f"""
SELECT {_G}, {_BIN} AS bin, count(*) AS "count", {rnd('avg(p)')} AS predicted_probability_mean, {rnd('avg(y)')} AS actual_rate FROM mf GROUP BY ALL
""")
def _(spark, sf):
    return round_all(E.calibration_curve(frame(spark, sf), BY))


@query("metric_calibration_left_closed", f"""
SELECT horizon, least(floor(p * 10)::INTEGER, 9) AS bin, count(*) AS "count", {rnd('avg(p)')} AS predicted_probability_mean, {rnd('avg(y)')} AS actual_rate FROM mf GROUP BY ALL
""")
def _(spark, sf):
    return round_all(E.calibration_curve(frame(spark, sf), ["horizon"], left=True))


def ece_sql(src: str, by: str) -> str:
    return f"SELECT {by}, sum(abs(pm - ym) * n) / sum(n) AS ece FROM (SELECT {by}, {_BIN} AS b, avg(p) AS pm, avg(y) AS ym, count(*) AS n FROM {src} GROUP BY {by}, b) GROUP BY {by}"


@query("metric_ece", f"WITH a AS ({ece_sql('mf', _G)}) SELECT {_G}, {rnd('ece')} AS ece FROM a")
def _(spark, sf):
    return round_all(E.expected_calibration_error(E.calibration_curve(frame(spark, sf), BY), BY))


def kk(k, n="n"):
    if isinstance(k, str):
        return f"greatest(1, ceil({n} * {float(k.split('_')[1]) / 100})::INTEGER)"
    return f"greatest(1, least({k}, {n}))"


def topk_sql(src: str, by: str, score: str = "p") -> str:
    parts = []
    for k in E.K_VALUES:
        parts.append(f"""SELECT {by}, '{k}' AS k, {rnd(f'sum(y) FILTER (r <= {kk(k)}) / max({kk(k)})')} AS precision_at_k, {rnd(f'sum(y) FILTER (r <= {kk(k)}) / nullif(max(t), 0)')} AS recall_at_k,
  {rnd(f'sum(y / log2(r + 1)) FILTER (r <= {kk(k)}) / nullif(sum(1 / log2(r + 1)) FILTER (r <= least({kk(k)}, t)), 0)')} AS ndcg_at_k,
  {rnd(f'(sum(y) FILTER (r <= {kk(k)}) / max({kk(k)})) / nullif(max(t) / max(n), 0)')} AS lift_at_k, max(n) AS row_count FROM r GROUP BY {by}""")
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC NULLS LAST, {_E}) AS r, count(*) OVER (PARTITION BY {by}) AS n, sum(y) OVER (PARTITION BY {by}) AS t FROM {src})
""" + "\nUNION ALL ".join(parts)


@query("metric_topk_ranking", topk_sql("mf", _G))
def _(spark, sf):
    return round_all(E.topk_metrics(frame(spark, sf), BY))


_VAL = []
for _k in E.K_VALUES:
    _VAL.append(f"""SELECT {_G}, '{_k}' AS k, {rnd(f'sum(g) FILTER (r <= {kk(_k)}) / nullif(sum(g), 0)', 6)} AS captured_value_at_k, {rnd(f'sum(p * v) FILTER (r <= {kk(_k)}) / nullif(sum(p * v), 0)', 6)} AS expected_loss_captured_at_k,
  {rnd(f'sum(g / log2(r + 1)) FILTER (r <= {kk(_k)}) / nullif(sum(g / log2(i + 1)) FILTER (i <= {kk(_k)}), 0)', 6)} AS value_weighted_ndcg_at_k, {rnd(f'sum(v) FILTER (r <= {kk(_k)})', 2)} AS topk_total_value_at_risk,
  {rnd(f'sum(y) FILTER (r <= {kk(_k)}) / max({kk(_k)})', 6)} AS precision_at_k FROM r GROUP BY {_G}""")


@query("metric_value_at_k", f"""
WITH g AS (SELECT *, y * v AS g FROM mf), r AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY prio DESC, {_E}) AS r, row_number() OVER (PARTITION BY {_G} ORDER BY g DESC, {_E}) AS i, count(*) OVER (PARTITION BY {_G}) AS n FROM g)
""" + "\nUNION ALL ".join(_VAL))
def _(spark, sf):
    m = E.value_metrics(frame(spark, sf), BY, "y", "p", "prio", "v").drop("topk_average_business_priority_score")
    total = F.round(F.col("topk_total_value_at_risk") + nudge(2), 2)
    return round_all(m.withColumn("topk_total_value_at_risk", total), 6)


@query("metric_topk_macro", f"""
WITH m AS ({topk_sql('mf', _G)}) SELECT horizon, k, {rnd('avg(precision_at_k)', 6)} AS precision_at_k_macro, {rnd('avg(recall_at_k)', 6)} AS recall_at_k_macro, {rnd('avg(lift_at_k)', 6)} AS lift_at_k_macro, count(DISTINCT cutoff_month) AS cutoff_count FROM m GROUP BY horizon, k
""")
def _(spark, sf):
    return round_all(E.macro_by_cutoff(E.topk_metrics(frame(spark, sf), BY), ["horizon", "k"], ["precision_at_k", "recall_at_k", "lift_at_k"]), 6)


@query("metric_candidate_coverage", f"""
SELECT CASE grouping(horizon) * 2 + grouping(cutoff_month) WHEN 0 THEN 'horizon_cutoff' WHEN 1 THEN 'horizon' ELSE 'overall' END AS level, coalesce(horizon, 'ALL') AS horizon, cutoff_month,
  count(*) AS row_count, CAST(sum(is_candidate) AS BIGINT) AS candidate_count, CAST(sum(y) AS BIGINT) AS positive_count, CAST(sum(y * is_candidate) AS BIGINT) AS captured_positive_count,
  {rnd('avg(is_candidate)')} AS candidate_rate, {rnd('sum(y * is_candidate) / nullif(sum(y), 0)')} AS positive_recall, {rnd('sum(y * is_candidate) / nullif(sum(is_candidate), 0)')} AS candidate_precision
FROM mf GROUP BY ROLLUP (horizon, cutoff_month)
""")
def _(spark, sf):
    return round_all(E.coverage_rollup(frame(spark, sf)))


_FULL = lambda src, by: f"""SELECT * FROM (SELECT {by}, {_PROB} FROM {src} GROUP BY {by}) LEFT JOIN (SELECT {by}, {rnd('auc')} AS roc_auc FROM ({auc_sql(src, by)})) USING ({by}) LEFT JOIN (SELECT {by}, {rnd('ece')} AS ece FROM ({ece_sql(src, by)})) USING ({by})"""


@query("metric_candidate_vs_full", "WITH u AS (SELECT horizon, 'full_universe' AS scope, p, y FROM mf UNION ALL SELECT horizon, 'candidates', p, y FROM mf WHERE is_candidate = 1)\n" + _FULL("u", "horizon, scope"))
def _(spark, sf):
    f = frame(spark, sf)
    scope = F.explode(F.when(F.col("is_candidate") == 1, F.array(F.lit("full_universe"), F.lit("candidates"))).otherwise(F.array(F.lit("full_universe"))))
    return round_all(E.full_metrics(f.withColumn("scope", scope), ["horizon", "scope"]))


@query("metric_interval_coverage", f"SELECT {_G}, count(*) AS row_count, count(overdue) AS interval_available, {rnd('count(overdue) / count(*)')} AS interval_coverage FROM mf GROUP BY {_G}")
def _(spark, sf):
    return round_all(frame(spark, sf).groupBy(*BY).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("overdue").alias("interval_available"),
        (F.count("overdue") / F.count(F.lit(1))).alias("interval_coverage"),
    ))


_DIMS = {"demand_shape": "demand_shape_label", "province": "province_code", "history": "history_sufficiency_flag", "sample_class": "sample_class"}
_SEG = " UNION ALL ".join(f"SELECT '{d}' AS segment_dimension, {c} AS segment_value, horizon, p, y FROM mf" for d, c in _DIMS.items())
_SB = "segment_dimension, segment_value, horizon"


@query("metric_segment_matrix", f"""
WITH s AS ({_SEG}), m AS ({_FULL('s', _SB)}), x AS (SELECT m.*, mp - positive_rate AS bias FROM m JOIN (SELECT {_SB}, avg(p) AS mp FROM s GROUP BY {_SB}) USING ({_SB}))
SELECT {_SB}, row_count, positive_count, brier_score, roc_auc, ece, {rnd('bias', 6)} AS calibration_bias, row_count < 200 OR positive_count < 20 AS small_sample,
  coalesce(roc_auc < 0.6, false) AS weak_ranking, coalesce(ece > 0.1, false) AS poor_calibration,
  CASE WHEN row_count < 200 OR positive_count < 20 THEN 'observe_only' WHEN coalesce(roc_auc < 0.6, false) AND coalesce(ece > 0.1, false) THEN 'blocked'
    WHEN coalesce(roc_auc < 0.6, false) OR coalesce(ece > 0.1, false) THEN 'review' ELSE 'serve' END AS service_gate FROM x
""")
def _(spark, sf):
    m = E.segment_matrix(frame(spark, sf), _DIMS)
    return round_all(
        m.select(
            "segment_dimension", "segment_value", "horizon", "row_count", "positive_count", "brier_score", "roc_auc", "ece",
            F.round(F.col("calibration_bias") + nudge(6), 6).alias("calibration_bias"), "small_sample", "weak_ranking", "poor_calibration", "service_gate",
        )
    )


@query("metric_scorer_auc", "WITH u AS (SELECT horizon, 'recency' AS scorer, recency AS s, y FROM mf UNION ALL SELECT horizon, 'frequency_decay', round(decay, 8), y FROM mf UNION ALL SELECT horizon, 'interval_overdue', round(overdue, 8), y FROM mf UNION ALL SELECT horizon, 'survival_map', round(overdue / (1 + overdue), 8), y FROM mf),\na AS ("
       + auc_sql("u", "horizon, scorer", "s") + f") SELECT horizon, scorer, {rnd('auc')} AS roc_auc FROM a")
def _(spark, sf):
    long = frame(spark, sf).selectExpr(
        "horizon", "y",
        """inline(array(named_struct('scorer', 'recency', 's', recency), named_struct('scorer', 'frequency_decay', 's', round(decay, 8)),
           named_struct('scorer', 'interval_overdue', 's', round(overdue, 8)), named_struct('scorer', 'survival_map', 's', round(overdue / (1 + overdue), 8))))""",
    )
    return round_all(E.roc_auc(long, ["horizon", "scorer"], p="s"))


@query("metric_scorer_rank_normalized", f"SELECT entity_id, cutoff_month, horizon, {rnd(pr('recency', 'horizon, cutoff_month'))} AS recency_score FROM mf")
def _(spark, sf):
    return round_all(pct_rank(frame(spark, sf).select("entity_id", *BY, "recency"), "recency", BY, "recency_score").drop("recency"))


@query("metric_risk_bands", f"""
SELECT horizon, CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS row_count, {rnd('avg(p)')} AS mean_probability, {rnd('avg(y)')} AS actual_rate FROM mf GROUP BY ALL
""")
def _(spark, sf):
    band = F.expr("case when p >= 0.75 then 'high' when p >= 0.5 then 'medium' else 'low' end").alias("band")
    return round_all(frame(spark, sf).groupBy("horizon", band).agg(F.count(F.lit(1)).alias("row_count"), F.avg("p").alias("mean_probability"), F.avg("y").alias("actual_rate")))


@query("metric_risk_bands_quantile", f"""
WITH q AS (SELECT horizon, quantile_cont(p, 0.2) AS lo, quantile_cont(p, 0.8) AS hi FROM mf GROUP BY horizon)
SELECT horizon, CASE WHEN p >= hi THEN 'high' WHEN p <= lo THEN 'low' ELSE 'medium' END AS band, count(*) AS row_count, {rnd('avg(y)')} AS actual_rate FROM mf JOIN q USING (horizon) GROUP BY ALL
""")
def _(spark, sf):
    from orderpulse.operators.ranking import quantiles

    f = frame(spark, sf).select("horizon", "p", "y")
    j = f.join(quantiles(f, ["horizon"], "p", {"lo": 0.2, "hi": 0.8}), "horizon")
    band = F.expr("case when p >= hi then 'high' when p <= lo then 'low' else 'medium' end").alias("band")
    return round_all(j.groupBy("horizon", band).agg(F.count(F.lit(1)).alias("row_count"), F.avg("y").alias("actual_rate")))


_SHIFT = ["n_orders", "n_months", "age", "med", "cv2", "adi"]


@query("metric_distribution_shift", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {rnd('m0', 6)} AS train_mean, {rnd('m1', 6)} AS test_mean, {rnd('n0', 6)} AS train_missing_rate, {rnd('(m1 - m0) / nullif(sqrt((s0 * s0 + s1 * s1) / 2), 0)', 6)} AS smd,
  CASE WHEN abs((m1 - m0) / nullif(sqrt((s0 * s0 + s1 * s1) / 2), 0)) >= 0.5 THEN 'high' WHEN abs((m1 - m0) / nullif(sqrt((s0 * s0 + s1 * s1) / 2), 0)) >= 0.2 THEN 'medium' ELSE 'low' END AS drift_level
  FROM (SELECT avg({c}) FILTER (cutoff_month <= DATE '1999-12-31') AS m0, avg({c}) FILTER (cutoff_month > DATE '1999-12-31') AS m1, stddev_pop({c}) FILTER (cutoff_month <= DATE '1999-12-31') AS s0,
    stddev_pop({c}) FILTER (cutoff_month > DATE '1999-12-31') AS s1, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) FILTER (cutoff_month <= DATE '1999-12-31') AS n0 FROM mfa WHERE horizon = 'H3')""" for c in _SHIFT))
def _(spark, sf):
    rows = all_rows(spark, sf).where("horizon = 'H3'")
    side = F.expr("if(cutoff_month <= date'1999-12-31', 0, 1)")
    return round_all(E.distribution_shift(rows, side, _SHIFT).select("feature", "train_mean", "test_mean", "train_missing_rate", "smd", "drift_level"), 6)


@query("metric_label_rate_trend", f"SELECT {_G}, count(*) AS row_count, count(DISTINCT entity_id) AS entity_count, {rnd('avg(y)')} AS label_rate FROM mf GROUP BY {_G}")
def _(spark, sf):
    return round_all(frame(spark, sf).groupBy(*BY).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("entity_id").alias("entity_count"), F.avg("y").alias("label_rate")))


@query("metric_entity_inflow", f"""
WITH c AS (SELECT cutoff_month, row_number() OVER (ORDER BY cutoff_month) AS i FROM cuts), b AS (SELECT f.entity_id, f.cutoff_month, i, sample_class FROM feat f JOIN c USING (cutoff_month)),
w AS (SELECT *, lag(i) OVER (PARTITION BY entity_id ORDER BY i) AS pi, lag(sample_class) OVER (PARTITION BY entity_id ORDER BY i) AS ps FROM b)
SELECT cutoff_month, count(*) AS entity_count, count(*) FILTER (pi IS NULL) AS new_entities, count(*) FILTER (pi < i - 1) AS returning_entities, count(*) FILTER (pi = i - 1) AS retained_entities,
  count(*) FILTER (pi = i - 1 AND ps = 'one_shot' AND sample_class = 'recurring') AS one_shot_to_recurring FROM w GROUP BY cutoff_month
""")
def _(spark, sf):
    from orderpulse.operators.audits import entity_inflow

    return entity_inflow(A.expand_horizons(FQ.feats(spark, sf), [3]), CUTOFFS)


@query("metric_cohort_splits", f"""
SELECT horizon, CASE WHEN age <= 6 THEN '0-6' WHEN age <= 12 THEN '7-12' WHEN age <= 24 THEN '13-24' WHEN age <= 60 THEN '25-60' ELSE '60+' END AS age_bucket,
  CASE WHEN first_month <= DATE '1996-12-31' THEN 'early' WHEN first_month <= DATE '1998-12-31' THEN 'middle' ELSE 'late' END AS first_seen_period,
  CASE WHEN cutoff_month <= DATE '1999-12-31' THEN 'regime_a' ELSE 'regime_b' END AS regime, count(*) AS row_count, {rnd('avg(y)')} AS label_rate FROM mf GROUP BY ALL
""")
def _(spark, sf):
    f = frame(spark, sf)
    return round_all(
        f.groupBy(
            "horizon",
            F.expr("case when age <= 6 then '0-6' when age <= 12 then '7-12' when age <= 24 then '13-24' when age <= 60 then '25-60' else '60+' end").alias("age_bucket"),
            F.expr("case when first_month <= date'1996-12-31' then 'early' when first_month <= date'1998-12-31' then 'middle' else 'late' end").alias("first_seen_period"),
            F.expr("if(cutoff_month <= date'1999-12-31', 'regime_a', 'regime_b')").alias("regime"),
        ).agg(F.count(F.lit(1)).alias("row_count"), F.avg("y").alias("label_rate"))
    )


@query("metric_closure_grid", "SELECT horizon, cutoff_month, bool_and(closed) AS label_window_closed FROM mfa GROUP BY horizon, cutoff_month")
def _(spark, sf):
    return all_rows(spark, sf).groupBy(*BY).agg(F.expr("bool_and(closed) as label_window_closed"))


@query("metric_share_table", f"SELECT demand_shape_label, count(*) AS row_count, {rnd('count(*) / sum(count(*)) OVER ()')} AS row_share FROM mf GROUP BY demand_shape_label")
def _(spark, sf):
    return round_all(E.share_table(frame(spark, sf), "demand_shape_label"))


@query("metric_bin_risk_flags", f"""
WITH b AS (SELECT {_G}, {_BIN} AS bin, count(*) AS c, avg(y) AS a FROM mf GROUP BY ALL), s AS (SELECT *, a - lag(a) OVER (PARTITION BY {_G} ORDER BY bin) AS s FROM b),
t AS (SELECT *, lag(s) OVER (PARTITION BY {_G} ORDER BY bin) AS ps FROM s)
SELECT {_G}, bool_or(bin IN (0, 9) AND c < 30) AS small_extreme_bin, coalesce(bool_or(s * ps < 0 AND abs(s) > 0.05 AND abs(ps) > 0.05), false) AS sawtooth, count(*) AS bin_count FROM t GROUP BY {_G}
""")
def _(spark, sf):
    return E.bin_risks(E.calibration_curve(frame(spark, sf), BY), BY)


_BUCKET = "CASE WHEN {0} <= 1 THEN '1' WHEN {0} <= 2 THEN '2' WHEN {0} <= 5 THEN '3-5' WHEN {0} <= 10 THEN '6-10' ELSE '11+' END"


@query("metric_label_rate_by_bucket", f"""
SELECT horizon, {_BUCKET.format('n_orders')} AS purchase_bucket, {_BUCKET.format('n_months')} AS active_month_bucket, count(*) AS row_count, {rnd('avg(y)')} AS label_rate FROM mf GROUP BY ALL
""")
def _(spark, sf):
    return round_all(frame(spark, sf).groupBy("horizon", F.expr(_BUCKET.format("n_orders")).alias("purchase_bucket"), F.expr(_BUCKET.format("n_months")).alias("active_month_bucket")).agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("y").alias("label_rate")))


@query("metric_recurring_subset", f"""
SELECT {_G}, count(*) AS row_count, count(*) FILTER (n_orders >= 3 AND n_months >= 2) AS recurring_rows, {rnd('count(*) FILTER (n_orders >= 3 AND n_months >= 2) / count(*)')} AS recurring_share,
  {rnd('avg(y) FILTER (n_orders >= 3 AND n_months >= 2)')} AS recurring_label_rate FROM mf GROUP BY {_G}
""")
def _(spark, sf):
    r = "n_orders >= 3 and n_months >= 2"
    return round_all(frame(spark, sf).groupBy(*BY).agg(F.count(F.lit(1)).alias("row_count"), F.expr(f"count_if({r}) as recurring_rows"), F.expr(f"count_if({r}) / count(1) as recurring_share"), F.expr(f"avg(if({r}, y, null)) as recurring_label_rate")))


FOLDS = [("fold1", "1999-06-30", "1999-12-31"), ("fold2", "1999-12-31", "2000-06-30"), ("fold3", "2000-06-30", "2000-12-31")]
_FOLDS = ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in FOLDS)
cte("fold", f"SELECT * FROM (VALUES {_FOLDS}) t(fold, train_end, test_cutoff)")


def fold_rows(spark, sf):
    rows = ", ".join(f"named_struct('fold', '{a}', 'train_end', date'{b}', 'test_cutoff', date'{c}')" for a, b, c in FOLDS)
    f = frame(spark, sf).selectExpr("*", f"inline(array({rows}))")
    return f.where("cutoff_month <= train_end or cutoff_month = test_cutoff").withColumn("split", F.expr("if(cutoff_month = test_cutoff, 'test', 'train')"))


@query("metric_fold_distribution", f"""
SELECT fold, CASE WHEN cutoff_month = test_cutoff THEN 'test' ELSE 'train' END AS split, horizon, count(*) AS row_count, count(DISTINCT entity_id) AS entity_count, CAST(sum(y) AS BIGINT) AS positive_count
FROM mf, fold WHERE cutoff_month <= train_end OR cutoff_month = test_cutoff GROUP BY ALL
""")
def _(spark, sf):
    return fold_rows(spark, sf).groupBy("fold", "split", "horizon").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("entity_id").alias("entity_count"), F.sum("y").alias("positive_count"))


@query("metric_shape_wise", "WITH u AS (SELECT horizon, demand_shape_label, p, y FROM mf)\n" + _FULL("u", "horizon, demand_shape_label"))
def _(spark, sf):
    return round_all(E.full_metrics(frame(spark, sf), ["horizon", "demand_shape_label"]))


@query("metric_pooled_and_macro", f"""
WITH c AS ({_FULL('mf', _G)}), u AS (SELECT horizon, p, y FROM mf), o AS ({_FULL('u', 'horizon')})
SELECT horizon, 'pooled' AS metric_level, row_count, brier_score, roc_auc, ece FROM o
UNION ALL SELECT horizon, 'macro_by_cutoff', CAST(sum(row_count) AS BIGINT), {rnd('avg(brier_score)')}, {rnd('avg(roc_auc)')}, {rnd('avg(ece)')} FROM c GROUP BY horizon
""")
def _(spark, sf):
    f = frame(spark, sf)
    cols = ["brier_score", "roc_auc", "ece"]
    pooled = round_all(E.full_metrics(f, ["horizon"])).select("horizon", F.lit("pooled").alias("metric_level"), "row_count", *cols)
    per = round_all(E.full_metrics(f, BY))
    macro = per.groupBy("horizon").agg(F.sum("row_count").alias("row_count"), *[F.avg(c).alias(c) for c in cols])
    return pooled.unionByName(round_all(macro.select("horizon", F.lit("macro_by_cutoff").alias("metric_level"), "row_count", *cols)))
