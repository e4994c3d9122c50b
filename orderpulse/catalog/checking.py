"""Queries of the checks that name failing rows: orders, contract tables, training frames, table summaries."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog import evaluation as EV
from orderpulse.catalog import rules as RQ
from orderpulse.catalog.base import query, rnd
from orderpulse.functions.exprs import round_all
from orderpulse.operators import checks as K
from orderpulse.sources import star

_RULES = {
    "order_time_parseable": ("error", "order_date IS NULL"), "purchase_qty_non_negative": ("error", "purchase_qty IS NULL OR purchase_qty < 0"),
    "purchase_price_non_negative": ("error", "comparable_unit_price IS NULL OR comparable_unit_price < 0"),
    "conversion_factor_valid": ("warning", "conversion_factor IS NULL OR conversion_factor <= 0"), "delivery_qty_gt_purchase_qty": ("warning", "delivery_qty > purchase_qty"),
    "receipt_qty_gt_delivery_qty": ("warning", "receipt_qty > delivery_qty"), "org_code_not_empty": ("error", "trim(coalesce(org_code, '')) = ''"),
    "drug_code_not_empty": ("error", "trim(coalesce(drug_code, '')) = ''"), "order_id_unique": ("warning", "order_id IN (SELECT order_id FROM uo GROUP BY 1 HAVING count(*) > 1)"),
}


@query("quality_order_report", "\nUNION ALL ".join(
    f"SELECT * FROM (SELECT '{n}' AS check_name, '{s}' AS severity, count(*) AS row_count, string_agg(row_uid, ',' ORDER BY row_uid) FILTER (i <= 5) AS sample_refs "
    f"FROM (SELECT row_uid, row_number() OVER (ORDER BY row_uid) AS i FROM uo WHERE {c})) WHERE row_count > 0" for n, (s, c) in _RULES.items()))
def _(spark, sf):
    return K.order_report(RQ.unit_orders(spark, sf).withColumnRenamed("comparable_unit_price", "purchase_price"))


_SAMPLE = ["row_uid", "order_status_raw", "order_quantity", "delivery_quantity", "arrival_quantity"]


@query("quality_duplicate_samples", f"""
SELECT order_detail_id, {', '.join(_SAMPLE)} FROM ord
WHERE order_detail_id IN (SELECT order_detail_id FROM ord GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 50)
""")
def _(spark, sf):
    return K.duplicate_samples(common.orders(spark, sf), "order_detail_id", _SAMPLE)


@query("quality_contract_checks", """
WITH f AS (
  SELECT 'orders' AS table_name, 'required_columns' AS check_name, CAST(1 AS BIGINT) AS failing
  UNION ALL SELECT 'hospitals', 'required_columns', 0
  UNION ALL SELECT 'orders', 'unique_row_uid', coalesce(sum(n) FILTER (n > 1), 0) FROM (SELECT count(*) AS n FROM ord GROUP BY row_uid)
  UNION ALL SELECT 'orders', 'unique_order_id_sku_code', coalesce(sum(n) FILTER (n > 1), 0) FROM (SELECT count(*) AS n FROM ord GROUP BY order_id, sku_code)
  UNION ALL SELECT 'hospitals', 'row_count', abs((SELECT count(*) FROM nation) - 24)
  UNION ALL SELECT 'orders', 'hospital_code_in_hospitals', count(*) FROM ord WHERE hospital_code NOT IN (SELECT 'H' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation WHERE n_name <> 'CHINA')
  UNION ALL SELECT 'all_hospitals', 'no_forbidden_text', count(*) FROM nation WHERE contains(n_name, 'UNITED') OR contains(n_name, 'IRA'))
SELECT table_name, check_name, CAST(failing AS BIGINT) AS failing, CASE WHEN failing = 0 THEN 'pass' ELSE 'fail' END AS status FROM f
""")
def _(spark, sf):
    every = star.hospital_master(spark, sf)
    frames = {"orders": common.orders(spark, sf), "hospitals": every.where("hospital_name <> 'CHINA'"), "all_hospitals": every}
    return K.contract_checks(
        frames, {"orders": ["row_uid", "order_date", "tenant_id"], "hospitals": ["hospital_code"]}, {"orders": ["row_uid"]}, {"hospitals": {"full": 24, "persisted": 24}},
        [("orders", "hospitals", "hospital_code")], {"all_hospitals": ["hospital_name", "remark"]}, ["UNITED", "IRA"],
    ).unionByName(K.contract_checks(frames, {}, {"orders": ["order_id", "sku_code"]}, {}, [], {}, []))


@query("quality_label_distribution", "\nUNION ALL ".join(
    f"SELECT 'H{h}' AS horizon, count(*) AS row_count, count(*) FILTER (label_window_closed_H{h}) AS known_labels, "
    f"{rnd(f'avg(label_die_H{h}) FILTER (label_window_closed_H{h})')} AS positive_rate FROM lab WHERE horizon = 'H6'" for h in (3, 6, 12)))
def _(spark, sf):
    known = {f"label_die_H{h}": F.when(F.col(f"label_window_closed_H{h}"), F.col(f"label_die_H{h}")) for h in (3, 6, 12)}
    return round_all(K.label_distribution(EV.labelled(spark, sf).withColumns(known), [3, 6, 12]))


_COLUMNS = {"median_purchase_interval_days_asof_cutoff": "double", "cv2_quantity_asof_cutoff": "double", "adi_asof_cutoff": "double", "label_die_H6": "int"}


@query("quality_column_report", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, {rnd(f'count(*) FILTER ({c} IS NULL) / count(*)')} AS null_rate, {str(c.startswith('label')).lower()} AS forbidden FROM lab WHERE horizon = 'H6'"""
    for c, t in _COLUMNS.items()))
def _(spark, sf):
    return round_all(K.column_report(EV.labelled(spark, sf), list(_COLUMNS)))


@query("quality_training_warnings", f"""
SELECT 'SINGLE_CLASS_LABELS' AS warning, 1.0::DOUBLE AS measured FROM (SELECT count(*) AS n FROM lab WHERE label_die_H6 = 1) WHERE n > 0
UNION ALL SELECT 'EMPTY_TRAINING_DATASET', 0 FROM (SELECT count(*) AS n FROM lab WHERE label_die_H6 = 1) WHERE n = 0
""" + "".join(f"UNION ALL SELECT * FROM (SELECT 'HIGH_MISSING_{c}', {rnd(f'avg(({c} IS NULL)::INTEGER)')} AS m FROM lab WHERE label_die_H6 = 1) WHERE m > 0.02\n" for c in list(_COLUMNS)[:3]))
def _(spark, sf):
    return round_all(K.training_warnings(EV.labelled(spark, sf).where("label_die_H6 = 1"), "label_die_H6", list(_COLUMNS)[:3], 0.02))


_TABLES = {
    "orders": ("o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority", "o_orderdate"),
    "events": ("event_id,ts,user_id,event_type,value,props", "ts"),
    "nation": ("n_nationkey,n_name,n_regionkey", None),
}


@query("quality_table_summary", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({len(c.split(','))} AS BIGINT) AS column_count, '{c}' AS columns, CAST({f'min({d})' if d else 'NULL'} AS DATE) AS first_date, "
    f"CAST({f'max({d})' if d else 'NULL'} AS DATE) AS last_date FROM {t}" for t, (c, d) in _TABLES.items()))
def _(spark, sf):
    return K.table_summaries({t: (spark.read.parquet(f"{sf}/{t}.parquet"), d) for t, (_, d) in _TABLES.items()})
