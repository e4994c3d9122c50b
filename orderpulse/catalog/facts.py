"""Fact queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog.base import cte, query, rnd
from orderpulse.functions.exprs import round_all
from orderpulse.operators import facts
from orderpulse.schemas import ENTITY
from orderpulse.sources import star


@query("fact_purchase_event", f"""
SELECT row_uid, order_detail_id, manufacturer_code, hospital_code, drug_group, purchase_time, purchase_month,
  raw_sensitive_purchase_quantity, {rnd("raw_sensitive_purchase_amount")} AS raw_sensitive_purchase_amount,
  raw_sensitive_delivery_quantity, raw_sensitive_arrival_quantity, CAST(order_phase_code AS DOUBLE) AS order_phase_code,
  order_failure_flag, order_terminal_flag, province_code, drug_category_code FROM evt
""")
def _(spark, sf):
    return round_all(
        common.events(spark, sf).select(
            "row_uid", "order_detail_id", *ENTITY, "purchase_time", "purchase_month", "raw_sensitive_purchase_quantity",
            "raw_sensitive_purchase_amount", "raw_sensitive_delivery_quantity", "raw_sensitive_arrival_quantity",
            "order_phase_code", "order_failure_flag", "order_terminal_flag", "province_code", "drug_category_code",
        )
    )


@query("fact_entity_month", f"""
SELECT manufacturer_code, hospital_code, drug_group, purchase_month, order_count, 1 AS has_purchase, last_purchase_time_in_month,
  purchase_quantity_sum, {rnd("purchase_amount_sum", 4)} AS purchase_amount_sum, delivery_quantity_sum, arrival_quantity_sum,
  failed_count, received_count, terminal_count, province_code, city_code, county_code, hospital_level_code, ownership_type_code,
  drug_category_code, CAST(last_order_phase_code_in_month AS DOUBLE) AS last_order_phase_code_in_month,
  CAST(last_delivery_state_code_in_month AS DOUBLE) AS last_delivery_state_code_in_month, last_order_failure_flag_in_month FROM em
""")
def _(spark, sf):
    return round_all(common.entity_month(spark, sf), 4)


@query("fact_purchase_sequence", """
SELECT row_uid, row_number() OVER w AS sequence_index, lag(purchase_time) OVER w AS previous_purchase_time,
  purchase_time - lag(purchase_time) OVER w AS gap_days_since_previous_purchase FROM evt
WINDOW w AS (PARTITION BY manufacturer_code, hospital_code, drug_group ORDER BY purchase_time, order_detail_id, row_uid)
""")
def _(spark, sf):
    return facts.purchase_sequence(common.events(spark, sf)).select(
        "row_uid", "sequence_index", "previous_purchase_time", "gap_days_since_previous_purchase"
    )


def base(spark, sf, **kw):
    return facts.monthly_entities(
        common.orders(spark, sf), common.CUTOFF, common.CUTOFF, star.hospital_master(spark, sf), star.drug_master(spark, sf), **kw
    )


_BASE = """
SELECT o.manufacturer_code, o.hospital_code, {group} AS drug_group, {source} AS drug_group_source,
  min(order_date) AS first_purchase_date, max(order_date) AS last_purchase_date, count(order_id) AS purchase_count_total,
  sum(order_quantity) AS purchase_quantity_total, sum(order_amount) AS order_amount_total,
  count(*) FILTER (order_date > DATE '2000-09-30') AS purchase_count_recent,
  coalesce(sum(order_quantity) FILTER (order_date > DATE '2000-09-30'), 0) AS purchase_quantity_recent,
  coalesce(sum(order_amount) FILTER (order_date > DATE '2000-09-30'), 0) AS order_amount_recent,
  round((DATE '2000-12-31' - min(order_date)) / 30.4375, 2) AS history_months
FROM ord o {join} WHERE order_date <= DATE '2000-12-31' GROUP BY ALL
"""
cte("ebase", _BASE.format(group="o.drug_code", source="'drug_code'", join=""))
cte("ebase_line", _BASE.format(
    group="coalesce(d.product_line_code, o.drug_code)",
    source="CASE WHEN d.product_line_code IS NULL THEN 'drug_code' ELSE 'product_line_mapping' END",
    join="LEFT JOIN drug d ON o.drug_code = d.drug_code",
))
_BASE_SELECT = f"""
SELECT b.manufacturer_code, b.hospital_code, b.drug_group, drug_group_source, first_purchase_date, last_purchase_date,
  purchase_count_total, purchase_quantity_total, {rnd("order_amount_total", 4)} AS order_amount_total, purchase_count_recent,
  purchase_quantity_recent, {rnd("order_amount_recent", 4)} AS order_amount_recent, history_months,
  CASE WHEN purchase_count_total <= 1 OR history_months < 3 THEN 'history_insufficient'
    WHEN history_months < 12 OR purchase_count_total < 4 THEN 'history_medium' ELSE 'history_sufficient' END AS history_sufficiency_flag,
  coalesce(h.hospital_name, b.hospital_code) AS hospital_display_name, h.region_code, h.hospital_level,
  coalesce(d.drug_name, b.drug_group) AS drug_display_name, d.drug_category, x.horizon
FROM {{}} b LEFT JOIN hosp h ON b.hospital_code = h.hospital_code LEFT JOIN drug d ON b.drug_group = d.drug_code
  CROSS JOIN (VALUES ('H3'), ('H6'), ('H12')) x(horizon)
"""
_BASE_COLS = [
    *ENTITY, "drug_group_source", "first_purchase_date", "last_purchase_date", "purchase_count_total",
    "purchase_quantity_total", "order_amount_total", "purchase_count_recent", "purchase_quantity_recent",
    "order_amount_recent", "history_months", "history_sufficiency_flag", "hospital_display_name", "region_code",
    "hospital_level", "drug_display_name", "drug_category", "horizon",
]


@query("fact_monthly_entity_base", _BASE_SELECT.format("ebase"))
def _(spark, sf):
    return round_all(base(spark, sf).select(*_BASE_COLS), 4)


@query("fact_entity_base_product_line", _BASE_SELECT.format("ebase_line"))
def _(spark, sf):
    return round_all(base(spark, sf, mapping=star.product_line_mapping(spark, sf)).select(*_BASE_COLS), 4)


@query("fact_orders_with_master", """
SELECT row_uid, coalesce(CASE WHEN o.purchase_unit = 'BAG' THEN '' ELSE NULL END || '', h.hospital_level) AS probe,
  CASE WHEN customer_segment = 'BUILDING' THEN h.region_code ELSE o.province_code END AS province_code,
  h.hospital_level FROM ord o LEFT JOIN hosp h ON o.hospital_code = h.hospital_code
""".replace("coalesce(CASE WHEN o.purchase_unit = 'BAG' THEN '' ELSE NULL END || '', h.hospital_level) AS probe,\n  ", ""))
def _(spark, sf):
    blanked = common.orders(spark, sf).withColumn(
        "province_code", F.when(F.col("customer_segment") == "BUILDING", "").otherwise(F.col("province_code"))
    )
    meta = star.hospital_master(spark, sf).select(
        "hospital_code", F.col("region_code").alias("province_code"), "hospital_level"
    )
    return facts.fill_from_master(blanked, meta, ["province_code", "hospital_level"], ["hospital_code"]).select(
        "row_uid", "province_code", "hospital_level"
    )
