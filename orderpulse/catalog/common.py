"""Shared inputs of the queries and the SQL of the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderpulse.catalog.base import cte
from orderpulse.operators import cleaning, facts
from orderpulse.sources import star

CUTOFFS = ["1999-06-30", "1999-12-31", "2000-06-30", "2000-12-31"]
CUTOFF = "2000-12-31"
OBSERVATION_DATES = ["2000-06-30", "2000-09-30", "2000-12-31", "2001-03-31"]


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return star.raw_orders(spark, sf)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return facts.purchase_events(orders(spark, sf))


def entity_month(spark: SparkSession, sf: str) -> DataFrame:
    return facts.entity_month(events(spark, sf))


def settled_months(spark: SparkSession, sf: str, attributes: bool = True) -> DataFrame:
    """Entity months written once, for queries that read them several times."""
    return facts.settled_entity_month(events(spark, sf), attributes)


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.eligible_orders(orders(spark, sf))


cte("ord", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS row_uid,
  CAST(l_orderkey AS VARCHAR) AS order_id,
  concat_ws('-', l_orderkey, l_linenumber) AS order_detail_id,
  CAST(o_orderdate AS DATE) AS order_date,
  'M' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS manufacturer_code,
  'H' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS hospital_code,
  p_brand AS drug_code,
  CAST(l_partkey AS VARCHAR) AS sku_code,
  p_type AS product_line_code,
  l_quantity AS order_quantity,
  l_extendedprice * (1 - l_discount) AS order_amount,
  l_extendedprice / l_quantity AS purchase_unit_price,
  CASE WHEN p_brand = 'Brand#13' THEN NULL WHEN p_brand = 'Brand#21' AND p_size > 25 THEN 'BAG' ELSE 'BOX' END AS purchase_unit,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 90 WHEN o_orderstatus = 'F' THEN 80
    WHEN o_orderstatus = 'O' THEN 70 ELSE 60 END AS order_phase_code,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS order_terminal_flag,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS order_failure_flag,
  (o_orderpriority = '5-LOW' AND l_tax >= 0.075) AS needs_manual_review,
  CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 4 ELSE 3 END AS delivery_state_code,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'rejected'
    WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'pending'
    WHEN l_returnflag = 'A' THEN 'received' ELSE 'completed' END AS order_status,
  CAST(floor(l_quantity * (1 - 4 * l_discount)) AS DOUBLE) AS delivery_quantity,
  CAST(floor(floor(l_quantity * (1 - 4 * l_discount)) * (1 - 2 * l_tax)) AS DOUBLE) AS arrival_quantity,
  CAST(l_shipdate AS DATE) AS delivery_date,
  o_orderpriority AS order_priority,
  lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS province_code,
  lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS city_code,
  lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '01' AS county_code,
  'L' || CAST(c_nationkey % 3 AS VARCHAR) AS hospital_level_code,
  'T' || CAST(c_nationkey % 2 AS VARCHAR) AS ownership_type_code,
  p_type AS drug_category_code, p_name AS drug_name, c_mktsegment AS customer_segment,
  CASE WHEN l_tax < 0.005 AND l_linenumber = 6 THEN NULL
    WHEN o_orderstatus = 'P' AND l_returnflag = 'A' AND l_linenumber = 7 THEN '医院签收'
    WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '拒收'
    WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '已撤销(系统)'
    WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND o_orderpriority = '1-URGENT' THEN '待确认'
    WHEN l_returnflag = 'A' THEN ' 已收货 '
    WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '已完成'
    WHEN l_returnflag = 'N' THEN '结算完毕' ELSE '部分入库' END AS order_status_raw,
  CAST(n_regionkey * 10000 + c_nationkey * 100 + 1 AS VARCHAR) || '.0' AS county_code_raw,
  CASE c_mktsegment WHEN 'FURNITURE' THEN '990100' WHEN 'MACHINERY' THEN NULL
    ELSE lpad(CAST(n_regionkey * 100 + c_nationkey AS VARCHAR), 4, '0') || '00' END AS city_code_raw,
  CASE WHEN p_size >= 48 THEN NULL WHEN p_size >= 40 AND p_type = 'PROMO' THEN p_brand || 'X.0'
    ELSE ' ' || p_brand || '.0' END AS insurance_drug_code,
  CAST(CASE WHEN l_returnflag = 'R' THEN floor(l_quantity / 10) ELSE 0 END AS DOUBLE) AS return_quantity,
  CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 7 THEN l_quantity ELSE 0 END AS DOUBLE) AS void_quantity,
  CASE WHEN p_size % 10 > 0 THEN CAST(p_size % 10 AS DOUBLE) END AS conversion_factor,
  CASE c_nationkey % 5 WHEN 0 THEN '三级甲等' WHEN 1 THEN '二级医院' WHEN 2 THEN '一级' WHEN 3 THEN '社区中心' ELSE '' END AS hospital_level_raw,
  CASE c_nationkey % 4 WHEN 0 THEN '公立医院' WHEN 1 THEN '民营' WHEN 2 THEN '合资' END AS ownership_type_raw
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey
""")

cte("hosp", """
SELECT 'H' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS hospital_code, n_name AS hospital_name,
  lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS region_code, r_name AS region_name,
  'L' || CAST(n_nationkey % 3 AS VARCHAR) AS hospital_level
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
""")
cte("maker", """
SELECT 'M' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS manufacturer_code, 'MAKER ' || n_name AS manufacturer_name
FROM nation
""")
cte("drug", """
SELECT p_brand AS drug_code, min(p_name) AS drug_name, max(p_type) AS drug_category,
  'PL' || CAST(CAST(substr(p_brand, 7) AS INTEGER) % 6 AS VARCHAR) AS product_line_code,
  'LINE PL' || CAST(CAST(substr(p_brand, 7) AS INTEGER) % 6 AS VARCHAR) AS product_line_name
FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#8') GROUP BY p_brand
""")
cte("elig", """
SELECT * FROM ord WHERE order_terminal_flag = 1 AND order_failure_flag <> 1 AND order_phase_code IN (60, 70, 80)
  AND NOT needs_manual_review
""")
cte("evt", """
SELECT row_uid, order_id AS order_detail_id, manufacturer_code, hospital_code, drug_code, drug_code AS drug_group,
  province_code, city_code, county_code, hospital_level_code, ownership_type_code, drug_category_code,
  order_date AS purchase_time, last_day(order_date) AS purchase_month,
  order_quantity AS raw_sensitive_purchase_quantity, order_amount AS raw_sensitive_purchase_amount,
  delivery_quantity AS raw_sensitive_delivery_quantity, arrival_quantity AS raw_sensitive_arrival_quantity,
  order_phase_code, delivery_state_code, order_failure_flag, order_terminal_flag
FROM ord WHERE order_date IS NOT NULL AND length(order_id) > 0
""")
cte("em", """
SELECT manufacturer_code, hospital_code, drug_group, purchase_month, count(order_detail_id) AS order_count,
  max(purchase_time) AS last_purchase_time_in_month,
  sum(raw_sensitive_purchase_quantity) AS purchase_quantity_sum, sum(raw_sensitive_purchase_amount) AS purchase_amount_sum,
  sum(raw_sensitive_delivery_quantity) AS delivery_quantity_sum, sum(raw_sensitive_arrival_quantity) AS arrival_quantity_sum,
  count(*) FILTER (order_failure_flag = 1) AS failed_count, count(*) FILTER (delivery_state_code = 5) AS received_count,
  count(*) FILTER (order_terminal_flag = 1) AS terminal_count,
  first(province_code ORDER BY purchase_time, row_uid) AS province_code,
  first(city_code ORDER BY purchase_time, row_uid) AS city_code,
  first(county_code ORDER BY purchase_time, row_uid) AS county_code,
  first(hospital_level_code ORDER BY purchase_time, row_uid) AS hospital_level_code,
  first(ownership_type_code ORDER BY purchase_time, row_uid) AS ownership_type_code,
  first(drug_category_code ORDER BY purchase_time, row_uid) AS drug_category_code,
  last(order_phase_code ORDER BY purchase_time, row_uid) AS last_order_phase_code_in_month,
  last(delivery_state_code ORDER BY purchase_time, row_uid) AS last_delivery_state_code_in_month,
  last(order_failure_flag ORDER BY purchase_time, row_uid) AS last_order_failure_flag_in_month
FROM evt GROUP BY manufacturer_code, hospital_code, drug_group, purchase_month
""")
