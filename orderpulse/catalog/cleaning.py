"""Cleaning queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog.base import query, rnd
from orderpulse.functions.exprs import round_all
from orderpulse.operators import cleaning as C
from orderpulse.sources import star


@query("clean_dedupe_orders", """
SELECT order_detail_id, min(row_uid) AS row_uid, count(*) > 1 AS was_repeated FROM ord GROUP BY order_detail_id
""")
def _(spark, sf):
    o = common.orders(spark, sf).select("order_detail_id", "row_uid")
    kept = C.dedupe_by(o, "order_detail_id", ["row_uid"])
    n = o.groupBy("order_detail_id").agg((F.count(F.lit(1)) > 1).alias("was_repeated"))
    return kept.join(n, "order_detail_id")


@query("clean_normalize_code", """
SELECT drug_code, insurance_drug_code, trim(regexp_replace(insurance_drug_code, '\\.0$', '')) AS clean_code,
  count(*) AS n FROM ord GROUP BY ALL
""")
def _(spark, sf):
    o = common.orders(spark, sf)
    return o.groupBy("drug_code", "insurance_drug_code").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "clean_code", C.normalize_code("insurance_drug_code")
    )


@query("clean_region_codes", """
WITH c AS (SELECT row_uid, lpad(trim(regexp_replace(county_code_raw, '\\.0$', '')), 6, '0') AS county_code,
  lpad(trim(regexp_replace(city_code_raw, '\\.0$', '')), 6, '0') AS raw_city FROM ord)
SELECT row_uid, county_code, substr(county_code, 1, 2) || '0000' AS province_code,
  substr(county_code, 1, 4) || '00' AS city_code,
  CASE WHEN raw_city <> substr(county_code, 1, 4) || '00' THEN 1 ELSE 0 END AS region_dirty_flag FROM c
""")
def _(spark, sf):
    return C.derive_region_codes(common.orders(spark, sf)).select(
        "row_uid", "county_code", "province_code", "city_code", "region_dirty_flag"
    )


@query("clean_region_map_conflicts", """
WITH r AS (SELECT DISTINCT province_code, city_code, county_code, customer_segment, n_name AS city_name, r_name AS province_name
  FROM ord JOIN nation ON hospital_code = 'H' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') JOIN region ON n_regionkey = r_regionkey)
SELECT 'province_code_to_city_name' AS "check", province_code AS code, count(DISTINCT city_name) AS name_distinct_count
FROM r GROUP BY province_code HAVING count(DISTINCT city_name) > 1
UNION ALL SELECT 'city_code_to_city_name', city_code, count(DISTINCT city_name) FROM r GROUP BY city_code HAVING count(DISTINCT city_name) > 1
UNION ALL SELECT 'county_code_to_customer_segment', county_code, count(DISTINCT customer_segment) FROM r GROUP BY county_code HAVING count(DISTINCT customer_segment) > 1
""")
def _(spark, sf):
    o = common.orders(spark, sf).join(star.hospital_master(spark, sf), "hospital_code")
    regions = C.region_map(
        o.withColumnRenamed("hospital_name", "city_name").withColumnRenamed("region_name", "province_name"),
        ["province_code", "city_code", "county_code"], ["city_name", "province_name", "customer_segment"],
    )
    return C.code_name_conflicts(
        regions,
        [("province_code", "city_name"), ("city_code", "city_name"), ("county_code", "customer_segment")],
    )


def _values(rows):
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_WORDS = _values([(w, *g[1:]) for g in C.STATUS_LIFECYCLE for w in g[0]])
_STATUS_SQL = f"""
WITH words AS (SELECT * FROM (VALUES {_WORDS}) t(word, order_phase_code, order_phase_label, delivery_state_code,
  delivery_state_label, order_terminal_flag, order_failure_flag, needs_manual_review)),
texts AS (SELECT DISTINCT trim(coalesce(order_status_raw, '')) AS norm FROM ord),
hits AS (SELECT norm, (SELECT min(word) FROM words WHERE word = norm) AS exact,
  (SELECT min(word) FROM words WHERE contains(norm, word)) AS part FROM texts),
mapped AS (SELECT h.norm AS order_status_norm, coalesce(w.order_phase_code, 0) AS order_phase_code,
  coalesce(order_phase_label, 'unknown') AS order_phase_label, coalesce(delivery_state_code, 0) AS delivery_state_code,
  coalesce(delivery_state_label, 'unknown') AS delivery_state_label, coalesce(order_terminal_flag, -1) AS order_terminal_flag,
  coalesce(order_failure_flag, -1) AS order_failure_flag, coalesce(needs_manual_review, true) AS needs_manual_review
  FROM hits h LEFT JOIN words w ON w.word = coalesce(exact, part)),
st AS (SELECT row_uid, order_status_raw, m.* FROM ord JOIN mapped m ON trim(coalesce(order_status_raw, '')) = m.order_status_norm)
"""


@query("clean_status_lifecycle", _STATUS_SQL + """
SELECT order_status_norm, order_phase_code, order_phase_label, delivery_state_code, delivery_state_label,
  order_terminal_flag, order_failure_flag, needs_manual_review, count(*) AS n FROM st GROUP BY ALL
""")
def _(spark, sf):
    mapped = C.map_status_lifecycle(common.orders(spark, sf))
    return mapped.groupBy("order_status_norm", *C.LIFECYCLE_FIELDS).agg(F.count(F.lit(1)).alias("n"))


@query("clean_status_coverage", _STATUS_SQL + f"""
SELECT 'summary' AS metric_group, 'total_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM st
UNION ALL SELECT 'summary', 'mapped_rows', count(*) FILTER (order_phase_code <> 0) FROM st
UNION ALL SELECT 'summary', 'unmapped_rows', count(*) FILTER (order_phase_code = 0) FROM st
UNION ALL SELECT 'summary', 'mapping_coverage', {rnd("count(*) FILTER (order_phase_code <> 0) / count(*)")} FROM st
UNION ALL SELECT 'order_phase_code', CAST(order_phase_code AS VARCHAR), count(*) FROM st GROUP BY order_phase_code
UNION ALL SELECT 'delivery_state_code', CAST(delivery_state_code AS VARCHAR), count(*) FROM st GROUP BY delivery_state_code
UNION ALL SELECT 'order_terminal_flag', CAST(order_terminal_flag AS VARCHAR), count(*) FROM st GROUP BY order_terminal_flag
UNION ALL SELECT 'order_failure_flag', CAST(order_failure_flag AS VARCHAR), count(*) FROM st GROUP BY order_failure_flag
""")
def _(spark, sf):
    return round_all(C.status_mapping_coverage(C.map_status_lifecycle(common.orders(spark, sf))))


@query("clean_status_suspicious", """
WITH s AS (SELECT row_uid, coalesce(order_status_raw, '') AS t, delivery_state_code AS d, order_failure_flag AS f,
  order_phase_code AS p, needs_manual_review AS r FROM ord)
SELECT row_uid, 'receive_keyword_not_received_state' AS suspicious_reason, 'hard' AS suspicious_level FROM s
  WHERE regexp_matches(t, '收货|入库|到货') AND NOT regexp_matches(t, '拒绝收货|拒收|待收货') AND d <> 5
UNION ALL SELECT row_uid, 'failure_keyword_not_failure_flag', 'hard' FROM s
  WHERE regexp_matches(t, '拒绝|无法|缺货|作废|撤销|撤单|失效|退货|拒收') AND NOT regexp_matches(t, '未作废') AND f <> 1
UNION ALL SELECT row_uid, 'pending_confirm_keyword_late_phase', 'hard' FROM s
  WHERE regexp_matches(t, '未确认|待确认') AND NOT regexp_matches(t, '未确认送货') AND p >= 30
UNION ALL SELECT row_uid, 'dispatch_keyword_not_dispatch_state', 'hard' FROM s
  WHERE regexp_matches(t, '全部发货|已发货|已配送|部分配送|部分发货|已出库|出库') AND NOT regexp_matches(t, '待发货|未发货')
  AND NOT regexp_matches(t, '无法配送|拒绝配送|企业拒绝配送|拒绝响应|拒绝确认|缺货|未及时配送|未作废') AND d NOT IN (3, 4)
UNION ALL SELECT row_uid, 'empty_status_not_manual_review', 'hard' FROM s WHERE t = '' AND NOT r
""")
def _(spark, sf):
    return C.suspicious_status(common.orders(spark, sf)).select("row_uid", "suspicious_reason", "suspicious_level")


@query("clean_categorical_maps", """
SELECT hospital_level_raw, ownership_type_raw,
  CASE WHEN trim(hospital_level_raw) = '' THEN '未知' WHEN contains(hospital_level_raw, '一级') THEN '一级'
    WHEN contains(hospital_level_raw, '二级') THEN '二级' WHEN contains(hospital_level_raw, '三级') THEN '三级' ELSE '其他' END AS hospital_level_label,
  CASE WHEN trim(hospital_level_raw) = '' THEN -1 WHEN contains(hospital_level_raw, '一级') THEN 1
    WHEN contains(hospital_level_raw, '二级') THEN 2 WHEN contains(hospital_level_raw, '三级') THEN 3 ELSE 9 END AS hospital_level_code,
  CASE WHEN ownership_type_raw IS NULL THEN '未知' WHEN contains(ownership_type_raw, '公立') THEN '公立'
    WHEN contains(ownership_type_raw, '民营') OR contains(ownership_type_raw, '私立') THEN '民营' ELSE '其他' END AS ownership_type_label,
  CASE WHEN ownership_type_raw IS NULL THEN -1 WHEN contains(ownership_type_raw, '公立') THEN 1
    WHEN contains(ownership_type_raw, '民营') OR contains(ownership_type_raw, '私立') THEN 2 ELSE 9 END AS ownership_type_code,
  count(*) AS n FROM ord GROUP BY ALL
""")
def _(spark, sf):
    o = C.map_ownership(C.map_hospital_level(common.orders(spark, sf)))
    return o.groupBy(
        "hospital_level_raw", "ownership_type_raw", "hospital_level_label", "hospital_level_code",
        "ownership_type_label", "ownership_type_code",
    ).agg(F.count(F.lit(1)).alias("n"))


@query("clean_category_codes", """
SELECT drug_category_code, count(*) AS "count",
  row_number() OVER (ORDER BY count(*) DESC, drug_category_code) AS drug_category_code_code
FROM ord GROUP BY drug_category_code
""")
def _(spark, sf):
    return C.category_codes(common.orders(spark, sf), "drug_category_code")


@query("clean_derived_ratios", f"""
SELECT row_uid, {rnd("delivery_quantity / nullif(order_quantity, 0)")} AS delivery_rate,
  {rnd("arrival_quantity / nullif(delivery_quantity, 0)")} AS arrival_rate,
  {rnd("arrival_quantity / nullif(order_quantity, 0)")} AS overall_arrival_rate,
  {rnd("(purchase_unit_price * delivery_quantity) / nullif(order_amount, 0)")} AS delivery_amount_to_purchase_amount_ratio,
  {rnd("(purchase_unit_price * arrival_quantity) / nullif(purchase_unit_price * delivery_quantity, 0)")} AS arrival_amount_to_delivery_amount_ratio,
  {rnd("(purchase_unit_price * arrival_quantity) / nullif(order_amount, 0)")} AS arrival_amount_to_purchase_amount_ratio
FROM ord
""")
def _(spark, sf):
    o = common.orders(spark, sf).withColumns(
        {
            "delivery_amount": F.col("purchase_unit_price") * F.col("delivery_quantity"),
            "arrival_amount": F.col("purchase_unit_price") * F.col("arrival_quantity"),
        }
    )
    d = C.derived_ratios(o)
    return round_all(
        d.select(
            "row_uid", "delivery_rate", "arrival_rate", "overall_arrival_rate",
            "delivery_amount_to_purchase_amount_ratio", "arrival_amount_to_delivery_amount_ratio",
            "arrival_amount_to_purchase_amount_ratio",
        )
    )


@query("clean_order_eligibility", """
SELECT row_uid, CASE WHEN order_terminal_flag <> 1 THEN 'not_terminal' WHEN order_failure_flag = 1 THEN 'failure_or_cancelled_terminal'
  WHEN order_phase_code NOT IN (60, 70, 80) THEN 'non_normal_terminal_phase' WHEN needs_manual_review THEN 'manual_review_required'
  ELSE 'eligible_normal_completion' END AS detector_exclusion_reason,
  (order_terminal_flag = 1 AND order_failure_flag <> 1 AND order_phase_code IN (60, 70, 80) AND NOT needs_manual_review) AS detector_order_eligible
FROM ord
""")
def _(spark, sf):
    return C.classify_eligibility(common.orders(spark, sf)).select(
        "row_uid", "detector_exclusion_reason", "detector_order_eligible"
    )


@query("clean_drug_code_flags", """
WITH c AS (SELECT row_uid, drug_code AS d, trim(regexp_replace(insurance_drug_code, '\\.0$', '')) AS i FROM ord),
k AS (SELECT d FROM c WHERE i IS NOT NULL GROUP BY d HAVING count(DISTINCT i) > 1)
SELECT row_uid, CASE WHEN i IS NULL THEN -1 WHEN d = i THEN 1 ELSE 0 END AS drug_code_match_flag,
  CASE WHEN d IN (SELECT d FROM k) THEN 1 ELSE 0 END AS drug_code_conflict_flag FROM c
""")
def _(spark, sf):
    return C.drug_code_flags(common.orders(spark, sf)).select(
        "row_uid", "drug_code_match_flag", "drug_code_conflict_flag"
    )


@query("clean_normalize_orders", """
SELECT 'normalized_order_rows' AS metric, count(*) AS value FROM ord WHERE order_date <= DATE '2000-12-31'
UNION ALL SELECT 'manufacturer_count', count(DISTINCT manufacturer_code) FROM ord WHERE order_date <= DATE '2000-12-31'
UNION ALL SELECT 'hospital_count', count(DISTINCT hospital_code) FROM ord WHERE order_date <= DATE '2000-12-31'
UNION ALL SELECT 'drug_count', count(DISTINCT drug_code) FROM ord WHERE order_date <= DATE '2000-12-31'
""")
def _(spark, sf):
    return C.normalized_profile(C.normalize_orders(common.orders(spark, sf), common.CUTOFF))


@query("clean_normalize_masters", """
SELECT 'drug' AS master, drug_code AS code, drug_name AS name FROM drug
UNION ALL SELECT 'hospital', hospital_code, coalesce(hospital_name, '') FROM hosp
UNION ALL SELECT 'manufacturer', manufacturer_code, manufacturer_name FROM maker
""")
def _(spark, sf):
    d = C.normalize_master(star.drug_master(spark, sf), "drug_code", ["drug_code", "drug_name", "drug_category"])
    h = C.normalize_master(star.hospital_master(spark, sf), "hospital_code", ["hospital_code", "hospital_name"])
    m = C.normalize_manufacturer_master(star.manufacturer_master(spark, sf))
    return (
        d.select(F.lit("drug").alias("master"), F.col("drug_code").alias("code"), F.col("drug_name").alias("name"))
        .unionByName(h.select(F.lit("hospital").alias("master"), F.col("hospital_code").alias("code"), F.col("hospital_name").alias("name")))
        .unionByName(
            m.select(
                F.lit("manufacturer").alias("master"), F.col("manufacturer_code").alias("code"),
                F.col("manufacturer_display_name").alias("name"),
            )
        )
    )


def canonical(spark, sf):
    o = common.orders(spark, sf).drop("product_line_code")
    return C.canonicalize_orders(
        o,
        {
            "order_date": "order_time", "hospital_code": "org_code", "order_quantity": "purchase_qty",
            "purchase_unit_price": "purchase_price", "order_amount": "purchase_amount",
        },
    )


@query("clean_canonical_orders", f"""
SELECT row_uid, {rnd("CASE WHEN conversion_factor > 0 THEN purchase_unit_price / conversion_factor ELSE purchase_unit_price END", 10)} AS comparable_unit_price,
  CASE WHEN conversion_factor > 0 THEN '' ELSE 'INVALID_CONVERSION_FACTOR' END AS warnings,
  coalesce(trim(insurance_drug_code), drug_code) AS product_line_code, drug_name FROM ord
""")
def _(spark, sf):
    return round_all(
        canonical(spark, sf).select(
            "row_uid", "comparable_unit_price", F.array_join("canonical_warnings", "|").alias("warnings"),
            F.trim("product_line_code").alias("product_line_code"), "drug_name",
        ), 10,
    )


@query("clean_enrich_product_line", """
SELECT o.row_uid, coalesce(d.product_line_code, o.insurance_drug_code, o.drug_code) AS product_line_code,
  coalesce(d.product_line_name, o.drug_code) AS product_line_name, coalesce(d.drug_name, o.drug_name) AS drug_name
FROM ord o LEFT JOIN drug d ON o.drug_code = d.drug_code
""")
def _(spark, sf):
    return C.enrich_canonical(
        canonical(spark, sf), star.product_line_mapping(spark, sf), star.drug_master(spark, sf)
    ).select("row_uid", "product_line_code", "product_line_name", "drug_name")


@query("clean_derive_dimensions", """
SELECT 'drug' AS dim, drug_code AS code, first(drug_name ORDER BY order_date, row_uid) AS a,
  first(manufacturer_code ORDER BY order_date, row_uid) AS b FROM ord GROUP BY drug_code
UNION ALL SELECT 'org', hospital_code, first(hospital_level_code ORDER BY order_date, row_uid),
  first(county_code ORDER BY order_date, row_uid) FROM ord GROUP BY hospital_code
UNION ALL SELECT 'line', drug_code, first(product_line_code ORDER BY order_date, row_uid), 'fallback_from_order_wide_table' FROM ord GROUP BY drug_code
""")
def _(spark, sf):
    o = common.orders(spark, sf)
    key = ["order_date", "row_uid"]
    d = C.derive_dimension(o, "drug_code", ["drug_name", "manufacturer_code"], key)
    h = C.derive_dimension(o, "hospital_code", ["hospital_level_code", "county_code"], key)
    line = C.derive_line_mapping(o, key)
    return (
        d.select(F.lit("drug").alias("dim"), F.col("drug_code").alias("code"), F.col("drug_name").alias("a"), F.col("manufacturer_code").alias("b"))
        .unionByName(h.select(F.lit("org").alias("dim"), F.col("hospital_code").alias("code"), F.col("hospital_level_code").alias("a"), F.col("county_code").alias("b")))
        .unionByName(line.select(F.lit("line").alias("dim"), F.col("drug_code").alias("code"), F.col("product_line_code").alias("a"), F.col("mapping_rule").alias("b")))
    )


@query("clean_status_text_flags", """
SELECT order_status, CASE WHEN regexp_matches(lower(order_status), 'fail|reject|cancel') THEN 1 ELSE 0 END AS failure_flag,
  1 AS terminal_flag, count(*) AS n FROM ord GROUP BY order_status
""")
def _(spark, sf):
    o = common.orders(spark, sf).select("order_status")
    return (
        o.withColumns({"failure_flag": C.failure_flag(o), "terminal_flag": C.terminal_flag(o)})
        .groupBy("order_status", "failure_flag", "terminal_flag").agg(F.count(F.lit(1)).alias("n"))
    )


@query("clean_effective_purchases", f"""
SELECT manufacturer_code, count(*) AS n, {rnd("sum(order_quantity)", 4)} AS quantity FROM ord
WHERE order_quantity > 0 AND void_quantity = 0 GROUP BY manufacturer_code
""")
def _(spark, sf):
    return round_all(
        C.effective_purchases(common.orders(spark, sf)).groupBy("manufacturer_code")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("order_quantity").alias("quantity")), 4,
    )


@query("clean_detector_orders", f"""
SELECT manufacturer_code || '|' || hospital_code || '|' || drug_code AS entity_id, order_date, order_id, order_quantity,
  {rnd("order_amount", 10)} AS order_amount, {rnd("purchase_unit_price", 10)} AS purchase_unit_price, purchase_unit FROM elig
""")
def _(spark, sf):
    return round_all(
        C.prepare_detector_orders(common.eligible(spark, sf)).select(
            "entity_id", "order_date", "order_id", "order_quantity", "order_amount", "purchase_unit_price", "purchase_unit"
        ), 10,
    )
