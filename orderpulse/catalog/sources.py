"""Source, sink, view and model-training queries."""

from pyspark.sql import functions as F

from orderpulse.catalog import common
from orderpulse.catalog import evaluation as EV
from orderpulse.catalog import events as EQ
from orderpulse.catalog import rules as RQ
from orderpulse.catalog.base import query, rnd
from orderpulse.functions.exprs import round_all
from orderpulse.session import cut_lineage
from orderpulse.sources import batch as B
from orderpulse.sources import star


@query("source_scoped_window", """
WITH w AS (SELECT * FROM ord WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'),
t AS (SELECT manufacturer_code FROM w GROUP BY ALL ORDER BY count(*) DESC, manufacturer_code LIMIT 3)
SELECT row_uid, manufacturer_code, order_date FROM w WHERE manufacturer_code IN (SELECT manufacturer_code FROM t)
""")
def _(spark, sf):
    return B.scoped_orders(common.orders(spark, sf), "2000-01-01", "2000-12-31", top=3).select("row_uid", "manufacturer_code", "order_date")


@query("source_projected_scan", "SELECT order_id, drug_code, order_quantity FROM ord WHERE province_code = '01' AND manufacturer_code = 'M02'")
def _(spark, sf):
    cols = ["order_id", "drug_code", "order_quantity", "generic_name"]
    return B.project_known(common.orders(spark, sf), cols, ["order_id", "drug_code"], province_code="01", manufacturer_code="M02", enterprise=None)


@query("source_schema_mapping", "SELECT order_id AS id, order_quantity AS qty, hospital_code AS org_code FROM ord")
def _(spark, sf):
    o = common.orders(spark, sf).select("order_id", "order_quantity", "hospital_code")
    return B.rename(o, {"order_id": "id", "order_quantity": "qty", "hospital_code": "org_code"}, ["id", "qty"])


def views(spark, sf):
    return B.create_views(RQ.unit_orders(spark, sf).drop("product_line_code"), star.product_line_mapping(spark, sf))


@query("view_canonical_orders", f"""
SELECT order_id, drug_code, org_code, order_date AS order_time, purchase_qty, {rnd('purchase_amount', 6)} AS purchase_amount, {rnd('purchase_amount / nullif(purchase_qty, 0)', 6)} AS purchase_price, manufacturer_code AS manufacturer,
  delivery_qty, delivery_date AS delivery_time, receipt_qty, NULL::DATE AS receipt_time FROM uo JOIN (SELECT row_uid, manufacturer_code FROM ord) USING (row_uid)
""")
def _(spark, sf):
    maker = common.orders(spark, sf).select("row_uid", F.col("manufacturer_code").alias("manufacturer"))
    B.create_views(RQ.unit_orders(spark, sf).join(maker, "row_uid"), star.product_line_mapping(spark, sf))
    return round_all(spark.table("v_canonical_orders"), 6)


@query("view_unit_order_events", f"SELECT order_id, org_code, m.product_line_code, product_line_name, o.drug_code, order_date AS order_time, purchase_qty, {rnd('purchase_amount', 6)} AS purchase_amount FROM uo o JOIN drug m ON o.drug_code = m.drug_code")
def _(spark, sf):
    return round_all(views(spark, sf).table("v_unit_order_events"), 6)


@query("view_unit_monthly", """
SELECT o.org_code, m.product_line_code, date_trunc('month', order_date)::DATE AS month_start, count(DISTINCT order_id) AS order_count, count(DISTINCT o.drug_code) AS active_drug_count, sum(purchase_qty) AS purchase_qty
FROM uo o JOIN drug m ON o.drug_code = m.drug_code GROUP BY o.org_code, m.product_line_code, date_trunc('month', order_date)
""")
def _(spark, sf):
    return views(spark, sf).table("v_unit_monthly_agg")


@query("view_unit_baseline", """
SELECT o.org_code, m.product_line_code, max(order_date) AS last_order_time, count(DISTINCT order_id) AS historical_order_count, count(DISTINCT o.drug_code) AS historical_drug_count
FROM uo o JOIN drug m ON o.drug_code = m.drug_code GROUP BY o.org_code, m.product_line_code
""")
def _(spark, sf):
    return views(spark, sf).table("v_unit_baseline_snapshot")


@query("export_detector_input_audit", """
SELECT count(*) FILTER (order_terminal_flag = 1 AND order_failure_flag <> 1 AND order_phase_code IN (60, 70, 80) AND NOT needs_manual_review) AS eligible_rows, count(*) AS order_rows,
  count(*) FILTER (purchase_unit IS NULL) AS purchase_unit_missing_rows, count(*) FILTER (coalesce(purchase_unit_price, 0) <= 0) AS purchase_unit_price_nonpositive_rows FROM ord
""")
def _(spark, sf):
    from orderpulse.operators.cleaning import classify_eligibility

    return classify_eligibility(common.orders(spark, sf)).agg(
        F.count_if("detector_order_eligible").alias("eligible_rows"), F.count(F.lit(1)).alias("order_rows"),
        F.expr("count_if(purchase_unit is null) as purchase_unit_missing_rows"),
        F.expr("count_if(coalesce(purchase_unit_price, 0) <= 0) as purchase_unit_price_nonpositive_rows"),
    )


def index(spark, sf):
    days = EQ.results(spark, sf).groupBy("observation_date", "detector_id").agg(F.count(F.lit(1)).alias("rows"))
    return days.selectExpr("*", "explode(array('b1', 'b2')) as batch_id").where("not (batch_id = 'b2' and detector_id = 'first_purchase_fact')")


@query("publish_latest_component", """
SELECT observation_date, detector_id, CASE WHEN detector_id = 'first_purchase_fact' THEN 'b1' ELSE 'b2' END AS batch_id FROM res GROUP BY ALL
""")
def _(spark, sf):
    return B.latest_components(index(spark, sf)).select("observation_date", "detector_id", "batch_id")


@query("publish_pending_components", """
WITH want AS (SELECT observation_date, d AS detector_id FROM (SELECT observation_date FROM obs UNION ALL SELECT DATE '2001-06-30'), (VALUES ('low_price_warning'), ('first_purchase_fact')) t(d))
SELECT * FROM want EXCEPT SELECT DISTINCT observation_date, detector_id FROM res
""")
def _(spark, sf):
    return B.pending_components(index(spark, sf), [*common.OBSERVATION_DATES, "2001-06-30"], ["low_price_warning", "first_purchase_fact"])


@query("publish_split_components", """
SELECT observation_date, detector_id, manufacturer_code, hospital_code, drug_code, 'run-' || detector_id || '-' || observation_date AS run_id,
  row_number() OVER (PARTITION BY observation_date, detector_id ORDER BY round(comparison_value, 6) DESC NULLS LAST, 'run|' || observation_date || '|' || detector_id || '|' || manufacturer_code || '|' || hospital_code || '|' || drug_code || '|' || coalesce(purchase_unit, '')) AS display_rank
FROM res WHERE hit_flag
""")
def _(spark, sf):
    hits = EQ.results(spark, sf).where("hit_flag")
    hits = hits.withColumnRenamed("detector_result_id", "detector_clue_id").withColumn("detector_score", F.round("comparison_value", 6))
    return B.split_components(hits, "run").select("observation_date", "detector_id", "manufacturer_code", "hospital_code", "drug_code", "run_id", "display_rank")


@query("publish_split_conservation", """
SELECT observation_date, detector_id, count(*) AS source_rows, count(*) AS component_rows, CAST(1 AS BIGINT) AS component_runs, count(*) AS last_rank, true AS conserved FROM res WHERE hit_flag GROUP BY ALL
""")
def _(spark, sf):
    hits = cut_lineage(EQ.results(spark, sf).where("hit_flag").withColumnRenamed("detector_result_id", "detector_clue_id").withColumn("detector_score", F.round("comparison_value", 6)))
    checked = B.split_conservation(hits, B.split_components(hits, "run"))
    return checked.select("observation_date", "detector_id", "source_rows", "component_rows", "component_runs", F.col("last_rank").cast("long"), "conserved")


@query("train_logistic_per_horizon")
def _(spark, sf):
    from orderpulse.operators.metrics import full_metrics
    from orderpulse.plans import training as TR

    rows = cut_lineage(EV.frame(spark, sf))
    models = TR.train_per_horizon(rows, "cutoff_month <= date'1999-12-31'", ["H3", "H6", "H12"])
    s = TR.score_per_horizon(rows.where("cutoff_month > date'1999-12-31'"), models)
    return round_all(full_metrics(s.select("horizon", "y", F.col("model_probability").alias("p")), ["horizon"]), 4)


@query("train_calibration")
def _(spark, sf):
    from orderpulse.plans import training as TR

    rows = cut_lineage(EV.frame(spark, sf).where("horizon = 'H3'"))
    models = TR.train_per_horizon(rows, "cutoff_month <= date'1999-06-30'", ["H3"])
    s = cut_lineage(TR.score_per_horizon(rows, models).withColumn("y", F.col("y").cast("double")))
    c = TR.calibrate(s, "cutoff_month = date'1999-12-31'", "cutoff_month > date'1999-12-31'")
    return round_all(TR.calibration_choice(c), 4)
