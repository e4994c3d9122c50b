"""Operators on small frames with known results."""

import datetime as dt
import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderpulse.operators import cleaning, detectors, events, facts, features, research_rules, snapshot
from orderpulse.sources import batch
from orderpulse.streaming import event_state

ORDER = "row_uid string, order_id string, order_date date, manufacturer_code string, hospital_code string, drug_code string, order_quantity double, order_amount double, purchase_unit string, purchase_unit_price double"


def order_rows(spark, days, entity=("m1", "h1", "d1"), qty=10.0, price=5.0, unit="BOX"):
    rows = [
        (f"{'-'.join(entity)}-{i}", f"o{i:03d}", d, *entity, qty, qty * price, unit, price) for i, d in enumerate(days)
    ]
    return spark.createDataFrame(rows, ORDER)


def d(text):
    return dt.date.fromisoformat(text)


def test_snapshot_gap_median_and_windows(spark):
    days = [d("2025-01-01"), d("2025-01-11"), d("2025-01-21"), d("2025-02-10"), d("2025-06-01"), d("2025-06-01")]
    s = snapshot.detector_snapshot(order_rows(spark, days), ["2025-06-01"]).collect()[0]
    assert s.purchase_count_total == 5  # purchase days, not rows
    assert s.historical_interval_median == 15.0  # gaps 10, 10, 20, 111
    assert s.historical_interval_mad == 5.0
    assert s.recent_quantity == 20.0 and s.recent_order_count == 1
    assert s.baseline_quantity == 40.0 and s.baseline_order_count == 4
    assert s.silence_days == 111 and s.current_order_count == 2
    assert s.current_unit_price == 5.0 and s.first_order_id == "o000"


def test_snapshot_without_baseline_or_unit(spark):
    s = snapshot.detector_snapshot(order_rows(spark, [d("2025-06-01")], unit=None), ["2025-06-01"]).collect()[0]
    assert s.quantity_ratio is None and s.purchase_unit is None and s.previous_purchase_date is None
    r = {x.detector_id: x for x in detectors.detector_results(snapshot.detector_snapshot(order_rows(spark, [d("2025-06-01")], unit=None), ["2025-06-01"])).collect()}
    assert r["first_purchase_fact"].hit_flag
    assert r["low_price_warning"].inapplicable_reason == "purchase_unit_missing"
    assert r["reactivated_purchase_fact"].inapplicable_reason == "no_previous_purchase"


def test_reactivated_and_interval_hits(spark):
    days = [d("2024-01-01"), d("2024-01-11"), d("2024-01-21"), d("2024-01-31"), d("2025-06-01")]
    snap = snapshot.detector_snapshot(order_rows(spark, days), ["2024-03-31", "2025-06-01"])
    r = {(str(x.observation_date), x.detector_id): x for x in detectors.detector_results(snap).collect()}
    assert r["2025-06-01", "reactivated_purchase_fact"].hit_flag
    late = r["2024-03-31", "purchase_interval_ipi"]
    assert late.hit_flag and late.comparison_value == pytest.approx((60 - 10) / 3) and late.severity == "high"


def test_future_orders_never_change_features(spark):
    past = [d("2024-01-05"), d("2024-03-05"), d("2024-04-20")]
    a = order_rows(spark, past)
    b = order_rows(spark, past + [d("2024-09-01"), d("2025-01-01")])

    def at_cutoff(orders):
        em = facts.entity_month(facts.purchase_events(orders))
        f = features.cutoff_features(em, ["2024-06-30"], tiers=False)
        return f.toPandas().T

    pd.testing.assert_frame_equal(at_cutoff(a), at_cutoff(b))
    sa = snapshot.base_snapshot(snapshot.prepared(a), ["2024-06-30"]).toPandas()
    sb = snapshot.base_snapshot(snapshot.prepared(b), ["2024-06-30"]).toPandas()
    pd.testing.assert_frame_equal(sa, sb)


def test_purchase_sequence_same_day(spark):
    e = facts.purchase_events(order_rows(spark, [d("2024-01-01"), d("2024-01-01"), d("2024-01-09")]))
    rows = {r.order_detail_id: r for r in facts.purchase_sequence(e).collect()}
    assert [rows[f"o00{i}"].sequence_index for i in range(3)] == [1, 2, 3]
    assert [rows[f"o00{i}"].gap_days_since_previous_purchase for i in range(3)] == [None, 0, 8]


def test_status_lifecycle(spark):
    s = spark.createDataFrame([(" 已收货 ",), ("部分入库单",), ("医院签收",), (None,), ("未作废",)], "order_status_raw string")
    got = [(r.order_phase_code, r.delivery_state_code, r.needs_manual_review) for r in cleaning.map_status_lifecycle(s).collect()]
    assert got == [(60, 5, False), (60, 5, False), (0, 0, True), (0, 0, True), (0, 0, True)]


KEYS = ["manufacturer_code", "hospital_code", "drug_code"]


def hit_rows():
    """Two shops over a spring week; day, shop, rule, hit. Friday's rules of shop K come in two parts, Monday's late."""
    week = ["2023-04-03", "2023-04-05", "2023-04-07"]
    return [
        (week[1], "K", "stock", True), (week[2], "K", "price", True), (week[2], "K", "rhythm", True), (week[2], "K", "stock", True),
        (week[0], "K", "rhythm", True), (week[0], "K", "price", False), (week[2], "L", "price", True), (week[2], "L", "price", True), (week[1], "L", "stock", False),
    ]


def hit_frame(spark, rows=None):
    full = [(day, f"maker-{shop}", f"site-{shop}", "item", rule, hit) for day, shop, rule, hit in (rows or hit_rows())]
    return spark.createDataFrame(full, "observation_date string, manufacturer_code string, hospital_code string, drug_code string, detector_id string, hit_flag boolean")


def by_hand(rows):
    """{(shop, day): (rules of the day, hits so far, days so far, rules so far)} counted one by one."""
    found = {}
    for shop in {r[1] for r in rows}:
        seen, hits, days = set(), 0, 0
        for day in sorted({r[0] for r in rows if r[1] == shop and r[3]}):
            now = sorted({r[2] for r in rows if r[0] == day and r[1] == shop and r[3]})
            seen, hits, days = seen | set(now), hits + len(now), days + 1
            found[f"maker-{shop}", day] = ("|".join(now), hits, days, "|".join(sorted(seen)))
    return found


def counted(frame):
    return {(r.manufacturer_code, str(r.observation_date)): (r.current_detector_ids, r.cumulative_hit_count, r.cumulative_hit_day_count, r.historical_detector_ids) for r in frame.collect()}


def test_event_aggregates_in_batch(spark):
    want = by_hand(hit_rows())
    assert want["maker-K", "2023-04-07"] == ("price|rhythm|stock", 5, 3, "price|rhythm|stock")
    assert counted(events.event_aggregates(hit_frame(spark))) == want


@pytest.mark.parametrize("parts", [[[0], [1, 2], [3, 5], [4, 6], [7, 8]], [[4, 5], [0, 8], [1, 2, 3, 6, 7]], [[1], [6, 3], [0], [2, 7], [4]]])
def test_stream_keeps_split_and_late_days(spark, tmp_path, parts):
    """Each part is a file and a micro-batch of its own; days are split over files and come out of order."""
    rows = hit_rows()
    for part in parts:
        hit_frame(spark, [rows[k] for k in part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hit_frame(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = event_state.run_available(event_state.aggregate_stream(stream, KEYS), work=str(tmp_path / "work"))
    assert counted(event_state.latest_rows(out, KEYS)) == by_hand([rows[k] for part in parts for k in part])


def test_event_state_merge_equals_batch(spark):
    h, state = hit_frame(spark), None
    for day in ["2023-04-03", "2023-04-05", "2023-04-07"]:
        state = events.merge_state(state, h.where(F.col("observation_date") == day))
    got = {r.manufacturer_code: (r.cumulative_hit_count, r.cumulative_hit_day_count, "|".join(sorted(r.historical_ids))) for r in state.collect()}
    want = by_hand(hit_rows())
    assert got == {"maker-K": want["maker-K", "2023-04-07"][1:], "maker-L": want["maker-L", "2023-04-07"][1:]}


def test_range_aggregates_take_the_newest_batch(spark):
    rows = hit_rows()
    h = hit_frame(spark).withColumn("observation_date", F.to_date("observation_date")).withColumn("batch_id", F.lit("b1"))
    newer = h.where("detector_id = 'price' and manufacturer_code = 'maker-L'").withColumn("batch_id", F.lit("b2"))
    got = events.aggregate_range(h.unionByName(newer), "2023-04-05", "2023-04-07")
    kept = [r for r in rows if r[0] >= "2023-04-05" and not (r[0] == "2023-04-07" and r[2] == "price" and r[1] == "K")]
    assert counted(got) == by_hand(kept)


def test_category_codes_cover_all_categories(spark):
    rows = [(f"c{k:04d}",) for k in range(700)] + [("c0005",), ("c0007",), ("c0007",), (None,)]
    got = {r.c: r.c_code for r in cleaning.category_codes(spark.createDataFrame(rows, "c string"), "c").collect()}
    assert len(got) == 701 and got["c0007"] == 1 and got["c0005"] == 2 and got["c0000"] == 3 and got[None] == 701


def test_interval_overdue_uses_the_deviation(spark):
    gaps = [10.0, 30.0, 20.0, 60.0]  # median 25, deviations 15, 5, 5, 35, their median 10
    frame = spark.createDataFrame([("e", 4.0, gaps), ("f", 4.0, [9.0, 9.0])], "entity_id string, months_since_last_purchase_asof_cutoff double, gaps array<double>")
    frame = frame.withColumn("median_purchase_interval_days_asof_cutoff", F.when(F.col("entity_id") == "e", 25.0).otherwise(9.0))
    frame = frame.withColumn("purchase_interval_mad_days_asof_cutoff", features.median_deviation(F.col("gaps"), F.col("median_purchase_interval_days_asof_cutoff")))
    frame = frame.selectExpr("*", "date'2024-01-31' as cutoff_month", "2.5D as overdue_ratio", "'x' as demand_shape_route", "'slightly_overdue' as survival_state", "0.9D as survival_confidence", "'history_sufficient' as history_sufficiency_flag", "'smooth' as demand_shape_label")
    got = {r.entity_id: r for r in research_rules.interval_overdue_test(frame).collect()}
    assert got["e"].robust_z == pytest.approx((4 * 30.4375 - 25) / 10)
    assert got["e"].p_value == pytest.approx(0.5 * math.erfc(got["e"].robust_z / math.sqrt(2)), rel=1e-9)
    assert got["f"].robust_z is None and got["f"].p_value is None and not got["f"].fdr_eligible


def test_evidence_id_parts(spark):
    import hashlib

    row = ("c|H3", "fam", "det", "v2", "2024-01-31", "H3", "why", None)
    frame = spark.createDataFrame([row], ", ".join(f"{c} string" for c in research_rules.EVIDENCE_PARTS))
    got = research_rules.evidence_ids(frame).collect()[0]
    want = hashlib.sha256(b"c|H3|fam|det|v2|2024-01-31|H3|why|").hexdigest()
    assert got.evidence_hash == want and got.evidence_id == want[:16]


def test_corroboration_levels(spark):
    test, interval, freq, fact = "purchase_frequency_decay_rate_test", "purchase_interval_overdue_warning", "purchase_frequency_fluctuation_warning", "new_terminal_detection"
    rows = [("none", freq, False, "ok", True), ("fact", fact, True, "ok", True), ("one", interval, True, "ok", True), ("ready", test, True, "ok", False), ("same", test, True, "ok", True),
            ("same", freq, True, "ok", True), ("two", interval, True, "ok", True), ("two", freq, True, "ok", True), ("blind", interval, True, "not_evaluable", True), ("held", interval, True, "ok", True)]
    ev = spark.createDataFrame([(e, 1, d_, h, q, f) for e, d_, h, q, f in rows], "entity_id string, cutoff_month int, detector_name string, hit_flag boolean, data_quality_status string, fdr_pass_flag boolean")
    guard = spark.createDataFrame([("held", 1, "policy_caveat"), ("one", 1, "none")], "entity_id string, cutoff_month int, l2_guardrail string")
    level = lambda **k: {r.entity_id: r.corroboration_level for r in research_rules.corroboration(ev, guardrail=guard, **k).collect()}
    assert level() == {"none": "none", "fact": "none", "one": "single_signal", "ready": "provisional_fdr_ready", "same": "provisional_fdr_ready", "two": "multi_signal", "blind": "none", "held": "suppressed_by_l2"}
    assert level(fdr_applied=True)["ready"] == "none" and level(fdr_applied=True)["same"] == "single_signal"


def test_binomial_cdf(spark):
    cases = [(0, 5, 0.25), (2, 9, 0.25), (7, 30, 0.5), (40, 200, 0.25), (3, 3, 0.5)]
    df = spark.createDataFrame(cases, "k int, n int, p double")
    got = df.selectExpr("k", "n", "p", f"{research_rules.binomial_cdf('k', 'n', 'p')} as c").collect()
    for r in got:
        want = sum(math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k + 1))
        assert r.c == pytest.approx(want, rel=1e-9)


def test_normal_tail(spark):
    df = spark.createDataFrame([(0.0,), (1.6448536269514722,), (None,)], "z double")
    z = [-40.0, -8.3, -3.51, -3.49, -1.0, 0.0, 0.3, 1.6448536269514722, 3.49, 3.51, 7.0, 30.0, None]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    got = {r.z: r.p for r in df.selectExpr("z", research_rules.normal_upper_tail("z") + " as p").collect()}
    for x in z[:-1]:
        assert got[x] == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=1e-9, abs=1e-300)


def test_benjamini_hochberg_brute_force(spark):
    import random

    random.seed(5)
    p = [round(random.random() ** 2, 3) for _ in range(200)]
    df = spark.createDataFrame([(f"e{i}", "g", v) for i, v in enumerate(p)], "entity_id string, g string, p_value double")
    got = {r.entity_id: r.fdr_q_value for r in research_rules.benjamini_hochberg(df, ["g"]).collect()}
    order = sorted(range(200), key=lambda i: p[i])
    q, best = {}, 1.0
    for rank in range(200, 0, -1):
        i = order[rank - 1]
        best = min(best, p[i] * 200 / rank)
        q[f"e{i}"] = best
    for k, v in q.items():
        assert got[k] == pytest.approx(v)


def test_raw_batch_reader(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"table_paths": {"orders": "orders.csv", "drug_master": "drug.csv", "hospital_master": "hosp.csv"}}))
    (tmp_path / "orders.csv").write_text("order_quantity,order_id,order_date,manufacturer_code,hospital_code,drug_code,order_amount\n3,o1,2025-01-02,m1,h1,d1,9.5\nx,o2,bad,m1,,d1,1\n")
    (tmp_path / "drug.csv").write_text("drug_code,drug_name\nd1,Drug\n")
    (tmp_path / "hosp.csv").write_text("hospital_code,hospital_name\nh1,Hospital\n")
    t = batch.read_batch(spark, str(tmp_path))
    o = {r.order_id: r for r in t["orders"].collect()}
    assert o["o1"].order_quantity == 3.0 and o["o1"].order_date == d("2025-01-02")
    assert o["o2"].order_quantity is None and o["o2"].order_date is None
    assert t["delivery_events"].count() == 0
    assert cleaning.normalize_orders(t["orders"], "2025-01-31").count() == 1


def test_result_table_is_immutable(spark, tmp_path):
    df = hit_frame(spark)
    batch.write_result(df, str(tmp_path / "t"), ["observation_date"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(hit_rows())
    with pytest.raises(Exception):
        batch.write_result(df, str(tmp_path / "t"), ["observation_date"])


def test_publish_skips_existing_components(spark, tmp_path):
    df = hit_frame(spark).withColumn("observation_date", F.to_date("observation_date"))
    path = str(tmp_path / "p")
    first = batch.publish_components(df.where("observation_date < date'2023-04-05'"), path)
    assert {(str(r.observation_date), r.detector_id): r.rows for r in first.collect()} == {("2023-04-03", "rhythm"): 1, ("2023-04-03", "price"): 1}
    second = {(str(r.observation_date), r.detector_id): r.rows for r in batch.publish_components(df, path).collect()}
    assert second["2023-04-07", "price"] == 3 and ("2023-04-03", "price") not in second
    assert spark.read.parquet(path).count() == len(hit_rows())
    asked = []

    def compute(dates, rules):
        asked.append((dates, rules))
        return df.where(F.col("observation_date").cast("string").isin(dates) & F.col("detector_id").isin(rules))

    assert batch.backfill(compute, path, spark, ["2023-04-03", "2023-04-05"], ["price", "stock"]).count() == 0
    assert asked == [(["2023-04-03", "2023-04-05"], ["price", "stock"])] and spark.read.parquet(path).count() == len(hit_rows())
