"""Closure tables, bundles, checks and backtest frames on small frames of their own."""

import datetime as dt

from pyspark.sql import functions as F

from orderpulse.operators import backtest_frames as BF
from orderpulse.operators import closure as C
from orderpulse.operators import serving as G

DAY = dt.date(2020, 6, 30)


def candidates(spark):
    rows = [  # entity, sample class, shape, level, p
        ("e1", "recurring", "smooth", "probability_allowed", 0.9), ("e2", "recurring", "lumpy", "risk_band_only", 0.5), ("e3", "one_shot", "smooth", "hidden_data_insufficient", 0.4),
        ("e4", "recurring", "smooth", "hidden_data_insufficient", None), ("e5", "recurring", "smooth", "risk_band_only", 0.3), ("e6", "recurring", "smooth", "risk_band_only", 0.2),
    ]
    made = [(e, f"{e}|H6", DAY, "H6", "m", f"h{i % 2}", "d", s, shape, level, p) for i, (e, s, shape, level, p) in enumerate(rows)]
    return spark.createDataFrame(made, "entity_id string, candidate_id string, cutoff_month date, horizon string, manufacturer_code string, hospital_code string, drug_group string, sample_class string, demand_shape_label string, probability_display_level string, p double")


def outputs(spark):
    rows = [("e1|H6", f"rule{i}", True, "high") for i in range(7)] + [("e1|H6", "rule9", False, "none"), ("e5|H6", "rule1", True, "medium"), ("other|H6", "rule1", True, "high")]
    return spark.createDataFrame([(c, DAY, d, h, s) for c, d, h, s in rows], "candidate_id string, cutoff_month date, detector_name string, hit_flag boolean, severity string")


def closed(spark):
    survival = spark.createDataFrame([("e1", DAY, "materially_overdue")], "entity_id string, cutoff_month date, survival_state string")
    return C.closure_status(candidates(spark), survival, outputs(spark))


def test_status_and_bundle_round_trip(spark):
    status = closed(spark)
    found = {r["entity_id"]: (r["final_candidate_status"], r["review_priority"]) for r in status.collect()}
    assert found == {
        "e1": ("priority_review", "P0"), "e2": ("observation_only", "P2"), "e3": ("one_shot_attention", "P2"), "e4": ("not_actionable", "P3"), "e5": ("manual_review", "P1"), "e6": ("low_confidence_watch", "P2")}
    read = {r["candidate_id"]: r for r in C.read_bundles(C.evidence_bundles(status, outputs(spark))).collect()}
    assert len(read) == 6 and [d["detector_name"] for d in read["e1|H6"]["detectors"]] == [f"rule{i}" for i in range(7)]
    assert read["e1|H6"]["probability"] == 0.9 and read["e5|H6"]["probability"] is None and read["e6|H6"]["detectors"] == []
    assert read["e1|H6"]["survival_state"] == "materially_overdue" and read["e1|H6"]["cutoff_month"] == DAY and read["e1|H6"]["forbidden_claims"] == C.FORBIDDEN_CLAIMS


def test_tables_conserve_rows(spark):
    t = C.closure_tables(closed(spark), outputs(spark))
    cards = {r["risk_entity_id"]: r["risk_card_count"] for r in t["risk_entities"].collect()}
    assert sorted(cards.values()) == [1, 1, 1, 1, 2, 5] and t["risk_cards"].count() == 11 and t["risk_card_evidence"].count() == 5
    for name in ("hospital_aggregates", "drug_aggregates", "monthly_reports"):
        assert t[name].agg(F.sum("risk_entity_count")).first()[0] == 6
    assert t["monthly_reports"].first()["high_risk_count"] == 1


ROWS = {"parent": {"positive": "v > 0", "named": "name is not null"}, "child": {"text": "length(t) > 0"}}


def failed(spark, parent, child):
    tables = {"parent": spark.createDataFrame(parent, "id int, v int, name string, n long"), "child": spark.createDataFrame(child, "id int, t string")}
    checks = C.run_checks(tables, ROWS, {"parent": ["id"]}, [("child", "id", "parent")], [("parent", "n", "child")])
    return {(r["table_name"], r["check_name"]): r["violations"] for r in checks.collect() if not r["passed"]}


def test_a_failing_input_fails_exactly_its_check(spark):
    good, child = [(1, 5, "a", 2), (2, 6, "b", 0)], [(1, "x"), (1, "y")]
    assert failed(spark, good, child) == {}
    assert failed(spark, [(1, None, "a", 2), (2, 6, "b", 0)], child) == {("parent", "positive"): 1}
    assert failed(spark, [(1, 5, None, 2), (2, 6, None, 0)], child) == {("parent", "named"): 2}
    assert failed(spark, [*good, (2, 6, "b", 0)], child) == {("parent", "unique_id"): 1}
    assert failed(spark, good, [(1, "x"), (3, "y")]) == {("child", "id_in_parent"): 1}
    assert failed(spark, good, [(1, "x"), (1, "")]) == {("child", "text"): 1}
    assert failed(spark, good, [(1, "x")]) == {("parent", "n_adds_up_to_child"): 1}
    assert failed(spark, [(1, 5, "a", 0)], []) == {("child", "has_rows"): 1}


def test_policies_against_sorting(spark):
    rows = [("m", "h", f"d{i:02d}", "H3", (i * 37 % 41) / 41, (i * 17 % 43) / 43, float(i), int(i * 7 % 5 == 0) if i % 9 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "manufacturer_code string, hospital_code string, drug_group string, horizon string, p double, q double, v double, y int")
    got = {(r["policy"], r["k"]): r for r in BF.policy_topk(frame, {"a": ("p", "y"), "b": ("q", "y")}, ["p"], ["v"], [5, "top_10_pct", 1000]).collect()}
    known = [r for r in rows if r[7] is not None]
    for policy, column in (("a", 4), ("b", 5)):
        order = sorted(known, key=lambda r: (-r[column], r[2]))
        for k, n in ((5, 5), ("top_10_pct", -(-len(known) // 10)), (1000, len(known))):
            r, top = got[policy, str(k)], order[:n]
            assert (r["topk_count"], r["hit_count"]) == (n, sum(x[7] for x in top)) and abs(r["sum_v"] - sum(x[6] for x in top)) < 1e-9
    overlap = {r["k"]: r["overlap_count"] for r in BF.policy_overlap(frame, {"a": "p", "b": "q"}, "y", [5]).collect()}
    best = lambda c: {x[2] for x in sorted(known, key=lambda r: (-r[c], r[2]))[:5]}
    assert overlap == {"5": len(best(4) & best(5))}


def test_open_windows_show_no_label(spark):
    key = ("m", "h", "d", DAY, "H3")
    scored = spark.createDataFrame([("c", *key, 0.5, 1.0, 0.5)], "candidate_id string, manufacturer_code string, hospital_code string, drug_group string, cutoff_month date, horizon string, p double, v double, prio double")
    labels = spark.createDataFrame([(*key, 0, 1, False)], "manufacturer_code string, hospital_code string, drug_group string, cutoff_month date, horizon string, label_alive int, label_die int, label_window_closed boolean")
    status = spark.createDataFrame([("c", DAY, "s", "P1", "weak")], "candidate_id string, cutoff_month date, final_candidate_status string, review_priority string, evidence_strength string")
    hits = spark.createDataFrame([("c", DAY, f"r{i}", True, None if i else "z") for i in range(7)], "candidate_id string, cutoff_month date, detector_name string, hit_flag boolean, reason_code string")
    r = BF.recurring_frame(scored, labels, status, hits).first()
    assert r["label_die"] is None and r["label_alive"] is None and r["label_window_end"] == dt.date(2020, 9, 30) and r["detector_hit_summary"] == "r0:z;r1:;r2:;r3:;r4:"


def test_places_put_unreadable_values_last(spark):
    rows = [("a", "3"), ("b", "x"), ("c", "10"), ("d", None), ("e", "3")]
    frame = spark.createDataFrame(rows, "id string, value string")
    up = {r["id"]: r["place"] for r in G.typed_places(frame, "value", "number", False, ["id"]).collect()}
    down = {r["id"]: r["place"] for r in G.typed_places(frame, "value", "number", True, ["id"]).collect()}
    assert up == {"a": 1, "e": 2, "c": 3, "b": 4, "d": 5} and down == {"c": 1, "a": 2, "e": 3, "b": 4, "d": 5}
