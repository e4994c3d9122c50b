"""Audits of evidence bundles with planted faults, the stratified sample against plain Python, horizon views, distributions."""

import datetime as dt
from collections import defaultdict

import pytest

from orderpulse.operators import candidates as K
from orderpulse.operators import closure as C
from orderpulse.operators import reviews as V
from orderpulse.operators import serving as G
from orderpulse.operators import survival as SV

DAY = dt.date(2020, 6, 30)
RECURRING, OBSERVED = "recurring_business_priority", "demand_shape_observation"


def bundles(spark, rows):
    """Rows of a candidate's name and what differs from a bundle without fault."""
    whole = {
        "bundle_id": "b", "cutoff_month": DAY, "candidate_type": RECURRING, "final_candidate_status": "manual_review", "review_priority": "P1", "evidence_strength": "medium", "demand_shape_label": "smooth",
        "probability": 0.7, "probability_display_level": "probability_allowed", "survival_state": "overdue", "auto_dispatch_allowed": False, "detectors": [("rule", "high")],
        "allowed_claims": "review", "forbidden_claims": ["exact churn date"],
    }
    names = [p.split()[0] for p in C.BUNDLE.replace("array<struct<detector_name: string, severity: string>>", "d").replace("\n", " ").split(",")]
    made = [tuple({**whole, "candidate_id": name, **other}[c] for c in names) for name, other in rows]
    return spark.createDataFrame(made, C.BUNDLE)


def test_each_fault_is_named(spark):
    rows = [
        ("fine", {}), ("no claims", {"allowed_claims": " "}), ("null claims", {"allowed_claims": None}), ("none forbidden", {"forbidden_claims": []}), ("null forbidden", {"forbidden_claims": None}),
        ("certain", {"allowed_claims": "The EXACT churn date is known"}), ("one-shot", {"candidate_type": "one_shot"}), ("null detectors", {"detectors": None}),
        ("shown only", {"detectors": [("rule", "high"), ("low_delivery_rate_warning", "high")]}), ("sent", {"auto_dispatch_allowed": True, "forbidden_claims": []}),
    ]
    found = defaultdict(set)
    for r in V.claim_consistency(bundles(spark, rows)).collect():
        assert r["claim_check_pass"] == (r["violation_type"] == "")
        found[r["candidate_id"]].add(r["violation_type"])
    assert dict(found) == {
        "fine": {""}, "no claims": {"allowed_claims_empty"}, "null claims": {"allowed_claims_empty"}, "none forbidden": {"forbidden_claims_empty"}, "null forbidden": {"forbidden_claims_empty"},
        "certain": {"allowed_contains_forbidden_phrase"}, "one-shot": {"one_shot_probability_present"}, "null detectors": {""}, "shown only": {"interface_only_detector_in_evidence"},
        "sent": {"auto_dispatch_allowed", "forbidden_claims_empty"},
    }


def test_missing_fields_by_type(spark):
    rows = [
        ("fine", {}), ("bare", {"probability": None, "survival_state": None, "detectors": []}), ("only rules", {"survival_state": None}), ("null lists", {"detectors": None, "forbidden_claims": None}),
        ("one-shot", {"candidate_type": "one_shot", "probability": None, "survival_state": None}), ("shown one-shot", {"candidate_type": "one_shot"}),
        ("observed", {"candidate_type": OBSERVED, "final_candidate_status": "observation_only"}), ("wrong status", {"candidate_type": OBSERVED, "demand_shape_label": None}),
        ("strange", {"candidate_type": "other"}), ("untyped", {"candidate_type": None}),
    ]
    found = {r["candidate_id"]: r for r in V.actionability(bundles(spark, rows)).collect()}
    assert {k: r["missing_critical_fields"] for k, r in found.items()} == {
        "fine": "", "bare": "probability;survival_state;detectors_or_survival_state", "only rules": "survival_state", "null lists": "forbidden_claims", "one-shot": "", "shown one-shot": "recurring_probability_hidden",
        "observed": "", "wrong status": "demand_shape_label;observation_only_status", "strange": "unknown_candidate_type", "untyped": "unknown_candidate_type"}
    assert all(r["actionable_flag"] == (r["missing_critical_fields"] == "") for r in found.values())


def test_completeness_shares(spark):
    rows = [("a", {}), ("b", {"probability": None, "detectors": []}), ("c", {"detectors": None, "auto_dispatch_allowed": True}), ("d", {"probability": None, "auto_dispatch_allowed": None}), ("e", {"review_priority": None})]
    found = {r["review_priority"]: r for r in V.field_completeness(bundles(spark, rows)).collect()}
    assert found["P1"]["row_count"] == 4 and found[None]["row_count"] == 1
    assert [found["P1"][f"{c}_rate"] for c in ("probability", "detectors", "survival_state", "auto_dispatch_false")] == [0.5, 0.5, 1.0, 0.75]
    assert V.field_completeness(bundles(spark, rows).limit(0)).count() == 0 and V.actionability(bundles(spark, rows).limit(0)).count() == 0


def test_stratified_sample(spark):
    statuses = [*V.STATUS_ORDER, None]
    rows = [(f"c{i:04}", DAY, statuses[i % 7], [OBSERVED, "one_shot", RECURRING][i % 3], [f"P{i % 4}", None][i % 11 == 0], ["weak", "insufficient"][i % 5 == 0], [None, float(i % 13)][i % 6 > 0]) for i in range(1500)]
    df = spark.createDataFrame(rows, "candidate_id string, cutoff_month date, final_candidate_status string, candidate_type string, review_priority string, evidence_strength string, score double").repartition(5)
    place = {"final_candidate_status": 2, "candidate_type": 3, "review_priority": 4, "evidence_strength": 5}
    order = lambda r: (r[4] is None, r[4] or "", statuses.index(r[2]), r[6] is None, -(r[6] or 0), r[0])
    want = {r[0] for column, limits in V.STRATA.items() for value, n in limits.items() for r in sorted((r for r in rows if r[place[column]] == value), key=order)[:n]}
    got = [r["candidate_id"] for r in V.stratified_sample(df, "score", ["candidate_id", "cutoff_month"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def view(spark, horizon, profiles, frame=None):
    rows = frame or [("e1", DAY, "H6", "own", "source"), ("e2", DAY, "H3", "own", None), ("e3", DAY, None, "own", None)]
    entities = spark.createDataFrame(rows, "risk_entity_id string, report_month date, primary_horizon string, risk_level string, involved_amount_source string")
    made = spark.createDataFrame(profiles, "risk_entity_id string, report_month date, horizon string, risk_probability double, risk_level string, involved_amount_source string, updated_at int")
    found, notices = G.horizon_view(entities, made, horizon)
    return {r["risk_entity_id"]: r.asDict() for r in found.collect()}, notices


def test_horizon_view(spark):
    profiles = [("e1", DAY, "H12", 0.9, "red", None, 1), ("e1", DAY, "H12", 0.2, "low", None, 2), ("e1", DAY, "H12", 0.5, "yellow", None, None), ("e2", DAY, "H12", None, None, "twelve", 1), ("e2", DAY, "H3", 0.3, "low", "three", 1), ("e1", DAY, "H3", 0.3, "low", "three", 1)]
    far, notices = view(spark, "H12", profiles)
    # The latest profile goes first, what it leaves out stays the entity's own, and e3 has none.
    assert not notices and sorted(far) == ["e1", "e2"]
    assert (far["e1"]["profile_risk_probability"], far["e1"]["risk_level"], far["e1"]["involved_amount_source"], far["e1"]["selected_horizon"]) == (0.2, "low", "source", "H12")
    assert (far["e2"]["profile_risk_probability"], far["e2"]["risk_level"], far["e2"]["involved_amount_source"]) == (None, "own", "twelve")
    near, _ = view(spark, "H3", profiles)
    assert sorted(near) == ["e2"] and near["e2"]["involved_amount_source"] == "three"
    own, notices = view(spark, "H6", profiles)
    assert sorted(own) == ["e1"] and own["e1"]["risk_level"] == "own" and notices == ["HORIZON_PROFILE_NOT_AVAILABLE"]
    with pytest.raises(ValueError, match="H9"):
        view(spark, "H9", profiles)


def test_distributions(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", 2)], "x string, y int")
    got = {(r["field"], r["value"]): (r["row_count"], r["share"]) for r in SV.distributions(df, ["x", "y"]).collect()}
    assert got == {("x", "a"): (2, 0.5), ("x", "b"): (1, 0.25), ("x", "__MISSING__"): (1, 0.25), ("y", "1"): (2, 0.5), ("y", "2"): (1, 0.25), ("y", "__MISSING__"): (1, 0.25)}
    assert SV.distributions(df.limit(0), ["x"]).count() == 0


def test_display_overlap(spark):
    later = dt.date(2020, 7, 31)
    frame = lambda rows: spark.createDataFrame(rows, "entity_id string, cutoff_month date")
    recurring = frame([("a", DAY), ("a", DAY), ("a", later), ("b", DAY), ("d", DAY)])
    found = K.display_overlap(recurring, frame([("a", DAY), ("b", DAY), ("c", DAY), ("e", DAY)]), frame([("b", later), ("c", later), ("f", DAY)])).collect()
    first, second, third = K.DISPLAY_POOLS
    assert {(r["entity_id"], r["cutoff_month"]): (r["recommended_display_bucket"], r["suppressed_display_sources"]) for r in found} == {
        ("a", DAY): (first, second), ("a", later): (first, ""), ("b", DAY): (first, f"{second};{third}"), ("c", DAY): (second, third), ("d", DAY): (first, ""), ("e", DAY): (second, "")}
    assert len(found) == 6
