"""Stored score batches, policy overlap and choice pairs against plain Python."""

import datetime as dt

import pytest

from orderpulse.operators import audits, candidates, metrics
from orderpulse.sources import batch


def test_two_stored_batches(spark, tmp_path):
    schema = "id string, g string, score double"
    a = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.2), ("c", "y", None), ("d", "y", 0.1)], schema)
    b = spark.createDataFrame([("b", "x", 0.3), ("c", "y", None), ("d", "y", 0.1), ("e", "y", 0.9)], schema)
    path = str(tmp_path / "scores")
    metrics.publish_scores(a, path, "v1")
    metrics.publish_scores(b, path, "v2")
    with pytest.raises(Exception, match="(?i)exists"):
        metrics.publish_scores(b, path, "v1")
    found = {r["g"]: r for r in metrics.batch_parity(metrics.read_scores(spark, path, "v1"), metrics.read_scores(spark, path, "v2"), ["id", "g"], "score", ["g"]).collect()}
    x, y = found["x"], found["y"]
    assert (x["matched_rows"], x["runtime_only"], x["reference_only"], x["differing_rows"]) == (1, 1, 0, 1) and abs(x["max_abs_diff"] - 0.1) < 1e-12
    assert (y["matched_rows"], y["runtime_only"], y["reference_only"], y["differing_rows"], y["max_abs_diff"]) == (2, 0, 1, 0, 0.0)


def test_batches_whose_scores_are_all_equal_have_no_correlation(spark):
    schema = "id int, g string, score double"
    a = spark.createDataFrame([(i, g, {"flat": 0.4, "fall": 0.1 * i, "none": None}[g]) for g in ("flat", "fall", "none") for i in range(4)] + [(9, "flat", 0.9)], schema)
    b = spark.createDataFrame([(i, g, 0.5 - 0.1 * i) for g in ("flat", "fall", "none") for i in range(4)], schema)
    for one, other in ((a, b), (b, a)):
        found = {r["g"]: r["correlation"] for r in metrics.batch_parity(one, other, ["id", "g"], "score", ["g"]).collect()}
        assert found["flat"] is None and found["none"] is None and abs(found["fall"] + 1) < 1e-12


def test_policy_overlap(spark):
    rows = [("g", i % 2 == 0, i % 3 == 0, None if i % 5 else True) for i in range(60)]
    frame = spark.createDataFrame(rows, "grp string, a boolean, b boolean, c boolean")
    got = {(r["policy"], r["other_policy"]): r for r in candidates.policy_overlap(frame, ["a", "b", "c"], ["grp"]).collect()}
    sets = {n: {i for i, r in enumerate(rows) if r[k]} for k, n in ((1, "a"), (2, "b"), (3, "c"))}
    assert len(got) == 3
    for (p, q), r in got.items():
        assert r["overlap_count"] == len(sets[p] & sets[q]) and r["union_count"] == len(sets[p] | sets[q])
        assert r["jaccard"] == len(sets[p] & sets[q]) / len(sets[p] | sets[q]) and r["share_of_policy"] == len(sets[p] & sets[q]) / len(sets[p])


def test_choice_pairs_with_a_hot_hospital(spark):
    entities = [("m1", "hot", f"d{i:03d}", 5 + i % 7) for i in range(300)] + [("m2", "hot", f"d{i:03d}", 50) for i in range(0, 300, 2)] + [("m2", "h2", "d1", 9), ("m1", "h3", "d2", 900)]
    frame = spark.createDataFrame(entities, "manufacturer_code string, hospital_code string, drug_code string, order_count long")
    chosen = spark.createDataFrame([("m1",)], "manufacturer_code string")
    made = audits.select_choice_pairs(frame, chosen, 40).collect()
    with_sub = [r for r in made if r["has_manufacturer_substitution"]]
    assert len(made) == 40 and len(with_sub) == 30 and all(r["hospital_code"] != "h2" for r in made)
    ordered = sorted(((-(5 + i % 7), f"d{i:03d}") for i in range(0, 300, 2)))
    assert [r["drug_code"] for r in sorted(with_sub, key=lambda r: r["selection_rank"])] == [d for _, d in ordered[:30]]
    assert max(made, key=lambda r: r["selected_mfg_order_count"])["hospital_code"] == "h3"
    # Few pairs without substitution leave their room to the others.
    assert len(audits.select_choice_pairs(frame.where("hospital_code <> 'hot' or int(substring(drug_code, 2)) % 2 = 0"), chosen, 100).where("has_manufacturer_substitution").collect()) == 99


def test_views_keep_all_columns(spark):
    orders = spark.createDataFrame([("o1", "d", "h", dt.date(2020, 1, 5), 2.0, 10.0, 1.0, dt.date(2020, 1, 9), 1.0)], "order_id string, drug_code string, org_code string, order_date date, purchase_qty double, purchase_amount double, delivery_qty double, delivery_date date, receipt_qty double")
    mapping = spark.createDataFrame([("d", "p", "line")], "drug_code string, product_line_code string, product_line_name string")
    batch.create_views(orders, mapping)
    row = spark.table("v_canonical_orders").first()
    assert row["purchase_price"] == 5.0 and row["manufacturer"] is None and row["receipt_time"] is None and row["delivery_time"] == dt.date(2020, 1, 9)
    assert spark.table("v_unit_monthly_agg").first()["month_start"] == dt.date(2020, 1, 1) and spark.table("v_unit_baseline_snapshot").count() == 1


def test_split_conservation_sees_a_lost_and_a_doubled_row(spark):
    schema = "observation_date string, detector_id string, detector_clue_id string, detector_score double, display_rank int"
    rows = [("2020-01-01", f"d{i % 2}", f"c{i}", float(i), 0) for i in range(10)]
    source = spark.createDataFrame(rows, schema)
    parts = batch.split_components(source, "run").cache()
    state = lambda p: {r["detector_id"]: r["conserved"] for r in batch.split_conservation(source, p).collect()}
    assert state(parts) == {"d0": True, "d1": True}
    assert state(parts.where("detector_clue_id <> 'c3'")) == {"d0": True, "d1": False}
    assert state(parts.unionByName(parts.where("detector_clue_id = 'c2'"))) == {"d0": False, "d1": True}
    assert state(parts.where("detector_id = 'd0'")) == {"d0": True, "d1": False}
