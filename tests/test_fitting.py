"""Grouped fits against numpy, and what an evaluation must not let through."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderpulse.operators import fitting, rolling

SCHEMA = "g string, h int, a double, b double, y int"


def dense_logistic(x, y, ridge=1.0):
    mean = np.array([np.nanmean(c) if np.isfinite(c).any() else 0.0 for c in x.T])
    dev = np.array([np.nanstd(c) if np.isfinite(c).any() else 0.0 for c in x.T])
    dev[dev == 0] = 1
    z = np.column_stack([np.ones(len(x)), np.nan_to_num((x - mean) / dev)])
    beta, pen = np.zeros(z.shape[1]), np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += 0.5 * np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (y - p) - pen @ beta)
    return beta


def sample(rng, n, slope):
    a, b = rng.normal(3, 2, n), rng.exponential(1, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(slope * (a - 3) + 0.3 * b)))).astype(int)
    return a, b, y


def test_grouped_logistic_is_the_optimum_of_every_group(spark):
    rng = np.random.default_rng(0)
    rows, data = [], {}
    for g, slope in (("x", 0.7), ("y", -1.5), (None, 0.0)):
        for h in (3, 6):
            a, b, y = sample(rng, 400, slope)
            a[::17] = np.nan
            data[g, h] = (np.column_stack([a, b]), y)
            rows += [(g, h, None if np.isnan(u) else float(u), float(v), int(w)) for u, v, w in zip(a, b, y)]
    rows += [("one", 3, 1.0, 1.0, 1)] * 5 + [("flat", 3, 2.0, None, i % 2) for i in range(10)] + [("x", 3, 9.0, 9.0, None)] * 3
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    model = fitting.grouped_logistic(frame, ["g", "h"], ["a", "b"])
    found = {(r["g"], r["h"]): r for r in model.collect()}
    assert len(found) == 8
    for key, (x, y) in data.items():
        assert found[key]["converged"] and np.allclose(found[key]["beta"], dense_logistic(x, y), atol=1e-7)
        assert found[key]["train_rows"] == len(y) and found[key]["train_positives"] == y.sum()
    assert found["one", 3]["single_class"] and np.allclose(found["one", 3]["beta"], [np.log(11), 0, 0])
    assert np.allclose(found["flat", 3]["beta"], 0, atol=1e-9)
    scored = fitting.grouped_scores(frame.where("g = 'y' and h = 6"), model, ["g", "h"], ["a", "b"]).collect()
    assert len(scored) == 400 and all(0 < r["score"] < 1 for r in scored)
    assert fitting.grouped_logistic(frame.limit(0), ["g"], ["a"]).collect() == []


def test_separable_group_stays_finite(spark):
    rows = [("s", 1, float(i), 0.0, int(i >= 50)) for i in range(100)]
    r = fitting.grouped_logistic(spark.createDataFrame(rows, SCHEMA), ["g"], ["a", "b"]).first()
    assert r["converged"] and np.allclose(r["beta"], dense_logistic(np.array([[x[2], x[3]] for x in rows]), np.array([x[4] for x in rows])), atol=1e-6)


def slow_isotonic(x, y):
    points = np.unique(x)
    s, n = np.array([y[x == p].sum() for p in points], float), np.array([(x == p).sum() for p in points], float)
    mean = lambda a, b: s[a:b + 1].sum() / n[a:b + 1].sum()
    k = len(points)
    return points, np.array([max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)])


def test_isotonic_blocks_and_scores(spark):
    rng = np.random.default_rng(1)
    rows, fits = [], {}
    for g, k in (("x", 40), ("y", 25), ("z", 1)):
        x = rng.integers(0, k, 300) / k
        y = (rng.random(300) < 0.2 + 0.6 * x).astype(int)
        fits[g] = slow_isotonic(x, y)
        rows += [(g, 0, float(u), None, int(v)) for u, v in zip(x, y)]
    frame = spark.createDataFrame([*rows, ("x", 0, None, None, 1), ("x", 0, 0.5, None, None)], SCHEMA).repartition(6)
    blocks = fitting.isotonic(frame, ["g"], "a")
    asked = spark.createDataFrame([(g, 0, float(u), None, 0) for g in (*fits, "none") for u in np.linspace(-0.1, 1.1, 37)], SCHEMA)
    for r in fitting.isotonic_scores(asked, blocks, ["g"], "a").collect():
        if r["g"] == "none":
            assert r["isotonic"] is None
        else:
            assert abs(r["isotonic"] - np.interp(r["a"], *fits[r["g"]])) < 1e-12
    assert {r["g"]: r["n"] for r in blocks.groupBy("g").agg(F.sum("n").alias("n")).collect()} == {g: 300 for g in fits}


FOLDS = [{"fold": "f", "train_end": "2000-02-29", "valid_start": "2000-03-31", "valid_end": "2000-03-31", "test_start": "2000-04-30", "test_end": "2000-05-31"}]


def folded(spark, spoiled=False):
    rng = np.random.default_rng(2)
    rows = []
    for month in ("2000-01-31", "2000-02-29", "2000-03-31", "2000-04-30", "2000-05-31", "2000-06-30"):
        a, b, y = sample(rng, 120, 1.0)
        if spoiled and month > "2000-03-31":
            a, b, y = a * 50, b - 1000, 1 - y
        rows += [(month, f"e{i}", "m" + str(i % 3), float(u), float(v), int(w)) for i, (u, v, w) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "month string, entity_id string, maker string, a double, b double, y int").withColumn("cutoff_month", F.to_date("month"))


def test_test_window_leaves_the_fit_unchanged(spark):
    betas = []
    for spoiled in (False, True):
        dealt = rolling.with_folds(folded(spark, spoiled), FOLDS)
        model = fitting.grouped_logistic(dealt.where("split = 'train'"), ["fold"], ["a", "b"])
        scored = rolling.trained_scores(dealt, ["fold"], ["a", "b"])
        platt = fitting.grouped_logistic(scored.where("split = 'valid'"), ["fold"], ["raw"])
        betas.append((model.first()["beta"], platt.first()["beta"]))
        assert rolling.calibrated(scored, ["fold"]).where("platt is null or isotonic is null").isEmpty()
    assert np.allclose(betas[0][0], betas[1][0], atol=1e-12) and np.allclose(betas[0][1], betas[1][1], atol=1e-12)
    with pytest.raises(ValueError):
        rolling.with_folds(folded(spark), [{**FOLDS[0], "test_start": "2000-03-31"}])


def test_samples_are_nested_and_held_out_groups_disjoint(spark):
    rows = folded(spark).withColumn("split", F.expr("if(cutoff_month <= date'2000-03-31', 'train', 'test')"))
    drawn = rolling.nested_samples(rows, "entity_id", [5, 25, 100]).select("sample_percent", "split", "entity_id").distinct().collect()
    ids = lambda p, s: {r["entity_id"] for r in drawn if r["sample_percent"] == p and r["split"] == s}
    assert ids(5, "train") < ids(25, "train") < ids(100, "train") and len(ids(100, "train")) == 120 and 10 < len(ids(25, "train")) < 50
    assert ids(5, "test") == ids(100, "test") and len(ids(5, "test")) == 120
    held = rolling.held_out_groups(rows, "maker", 2, "split = 'train'", "split = 'test'").select("held_out", "split", "maker").distinct().collect()
    assert {(r["held_out"], r["maker"]) for r in held if r["split"] == "test"} == {("m0", "m0"), ("m1", "m1")}
    assert {(r["held_out"], r["maker"]) for r in held if r["split"] == "train"} == {(a, b) for a in ("m0", "m1") for b in ("m0", "m1", "m2") if a != b}


def test_left_out_features_get_no_weight(spark):
    rows = rolling.feature_sets(folded(spark), ["a", "b"], {"both": ["a", "b"], "b": ["b"]})
    model = {r["feature_set"]: r["beta"] for r in fitting.grouped_logistic(rows, ["feature_set"], ["a", "b"]).collect()}
    assert abs(model["both"][1]) > 0.5 and model["b"][1] == 0
