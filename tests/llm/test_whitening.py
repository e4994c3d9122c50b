"""Whitening against a dense eigensolver."""

import math

import numpy as np

from orderpulse.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def dense(x):
    """Exact centre, eigenvalues and eigenvectors of the different rows of x, by a dense solver."""
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    c = (n * once - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1], vectors[:, ::-1], np.trace(c.T @ c / n)


def compare(spark, vectors, components, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.whiten(frame, components).collect()
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums, values, turn, trace = dense(x)
    expected = (n * x - sums) / n @ turn[:, :components] / np.sqrt(values[:components])
    own = {(r["vec_id"], r["component"]): r for r in got}
    assert len(own) == len(got) == len(x) * components
    signs = np.sign([sum(own[i, k + 1]["whitened"] * expected[i, k] for i in range(len(x))) for k in range(components)])
    for i in range(len(x)):
        deviation = sum(int(d) * int(d) for d in n * x[i] - sums)
        for k in range(components):
            r = own[i, k + 1]
            assert r["n"] == n and r["deviation"] == deviation
            assert abs(r["whitened"] * signs[k] - expected[i, k]) < 1e-8
            assert abs(r["explained"] - values[k] / trace) < 1e-10
            assert r["identity_error"] < 1e-9 and r["residual"] <= whitening.TOLERANCE
    return got


def test_against_dense_solver(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 48)) * np.linspace(2, 0.2, 48)
    vectors = np.concatenate([base, base[:30], np.repeat(base[:1], 200, axis=0)])
    rows = [(i, [float(c) for c in v], 1, "clash") for i, v in enumerate(vectors)]
    odd = [(9001, None, 1, None), (9002, [1.0, None] + [0.0] * 46, 1, None), (9003, [math.nan] * 48, 1, None), (9004, [-math.inf] + [0.0] * 47, None, None), (9005, [1.0, 2.0], 1, None), (9006, [], 1, None)]
    compare(spark, vectors, 16, rows + odd)


def test_block_of_all_dimensions_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 7))
    rows = [(i, [float(c) for c in v], 1, None) for i, v in enumerate(vectors)]
    got = compare(spark, vectors, 7, rows)
    again = whitening.whiten(spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1], 1, None)], SCHEMA)).collect()
    assert len(again) == len(got) + 6 * 7 and {r["n"] for r in again} == {60}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 1, "")], [(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 2, "")], [(1, [], 1, "")]):
        made = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert made.columns[:2] == ["vec_id", "component"] and made.collect() == []


def test_rank_bounds_components(spark):
    rows = [(i, [float(i % 5), 2.0, float(i % 5) * 2], 1, "") for i in range(20)]
    made = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(made) == 20 and {r["component"] for r in made} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in made)


def test_filter_damps_the_unwanted_spectrum():
    values = np.array([10.0, 6.0, 1.0, 0.5, 0.1])
    made = whitening.filtered(lambda q: values[:, None] * q, np.ones((5, 1)), 0.0, 1.0, 10.0, 8)[:, 0]
    assert made[0] > 0.99 and abs(made[1]) > 1e4 * np.abs(made[2:]).max() * 0.01 and np.abs(made[2:]).max() < 1e-4
