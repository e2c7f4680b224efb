"""Keyed logistic models against plain Newton steps, and gamma_min from leniency with centres that fail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halfseen.operators import gamma
from halfseen.operators.keyed_logistic import fit_keyed, scores


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-10 * np.eye(len(b)), x.T @ (y - p))
    return b


def test_keyed_models(spark):
    rng = np.random.default_rng(2)
    frames, want = [], {}
    for k, n in ((0, 300), (2, 80), (3, 1000)):
        x = rng.normal(size=(n, 2)).round(1)
        y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -k / 2] + 0.3)))).astype(float)
        want[k] = newton(x, y)
        frames.append(pd.DataFrame({"k": k, "a": x[:, 0], "b": x[:, 1], "y": y, "w": 1.0}))
    frames.append(pd.DataFrame({"k": 1, "a": [1.0, 2.0], "b": 0.0, "y": 1.0, "w": 1.0}))
    frames.append(pd.DataFrame({"k": 4, "a": [-2.0, -1.0, 1.0, 2.0], "b": [1.0, -1.0, 1.0, -1.0], "y": [0.0, 0.0, 1.0, 1.0], "w": 1.0}))
    df = spark.createDataFrame(pd.concat(frames)).repartition(5)
    beta, problem = fit_keyed(df, ["a", "b"], 6)
    assert [problem[k] for k in (0, 1, 2, 3, 4, 5)] == [None, "one class", None, None, None, "no rows"]
    for k, b in want.items():
        assert beta[k] == pytest.approx(b, abs=1e-6)
    assert beta[4][1] > 10 and np.abs(beta).max() <= 40                      # separable: as good as certain, and it ends
    twice, _ = fit_keyed(df.union(df).withColumn("w", F.lit(0.5)), ["a", "b"], 6)
    assert twice == pytest.approx(beta, abs=1e-6)
    got = np.array([r[0] for r in df.where("k = 0").orderBy("a", "b", "y").select(scores(beta, ["a", "b"])).collect()])
    assert got.shape == (300, 6) and (got > 0).all() and (got < 1).all()


def test_leniency_of_one_and_no_centre(spark):
    rows = [(k, "a" if k < 60 else "b", k % 2, float(k % 3 == 0) if k % 2 else None, float(k % 5)) for k in range(64)]
    df = spark.createDataFrame(rows, "id long, z string, t int, y double, x double")
    table, failures = gamma.leniency(df, ["x"], z="z", t="t", y="y", ident="id", seeds=2)
    assert table.count() == 0 and {r["error"] for r in failures.collect()} == {"fewer than two centres fitted"}
    table, failures = gamma.leniency(df.limit(0), ["x"], z="z", t="t", y="y", ident="id", seeds=2)
    assert table.count() == 0 and failures.count() == 2


def test_leniency_finds_centres_that_disagree(spark):
    """Two centres alike in who they see; one selects nearly all, the other those with the outcome: only a large gamma reconciles them."""
    rng = np.random.default_rng(1)
    n = 2000
    y = (rng.random(n) < 0.3).astype(float)
    z = np.where(rng.random(n) < 0.5, "all", "picky")
    t = np.where(z == "all", rng.random(n) < 0.97, rng.random(n) < np.where(y == 1, 0.9, 0.2)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "z": z, "t": t, "y": [v if s else None for v, s in zip(y, t)], "x": rng.integers(0, 2, n).astype(float)}))
    table, failures = gamma.leniency(df, ["x"], z="z", t="t", y="y", ident="id", seeds=2)
    assert failures.count() == 0
    for r in table.collect():
        assert r["n_units"] == n and r["n_groups"] == 2 and r["gamma_min"] > 3 and r["gamma_min_boot_lo"] <= r["gamma_min_q95"] <= r["gamma_min"]
