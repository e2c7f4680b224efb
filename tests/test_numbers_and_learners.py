"""Quantiles, weights and linear learners against exact or brute-force values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halfseen.functions import hashing, quantiles, scalar
from halfseen.operators import evaluation, gamma, learners, ranking


def test_t_quantile_beyond_the_table(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 201, 202, 1_000_001, 10**12)], "n long")
    got = [r[0] for r in df.orderBy("n").select(evaluation.t_quantile(F.col("n"))).collect()]
    assert got[0] is None and got[1] == pytest.approx(12.706204736, abs=1e-6)
    assert got[3] == pytest.approx(quantiles.t_ppf(0.975, 201), abs=1e-10)
    assert got[4] == pytest.approx(1.9599664, abs=1e-6) and got[5] == pytest.approx(1.959963984540, abs=1e-9)


def test_incomplete_beta_of_large_counts():
    for a, b, x in ((3e5, 7e5, 0.3005), (2e6, 1e4, 0.99503), (5e5, 5e5, 0.5)):
        assert quantiles._betainc_large(a, b, x) == pytest.approx(quantiles._betainc(a, b, x), abs=1e-6)
    assert quantiles.binomial_tail(10**12, 0.5, 5 * 10**11) == pytest.approx(0.5, abs=1e-6)


def test_poisson_draws(spark):
    rng = np.random.default_rng(1)
    for mean in (0.7, 30.0, 5000.0):
        seeds = pd.Series(rng.integers(0, 2**32, 20_000))
        got = hashing.poisson_draw.func(pd.Series([mean] * 20_000), seeds)
        assert got.mean() == pytest.approx(mean, rel=0.05) and got.var() == pytest.approx(mean, rel=0.05)
        assert (got >= 0).all() and (got == got.round()).all()
    ones = spark.range(20_000).select(hashing.poisson1("id", "s").alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert ones[0] == pytest.approx(1, abs=0.03) and ones[1] == pytest.approx(1, abs=0.06)


def test_inputs_outside_their_domain_fail(spark):
    df = spark.createDataFrame([(0.5, 0.5, 2.0)], "p1 double, e double, g double")
    lo, hi = scalar.box("p1", "e", F.col("g"))
    assert df.select(lo, hi).first()[0] < 0.5
    for bad in ((1.5, 0.5, 2.0), (0.5, -0.1, 2.0), (0.5, 0.5, 0.5)):
        with pytest.raises(Exception, match="must"):
            spark.createDataFrame([bad], df.schema).select(*scalar.box("p1", "e", F.col("g"))).collect()
    with pytest.raises(ValueError):
        scalar.gamma_from_lambda(0.5)
    assert scalar.lambda_from_gamma(4.0) == 2.0
    q = gamma.realised_gamma(spark.createDataFrame([(0.5, 0.5), (0.8, 0.5)], "p0 double, p1 double")).first()[0]
    assert q == pytest.approx(4.0)


@pytest.fixture(scope="module")
def boxes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 2))
    mid = 1 / (1 + np.exp(-(x @ [1.0, -0.5])))
    lo, hi = np.maximum(mid - 0.1, 0.01), np.minimum(mid + 0.15, 0.99)
    w = rng.integers(1, 9, 80).astype(float)
    return pd.DataFrame({"id": range(80), "a": x[:, 0], "b": x[:, 1], "lo": lo, "hi": hi, "w": w})


def risk(frame, beta, l2):
    z = beta[0] + frame[["a", "b"]].to_numpy() @ beta[1:]
    one, zero = np.logaddexp(0, -z), np.logaddexp(0, z)
    worst = np.maximum(frame.lo * one + (1 - frame.lo) * zero, frame.hi * one + (1 - frame.hi) * zero)
    return float((frame.w * worst).sum() / frame.w.sum() + l2 * beta @ beta)


def test_worst_case_linear_is_optimal(spark, boxes):
    beta, value, _ = learners.worst_case_linear(spark.createDataFrame(boxes), ["a", "b"], weight="w", l2=1e-2)
    assert value == pytest.approx(risk(boxes, beta, 1e-2), abs=1e-10)
    rng = np.random.default_rng(0)
    for scale in (1.0, 0.1, 0.01):
        assert min(risk(boxes, beta + scale * rng.normal(size=3), 1e-2) for _ in range(500)) >= value - 1e-6


def test_worst_case_ranker_weights(spark, boxes):
    packed = spark.createDataFrame(boxes)
    spread = packed.withColumn("id", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).withColumn("id", F.monotonically_increasing_id())
    _, weighted = learners.worst_case_ranker(packed, ["a", "b"], ident="id", weight="w", rounds=2, pairs=200)
    _, repeated = learners.worst_case_ranker(spread, ["a", "b"], ident="id", rounds=0)
    assert weighted[0] == pytest.approx(repeated[0], abs=1e-9) and len(weighted) == 3
    best, history = learners.worst_case_ranker(packed, ["a", "b"], ident="id", weight="w", rounds=2, pairs=200)
    lower = ranking.sharp_interval(packed.withColumn("s", learners.linear([0.0, *best], ["a", "b"])), "s", weight="w").first()["lower"]
    assert lower == pytest.approx(max(history), abs=1e-12) and max(history) >= history[0]


def test_midpoint_scorer_and_residual(spark, boxes):
    beta = learners.midpoint_scorer(spark.createDataFrame(boxes), ["a", "b"], weight="w")
    x, mid, w = boxes[["a", "b"]].to_numpy(), ((boxes.lo + boxes.hi) / 2).to_numpy(), boxes.w.to_numpy()
    want = np.linalg.solve((x.T * w) @ x + 1e-3 * np.eye(2), (x.T * w) @ (mid - (w @ mid) / w.sum()))
    assert beta == pytest.approx(want / np.linalg.norm(want), abs=1e-9)
    r = learners.residualise(spark.createDataFrame(boxes), ["a"], "hi").agg(F.avg("s_res"), F.stddev_pop("s_res"), F.corr("s_res", "a")).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(1, abs=1e-9) and abs(r[2]) < 1e-4


def test_learners_learn(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 2))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y, t = (rng.random(1500) < p).astype(float), (rng.random(1500) < 0.3 + 0.4 * (x[:, 1] > 0)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": range(1500), "a": x[:, 0], "b": x[:, 1], "t": t, "y": y, "y_obs": np.where(t == 1, y, 0.0), "p": p}))
    for model, rounds in (("logistic", None), ("gbm", 20), ("mlp", 100)):
        out = learners.probability(learners.base_learner(model, ["a", "b"], "y", rounds=rounds).fit(df), df, "q")
        assert out.agg(F.corr("q", "p")).first()[0] > 0.85
    fitted = learners.CrossFit(["a", "b"], ident="id", model="logistic", folds=3).fit_predict(df)
    row = fitted.agg(F.count(F.lit(1)), F.corr("p1", "p"), F.min("e"), F.max("e"), F.avg("e")).first()
    assert row[0] == 1500 and row[1] > 0.9 and 0 < row[2] < row[3] < 1 and row[4] == pytest.approx(t.mean(), abs=0.03)
    nuis = df.withColumns({"e": F.when(F.col("b") > 0, 0.7).otherwise(0.3), "p1": F.col("p")})
    for learn in (learners.erm, learners.ipw, learners.oracle):
        assert learn(nuis, ["a", "b"])(nuis, "s").agg(F.corr("s", "a")).first()[0] > 0.9
    for learn in (learners.aipw, learners.imputation):
        assert learn(nuis, ["a", "b"], rounds=10)(nuis, "s").agg(F.corr("s", "p")).first()[0] > 0.8
    members = learners.bagged_ensemble(df, ["a", "b"], ident="id", members=3).select(F.size("member_p"), F.element_at("member_p", 1)).first()
    assert members[0] == 3 and 0 < members[1] < 1
