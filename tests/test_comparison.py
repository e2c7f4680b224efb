"""The method table against plain numpy, row by row."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halfseen.functions import scalar as s
from halfseen.operators import comparison as cm
from halfseen.operators import ranking as rk


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    if not len(a) or not len(b):
        return None
    return float(np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])))


@pytest.fixture(scope="module")
def orders():
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=(n, 2)).round(1)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    t = (rng.random(n) < 1 / (1 + np.exp(-x[:, 1]))).astype(int)
    y = (rng.random(n) < p).astype(float)
    return pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "t": t, "y": y, "y_obs": [v if k else None for v, k in zip(y, t)],
                         "e": np.clip(rng.random(n), 0.1, 0.9).round(1), "p1": np.clip(p, 0.05, 0.95).round(2)})


def frame(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, a double, b double, t int, y double, y_obs double, e double, p1 double")


def test_table_equals_plain_metrics(spark, orders):
    methods = [cm.Method("line", F.col("a") - F.col("b")), *cm.plug_in_methods([1.0, 2.0])]
    df = frame(spark, orders)
    got = {(r["method"], r["gamma"], r["criterion"]): r for r in cm.method_table(df, methods, y="y").collect()}
    assert len(got) == len(methods) == 6
    lo, hi = s.box("p1", "e", 2.0)
    plain = df.withColumns({f"m{i}": F.round(m.score, 12) for i, m in enumerate(methods)} | {"lo": lo, "hi": hi}).toPandas()
    for i, m in enumerate(methods):
        r, z, y = got[(m.name, m.gamma, m.criterion)], plain[f"m{i}"].to_numpy(), plain["y"].to_numpy()
        sel = plain["t"].to_numpy() == 1
        for prefix, zz, yy in (("", z, y), ("obs_", z[sel], y[sel])):
            want = {"risk": np.mean(np.logaddexp(0, zz) - yy * zz), "auroc": auc(zz, yy), "accuracy": np.mean((zz > 0) == (yy == 1)),
                    "balanced_accuracy": 0.5 * (np.mean(zz[yy == 1] > 0) + np.mean(zz[yy == 0] <= 0)),
                    "brier": np.mean((1 / (1 + np.exp(-zz)) - yy) ** 2)}
            for k, v in want.items():
                assert r[prefix + k] == pytest.approx(v, abs=1e-9), (m, prefix + k)
        sides = np.stack([np.logaddexp(0, z) - plain[c].to_numpy() * z for c in ("lo", "hi")])
        assert r["worstcase_risk"] == pytest.approx(sides.max(axis=0).mean(), abs=1e-9)
        sharp = rk.sharp_interval(df.withColumns({"lo": lo, "hi": hi, "s": F.round(m.score, 12)}), "s").collect()[0]
        assert (r["auroc_lo"], r["auroc_hi"]) == pytest.approx((sharp["lower"], sharp["upper"]), abs=1e-9)
        assert r["abstention_rate"] == (None if m.criterion is None else pytest.approx(np.mean(z == 0), abs=1e-12))


def test_missing_labels_and_one_class(spark, orders):
    pdf = orders.head(60).copy()
    pdf.loc[pdf.index[:10], "y"] = None
    df = frame(spark, pdf)
    method = [cm.Method("line", F.col("a"))]
    with_y = cm.method_table(df, method, y="y").collect()[0]
    z, y = pdf["a"].to_numpy()[10:], pdf["y"].to_numpy()[10:]
    assert with_y["auroc"] == pytest.approx(auc(z, y), abs=1e-12)
    without = cm.method_table(df, method).collect()[0]
    assert without["risk"] is None and without["obs_risk"] == pytest.approx(with_y["obs_risk"])
    one = cm.method_table(df.filter("t = 0 OR y_obs = 1"), method).collect()[0]
    assert one["obs_auroc"] is None and one["obs_risk"] is not None
    assert cm.method_table(df.limit(0), method).collect() == []
    with pytest.raises(ValueError):
        cm.method_table(df, [])


def test_whole_comparison(spark, orders):
    df = frame(spark, orders).drop("e", "p1").withColumn("side", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    got = cm.compare(df, ["a", "b"], ident="id", side="side", y="y", gammas=(1.0, 2.0), rounds=8, folds=2).collect()
    names = [r["method"] for r in got]
    assert sorted(names) == sorted(["erm", "ipw", "oracle", "aipw", "imputation", "midpoint_linear", "worst_case_linear", "no_assumption"] + ["plug_in"] * 4)
    assert all(r["auroc"] > 0.6 for r in got if r["method"] not in ("no_assumption", "plug_in"))
    assert all(r["auroc_lo"] <= r["auroc_hi"] for r in got)


def test_boosted_together_equal_boosted_alone(spark, orders):
    from halfseen.operators import learners as ln
    df = frame(spark, orders)
    score = {m.name: m.score for m in cm.learned_methods(df, ["a", "b"], y="y", rounds=5)}
    alone = {"erm": ln.erm(df, ["a", "b"], model="gbm", rounds=5), "ipw": ln.ipw(df, ["a", "b"], model="gbm", rounds=5),
             "oracle": ln.oracle(df, ["a", "b"], model="gbm", rounds=5), "aipw": ln.aipw(df, ["a", "b"], rounds=5),
             "imputation": ln.imputation(df, ["a", "b"], rounds=5)}
    both = df.withColumns({f"t_{n}": c for n, c in score.items()})
    for n, predict in alone.items():
        both = predict(both, f"o_{n}")
    pdf = both.toPandas()
    for n in alone:
        assert np.allclose(pdf[f"t_{n}"], pdf[f"o_{n}"], atol=0.02), n
