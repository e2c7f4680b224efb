"""The learners in full: boosting with its defaults, cross-fitting out of fold, calibration, both ways of growing trees."""

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halfseen.operators import boosting as bo
from halfseen.operators import learners


def plain_boost(bins, y, w, s):
    """The same boosting written out, one row and one split at a time."""
    margin, out = np.full(len(y), bo.start(s.loss, (w * y).sum(), w.sum())), []
    for _ in range(s.rounds):
        g, h = bo.slopes(s.loss, margin, y, w)
        groups = [np.arange(len(y))]

        def best(rows):
            top = (1e-9, None, None)
            for f in range(bins.shape[1]):
                for b in np.unique(bins[rows, f])[:-1]:
                    left = bins[rows, f] <= b
                    a, c = rows[left], rows[~left]
                    if w[a].sum() < s.least or w[c].sum() < s.least or h[a].sum() < 1e-3 or h[c].sum() < 1e-3:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + s.l2) + g[c].sum() ** 2 / (h[c].sum() + s.l2) - g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
                    if gain > top[0] + 1e-12:
                        top = (gain, a, c)
            return top
        found = [best(groups[0])]
        while len(groups) < s.leaves and max(t[0] for t in found) > 1e-9 and any(t[1] is not None for t in found):
            k = int(np.argmax([t[0] if t[1] is not None else -1 for t in found]))
            _, a, c = found.pop(k)
            groups.pop(k)
            groups += [a, c]
            found += [best(a), best(c)]
        for rows in groups:
            margin[rows] -= s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
        out.append(margin.copy())
    return out


def sample(n, d=3, levels=9, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, d)).astype(float)
    p = 1 / (1 + np.exp(-(x[:, 0] - levels / 2) + (x[:, 1] > 4) * 2.0))
    return x, (rng.random(n) < p).astype(float), p, rng


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_boosting_brute(loss):
    x, y, _, rng = sample(400)
    w = rng.integers(1, 4, 400).astype(float)
    s = bo.Settings(loss=loss, rounds=6, leaves=7, least=10)
    bins = bo.binned(list(x.T), [np.arange(9.0)] * 3)
    base, trees = bo.fit_one(bins, y, w, s)
    margin = np.full(len(y), base)
    for tree, want in zip(trees, plain_boost(bins, y, w, s)):
        margin += s.rate * tree[3][bo.leaves(tree, bins)]
        assert margin == pytest.approx(want, abs=1e-9)
    assert len(trees) == 6


def keyed(spark, x, y, fold, inner):
    frame = pd.DataFrame({**{f"f{i}": c for i, c in enumerate(x.T)}, "target": 0, "fold": fold, "inner": inner, "y": y, "w": 1.0})
    return spark.createDataFrame(frame)


def test_levels_and_tasks_grow_the_same_trees(spark, monkeypatch):
    """Aggregates per level, with little room for sums and frequent hand-over of margins, against one task per model."""
    monkeypatch.setattr(bo, "HELD", 3 * 3 * bo.WIDTH)
    monkeypatch.setattr(bo, "PENDING", 2)
    x, y, _, rng = sample(600, seed=2)
    x[::17, 2] = np.nan
    rows = keyed(spark, x, y, rng.integers(0, 2, 600), rng.integers(0, 3, 600))
    models = [(0, 0, -1), (0, 1, 2), (0, -1, -1), (1, -1, -1)]
    s = bo.Settings(rounds=3, leaves=6, least=20)
    one, _ = bo.boost(rows, ["f0", "f1", "f2"], models, settings=s)
    two, _ = bo.boost(rows, ["f0", "f1", "f2"], models, settings=s, packed_limit=0)
    bins = one.binned(list(x.T))
    assert one.scores(bins)[:, :3] == pytest.approx(two.scores(bins)[:, :3], abs=1e-9)
    assert len(set(np.round(one.scores(bins)[:, 2], 9))) >= 6


def test_packing_is_exact(spark):
    x, y, _, rng = sample(300)
    rows = keyed(spark, x, y, 0, 0)
    fitted, packed = bo.boost(rows, ["f0", "f1", "f2"], [(0, -1, -1)], settings=bo.Settings(rounds=2))
    assert packed.agg(F.sum("w")).first()[0] == 300 and packed.count() < 300
    assert fitted.edges[0].tolist() == list(range(9))
    twice, _ = bo.boost(rows.union(rows).withColumn("w", F.lit(0.5)), ["f0", "f1", "f2"], [(0, -1, -1)], settings=bo.Settings(rounds=2))
    bins = fitted.binned(list(x.T))
    assert fitted.scores(bins) == pytest.approx(twice.scores(bins), abs=1e-12)


def test_isotonic():
    x, y = bo.isotonic(np.arange(6.0), np.array([0.1, 0.4, 0.2, 0.3, 0.9, 0.8]), np.array([1.0, 1, 1, 2, 1, 3]))
    fit = np.interp(np.arange(6.0), x, y)
    assert fit == pytest.approx([0.1, 0.3, 0.3, 0.3, 0.825, 0.825])


def test_cross_fit_with_its_defaults(spark):
    """Five folds of calibrated boosting: honest out-of-fold scores, near the truth, and means of all models on new rows."""
    x, y, p, rng = sample(3000, seed=5)
    t = (rng.random(3000) < np.where(x[:, 1] > 4, 0.7, 0.4)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": range(3000), "a": x[:, 0], "b": x[:, 1], "c": rng.random(3000), "t": t,
                                             "y_obs": [float(v) if s else None for v, s in zip(y, t)], "p": p, "q": np.where(x[:, 1] > 4, 0.7, 0.4)}))
    cf = learners.CrossFit(["a", "b"], ident="id")
    assert (cf.model, cf.k, cf.calibrate, cf.rounds, learners.ROUNDS["gbm"]) == ("gbm", 5, True, None, 200)
    fitted = cf.fit_predict(df)
    row = fitted.agg(F.count(F.lit(1)), F.corr("p1", "p"), F.corr("e", "q"), F.avg("e"), F.min("p1"), F.max("p1")).first()
    assert row[0] == 3000 and row[1] > 0.95 and row[2] > 0.8 and row[3] == pytest.approx(t.mean(), abs=0.02) and 0 < row[4] < row[5] < 1
    noise = df.withColumn("y_obs", F.when(F.col("t") == 1, (F.hash("id") % 2 == 0).cast("double")))
    out = learners.CrossFit(["a", "b", "c"], ident="id", rounds=60).fit_predict(noise)
    assert abs(out.where("t = 1").agg(F.corr("p1", "y_obs")).first()[0]) < 0.08          # a model that saw the row would follow it
    new = cf.predict(df.drop("y_obs", "t")).agg(F.corr("p1", "p"), F.count(F.lit(1))).first()
    assert new[0] > 0.95 and new[1] == 3000


def test_cross_fit_of_one_class_and_few_rows(spark):
    df = spark.createDataFrame([(k, float(k % 5), k % 2, 1.0 if k % 2 else None) for k in range(80)], "id long, a double, t int, y_obs double")
    out = learners.CrossFit(["a"], ident="id", rounds=3).fit_predict(df)
    assert out.count() == 80 and {r[0] for r in out.select("p1").distinct().collect()} == {0.999}


def test_worst_case_ranker_default_rounds():
    assert inspect.signature(learners.worst_case_ranker).parameters["rounds"].default == 40
