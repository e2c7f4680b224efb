"""Rank identity, sharpness, attainment, nesting and the robust objectives."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from halfseen.functions import quantiles as qt
from halfseen.functions import scalar as s
from halfseen.operators import gamma as gm
from halfseen.operators import intervals as iv
from halfseen.operators import objectives as ob
from halfseen.operators import ranking as rk


def pair_auc(rows, p):
    num = sum(wi * wj * pi * (1 - pj) * (1.0 if a > b else 0.5 if a == b else 0.0)
              for (a, wi), pi in zip(rows, p) for (b, wj), pj in zip(rows, p))
    w = sum(x[1] for x in rows)
    pi = sum(x[1] * q for x, q in zip(rows, p)) / w
    return num / w ** 2 / (pi * (1 - pi))


@pytest.fixture(scope="module")
def units(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(24):
        lo = rnd.uniform(0.02, 0.6)
        rows.append((i, float(rnd.randrange(9)), lo, lo + rnd.uniform(0.0, 0.35), rnd.uniform(0.2, 2.0)))
    return rows, spark.createDataFrame(rows, "id int, s double, lo double, hi double, w double").cache()


@pytest.mark.parametrize("blocked", [False, True])
def test_rank_identity_against_pairs(spark, units, blocked):
    rows, df = units
    if blocked:
        spark.conf.set("spark.halfseen.blockRows", "3")
    try:
        got = rk.auc(df, "s", {"lo": "lo", "hi": "hi"}, weight="w").collect()[0]
    finally:
        spark.conf.unset("spark.halfseen.blockRows")
    for c, j in (("lo", 2), ("hi", 3)):
        assert got[c] == pytest.approx(pair_auc([(r[1], r[4]) for r in rows], [r[j] for r in rows]), abs=1e-12)


def test_sharp_interval_holds_members_and_is_attained(spark, units):
    rows, df = units
    b = rk.sharp_interval(df, "s", weight="w").collect()[0]
    rnd = random.Random(4)
    base = [(r[1], r[4]) for r in rows]
    for _ in range(200):
        p = [rnd.choice((r[2], r[3], rnd.uniform(r[2], r[3]))) for r in rows]
        assert b["lower"] - 1e-9 <= pair_auc(base, p) <= b["upper"] + 1e-9
    m = rk.least_favourable(df, "s", weight="w").orderBy("id").collect()
    for c, bound in (("p_lower", "lower"), ("p_upper", "upper")):
        assert all(r["lo"] - 1e-12 <= r[c] <= r["hi"] + 1e-12 for r in m)
        assert pair_auc(base, [r[c] for r in m]) == pytest.approx(b[bound], abs=1e-9)


def test_small_box_against_all_vertices(spark):
    rows = [(0.0, .59, .98), (1.0, .85, .98), (2.0, .48, .97)]
    df = spark.createDataFrame(rows, "s double, lo double, hi double")
    b = rk.sharp_interval(df, "s").collect()[0]
    assert (b["lower"], b["upper"]) == pytest.approx((0.1340749414519904, 0.8252310852447793), abs=1e-12)
    for v in itertools.product(*[(r[1], r[2]) for r in rows]):
        assert b["lower"] - 1e-12 <= pair_auc([(r[0], 1.0) for r in rows], v) <= b["upper"] + 1e-12
    c = rk.corner_interval(df, "s").collect()[0]
    assert (c["lower"], c["upper"]) == pytest.approx((0.4469521604938271, 0.45696996862393524), abs=1e-12)


@pytest.mark.parametrize("metric", [rk.tpr_at(4.0), rk.tnr_at(4.0), rk.ppv_at(4.0)], ids=lambda m: m.name)
def test_threshold_metrics_hold_members(spark, units, metric):
    rows, df = units
    b = rk.sharp_interval(df, "s", metric=metric).collect()[0]
    for p in ("lo", "hi"):
        assert b["lower"] - 1e-9 <= rk.metric_value(df, "s", p, metric=metric).collect()[0]["value"] <= b["upper"] + 1e-9


def test_boxes(spark):
    df = spark.createDataFrame([(0.3, 0.6), (0.001, 0.9), (0.9, 0.2)], "p1 double, e double")
    cols = {}
    for g in (1.0, 2.0, 4.0, float("inf")):
        lo, hi = s.box("p1", "e", g)
        cols |= {f"l{g}": lo, f"h{g}": hi}
    for r in df.withColumns(cols).collect():
        assert r["l1.0"] == pytest.approx(r["p1"]) and r["h1.0"] == pytest.approx(r["p1"])
        assert r["linf"] == pytest.approx(r["e"] * r["p1"]) and r["hinf"] == pytest.approx(r["e"] * r["p1"] + 1 - r["e"])
        assert r["linf"] <= r["l4.0"] <= r["l2.0"] <= r["l1.0"] <= r["h1.0"] <= r["h2.0"] <= r["h4.0"] <= r["hinf"]
    with pytest.raises(ValueError):
        s.box("p1", "e", 0.5)


def test_negative_weights_and_crossed_boxes_fail(spark):
    df = spark.createDataFrame([(0.0, .5, .4, -1.0)], "s double, lo double, hi double, w double")
    with pytest.raises(Exception, match="non-negative"):
        rk.sharp_interval(df, "s", "hi", "hi", weight="w").collect()
    with pytest.raises(Exception, match="lo must be"):
        rk.sharp_interval(df, "s").collect()


def test_risk_decomposition_equals_maximum(spark, units):
    _, df = units
    for loss in s.LOSSES:
        m, p = ob.risk_parts(loss=loss, weight="w")
        r = df.agg(ob.worst_case_risk(loss=loss, weight="w").alias("r"), m.alias("m"), p.alias("p")).collect()[0]
        assert r["r"] == pytest.approx(r["m"] + r["p"], rel=1e-12)


def test_budgeted_risk_is_monotone(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(rnd.uniform(-2, 2), rnd.uniform(.05, .9), rnd.uniform(.1, .9)) for _ in range(40)],
                               "s double, p1 double, e double")
    got = [ob.budgeted_risk(df, gamma=2.0, budget=b)[0] for b in (0.05, 0.4, math.log(2.0))]
    assert got[0] <= got[1] + 1e-9 <= got[2] + 2e-9


def test_gamma_min_recovers_opposed_tilts(spark):
    # two decision makers whose identified sets just touch at gamma0
    for g0 in (1.0, 2.0, 4.0):
        df = spark.createDataFrame([([(0.0, 0.5, 0.5)],)], "zs array<struct<z: double, e: double, p1: double>>")
        p = lambda q, g: g * q / (1 + (g - 1) * q)
        target = 0.4
        # solve for p1 such that the upper (lower) end at g0 equals the target
        def solve(g):
            lo, hi = 1e-6, 1 - 1e-6
            for _ in range(100):
                mid = (lo + hi) / 2
                if 0.5 * mid + 0.5 * p(mid, g) < target:
                    lo = mid
                else:
                    hi = mid
            return lo
        zs = [(0.0, 0.5, solve(g0)), (1.0, 0.5, solve(1 / g0))]
        df = spark.createDataFrame([(zs,)], "zs array<struct<z: double, e: double, p1: double>>")
        got = df.select(gm.gamma_min("zs").alias("g")).collect()[0]["g"]
        assert got == pytest.approx(g0, rel=0.01)


def test_exact_binomial_and_quantiles():
    lo, hi = qt.clopper_pearson(0, 20, 0.05)
    assert lo == 0.0 and 0.1 < hi < 0.2
    lo, hi = qt.clopper_pearson(20, 20, 0.05)
    assert hi == 1.0 and 0.8 < lo < 0.9
    lo, hi = qt.clopper_pearson(10, 20, 0.05)
    assert lo < 0.5 < hi
    assert qt.t_ppf(0.975, 4) == pytest.approx(2.7764451052, abs=1e-8)
    tail = sum(math.comb(20, k) * 0.3 ** k * 0.7 ** (20 - k) for k in range(8, 21))
    assert qt.binomial_tail(20, 0.3, 8) == pytest.approx(tail, abs=1e-12)


def test_inflated_box_contains_the_plain_box(spark):
    df = spark.createDataFrame([(0.4, 0.3), (0.8, 0.05)], "e double, p1 double")
    eta = s.logit("p1")
    for way in s.DIRECTIONS:
        lo, hi = s.box("p1", "e", 2.0, way)
        a, b = iv.inflate_box(F.col("e") - 0.1, eta - 0.3, eta + 0.3, 2.0, way)
        for r in df.select(lo.alias("lo"), hi.alias("hi"), a.alias("a"), b.alias("b")).collect():
            assert r["a"] <= r["lo"] + 1e-12 and r["b"] >= r["hi"] - 1e-12
