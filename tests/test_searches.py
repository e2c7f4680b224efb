"""Searches end at a tolerance, not after a number of passes."""

import pytest
from halfseen.functions import scalar as s
from halfseen.operators import gamma as gm
from halfseen.operators import objectives as ob
from halfseen.operators import ranking as rk
from pyspark.sql import functions as F


def units(spark):
    rows = [(0.1 * k, 0.3 + 0.05 * (k % 4), 0.2 + 0.06 * k, 1.0) for k in range(8)]
    return spark.createDataFrame(rows, "s double, e double, p1 double, w double")


def upper(df, g):
    lo, hi = s.box("p1", "e", g)
    return rk.sharp_interval(df.withColumns({"lo": lo, "hi": hi}), "s", weight="w").collect()[0]["upper"]


def test_gamma_to_tolerance_without_top(spark):
    df = units(spark)
    for true in (1.7, 150.0):       # beyond the first range too
        found = gm.search_containing(df, upper(df, true), weight="w")
        assert abs(found / true - 1) < 1e-4
    assert gm.search_containing(df, 1.5, weight="w") is None


def test_lambda_to_tolerance(spark):
    df = units(spark)
    _, lam, _ = ob.budgeted_risk(df, gamma=2.0, budget=0.3, weight="w")
    tilts = {r["lam"]: r["tilt"] for r in ob.budget_at(df, [lam - 1e-7, lam + 1e-7], gamma=2.0, weight="w").collect()}
    assert tilts[lam + 1e-7] <= 0.3 <= tilts[lam - 1e-7]


def test_budgeted_risk_against_dual(spark, request):
    import math
    import random
    rnd = random.Random(6)
    rows = [(rnd.uniform(-3, 3), rnd.uniform(.05, .95), rnd.uniform(.05, .95), float(rnd.randrange(1, 5))) for _ in range(50)]
    df = spark.createDataFrame(rows, "s double, p1 double, e double, w double")
    tau = [-math.log(3.0) + i * 2.0 * math.log(3.0) / 40 for i in range(41)]
    total = sum(r[3] for r in rows)

    def choices(sc, p1, e):
        for t in tau:
            q = e * p1 + (1 - e) / (1 + (1 - p1) / p1 * math.exp(-t))
            yield q * math.log1p(math.exp(-sc)) + (1 - q) * math.log1p(math.exp(sc)), abs(t)

    grid = [(list(choices(*r[:3])), r[3]) for r in rows]
    # the dual is convex and bends only at slopes between two choices of a unit
    slopes = {0.0} | {(r - q) / (a - b) for c, _ in grid for r, a in c for q, b in c if a - b > 1e-9 and r > q}
    slopes = sorted(slopes)
    dual = lambda lam, b: lam * b + sum(w * max(r - lam * a for r, a in c) for c, w in grid) / total
    for block in ("2000000", "7"):
        spark.conf.set("spark.halfseen.blockRows", block)
        request.addfinalizer(lambda: spark.conf.unset("spark.halfseen.blockRows"))
        for row in ob.budgeted_risks(df, [0.0, 0.1, 0.45, 1.0], gamma=3.0, weight="w", points=41).collect():
            lo, hi = 0, len(slopes) - 1
            while hi - lo > 2:
                a, b = lo + (hi - lo) // 3, hi - (hi - lo) // 3
                lo, hi = (lo, b) if dual(slopes[a], row["budget"]) <= dual(slopes[b], row["budget"]) else (a, hi)
            best = min(dual(slopes[i], row["budget"]) for i in range(lo, hi + 1))
            assert row["risk"] == pytest.approx(best, rel=1e-9)
            assert dual(row["lam"], row["budget"]) == pytest.approx(best, rel=1e-9)
            assert row["tilt"] <= row["budget"] + 1e-12
    assert ob.budgeted_risks(df.filter("false"), [0.1], gamma=3.0).count() == 0
