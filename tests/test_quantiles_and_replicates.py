"""Exact quantiles by bracket, bootstrap sums, and the interval from influence values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halfseen.operators import evaluation as ev
from halfseen.operators.quantile import exact_quantiles

PROBS = [0.0, 0.05, 0.5, 0.731, 1.0]


@pytest.fixture(params=["plain", "blocks of 3", "blocks of 50"])
def limit(request, spark):
    if request.param != "plain":
        spark.conf.set("spark.halfseen.blockRows", request.param.split()[-1])
    yield
    spark.conf.unset("spark.halfseen.blockRows")


def values(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice([rnd.gauss(0, 1), float(rnd.randrange(4)), -1e300, 1e-300, None, math.nan, 0.0]) for _ in range(n)]


def test_quantiles_against_numpy(spark, limit):
    groups = {"a": values(900, 1), None: values(400, 2), "small": [4.0, 2.0], "same": [7.0] * 300, "none": [None, math.nan]}
    rows = [(k, v, 2.0 * v if v is not None and abs(v) < 1e200 else None) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(7)
    got = {(r["k"], r["name"]): r for r in exact_quantiles(df, {"v": "v", "w": "w"}, PROBS, keys=["k"]).collect()}
    for k, vs in groups.items():
        for name, f in (("v", lambda v: v), ("w", lambda v: 2.0 * v)):
            known = [f(v) for v in vs if v is not None and not math.isnan(v) and (name == "v" or abs(v) < 1e200)]
            if not known:
                assert (k, name) not in got
                continue
            r = got[(k, name)]
            assert r["n"] == len(known)
            for i, q in enumerate(PROBS):
                assert r[f"q{i}"] == pytest.approx(float(np.quantile(np.array(known), q)), rel=1e-12, abs=1e-12)


def test_quantiles_with_frequencies(spark, limit):
    rnd = random.Random(4)
    rows = [(rnd.randrange(60) / 7.0, rnd.choice([1, 2, 5000])) for _ in range(500)]
    df = spark.createDataFrame(rows, "v double, f bigint")
    got = exact_quantiles(df, {"v": "v"}, PROBS, count="f").collect()[0]
    flat = np.repeat([v for v, _ in rows], [f for _, f in rows])
    assert got["n"] == len(flat)
    assert [got[f"q{i}"] for i in range(len(PROBS))] == pytest.approx(np.quantile(flat, PROBS).tolist())


def test_quantiles_of_nothing(spark, limit):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, {"v": "v"}, [0.5]).collect() == []


def test_median_of_a_large_group_moves_few_rows(spark):
    spark.conf.set("spark.halfseen.blockRows", "2000")
    try:
        df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("v"))
        from halfseen.operators import quantile as q
        seen = []
        kept, q._inside = q._inside, lambda *a: seen.append(kept(*a)) or seen[-1]
        try:
            got = exact_quantiles(df, {"v": "v"}, [0.5]).collect()[0]
        finally:
            q._inside = kept
        assert got["q0"] == np.median([i * 7919 % 100_003 for i in range(100_000)])
        assert seen[-1].count() <= 2000          # only this is grouped by value and sorted
    finally:
        spark.conf.unset("spark.halfseen.blockRows")


def weights(ids, total):
    import hashlib

    from halfseen.functions.hashing import replicate_weights
    h = np.array([int(hashlib.md5(f"{i}|replicates".encode()).hexdigest()[:8], 16) for i in ids], dtype=np.int64)
    return replicate_weights(None, h, total)


def test_replicate_sums_against_loop(spark):
    rows = [(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else i / 4.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k int, v double").repartition(5)
    got = {(r["k"], r["seed"], r["rep"]): (r["bw"], r["v"]) for r in
           ev.replicate_sums(df, "id", {"v": "v"}, keys=["k"], seeds=2, replicates=6).collect()}
    w = weights(range(60), 12)
    for k in (None, 0, 1, 2):
        mine = [i for i, kk, _ in rows if kk == k]
        for p in range(12):
            want = sum(w[i, p] for i in mine), sum(w[i, p] * (rows[i][2] or 0.0) for i in mine)
            assert got[(k, p // 6, p % 6)] == pytest.approx(want)
    assert len(got) == 48
    assert ev.replicate_sums(df.limit(0), "id", {"v": "v"}, seeds=1, replicates=3).count() == 0


def test_weights_have_mean_and_variance_one():
    w = weights(range(4000), 50)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    pairs = np.corrcoef(w.T)
    assert np.abs(pairs - np.eye(50)).max() < 0.08          # replicates are unrelated


def auc(score, y, w):
    up, down = [(s, x) for s, t, x in zip(score, y, w) if t == 1], [(s, x) for s, t, x in zip(score, y, w) if t == 0]
    total = sum(a * b for _, a in up for _, b in down)
    won = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for s, a in up for t, b in down)
    return won / total if total else None


@pytest.mark.parametrize("distinct", [3, 1000])
def test_auc_replicates_against_pairs(spark, distinct, monkeypatch):
    import hashlib

    from halfseen.functions.hashing import replicate_weights
    monkeypatch.setattr(ev, "CELLS", 40)          # ties go over several pieces of a batch
    rnd = random.Random(2)
    rows = [(float(rnd.randrange(distinct)), rnd.randrange(2)) for _ in range(90)] + [(None, 1), (1.0, None)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = {r["rep"]: r["auc"] for r in ev.auc_replicates(df, "s", "y", seeds=1, replicates=8, blocks=4).collect()}
    packed = {}
    for s, y in rows[:-2]:
        packed[(s, float(y))] = packed.get((s, float(y)), 0) + 1
    keys = list(packed)
    h = np.array([int(hashlib.md5(f"{s}/{y}|replicates".encode()).hexdigest()[:8], 16) for s, y in keys], dtype=np.int64)
    w = replicate_weights(np.array([packed[k] for k in keys]), h, 8)
    for p in range(8):
        assert got[p] == pytest.approx(auc([k[0] for k in keys], [k[1] for k in keys], w[:, p]))


def test_influence_interval_against_definition(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(12) / 2.0, rnd.randrange(2)) for _ in range(80)]
    df = spark.createDataFrame(rows, "s double, y int")
    up, down = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    wins = np.array([[1.0 if a > b else 0.5 if a == b else 0.0 for b in down] for a in up])
    se = math.sqrt(wins.mean(1).var(ddof=1) / len(up) + wins.mean(0).var(ddof=1) / len(down))
    r = ev.influence_interval(df, "s", "y").collect()[0]
    assert (r["auc"], r["se"], r["n_pos"], r["n_neg"]) == pytest.approx((wins.mean(), se, len(up), len(down)))
    packed = df.groupBy("s", "y").count()
    assert ev.influence_interval(packed, "s", "y", count="count").collect()[0]["se"] == pytest.approx(se)
    assert ev.influence_interval(df.filter("y = 1"), "s", "y").collect()[0]["se"] is None
    assert ev.influence_interval(df.filter("false"), "s", "y", keys=["y"]).count() == 0


def test_normal_quantile_against_library():
    from statistics import NormalDist

    from halfseen.functions.hashing import _normal_ppf
    u = np.array([1.2e-10, 1e-6, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.9, 0.9251, 1 - 1e-9])
    assert _normal_ppf(u) == pytest.approx([NormalDist().inv_cdf(float(x)) for x in u], rel=1e-12, abs=1e-14)


def test_equal_bins_against_ranks(spark, limit):
    import hashlib

    from halfseen.operators import intervals as iv
    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, 0.25, 0.5, 0.5, 0.5, rnd.random()])) for i in range(400)]
    got = {r["id"]: r["bin"] for r in iv.equal_bins(spark.createDataFrame(rows, "id int, v double"), "v", 7, "id").collect()}
    h = {i: int(hashlib.md5(f"{i}|bins".encode()).hexdigest()[:8], 16) for i, _ in rows}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, h[r[0]], r[0]))       # nulls first
    assert got == {i: min(k * 7 // 400, 6) for k, (i, _) in enumerate(order)}
