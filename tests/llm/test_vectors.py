"""Whitening and centroid clusters against plain numpy, on awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halfseen.llm import simplex_clusters as sc
from halfseen.llm import vectors, whitening as wh

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, id string, x int, n int, cluster string, component string"


def frame(spark, rows):
    """Rows (vec_id, vector) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, "a", 1, 2, "b", "c") for i, v in rows], SCHEMA)


def noise(n, d, seed=0):
    return np.random.default_rng(seed).normal(0, 0.2, (n, d)).astype(np.float32)


def awkward(d, n=60):
    good = [(k, [float(v) for v in r]) for k, r in enumerate(noise(n, d))]
    return good, [(900, None), (901, []), (902, [0.5] * (d - 1)), (903, [None] + [0.1] * (d - 1)), (904, [math.nan] + [0.1] * (d - 1)),
                  (905, [-math.inf] + [0.1] * (d - 1)), (906, [3e38] + [0.1] * (d - 1))]


def plain_whitening(matrix, k):
    x = np.floor(1024 * matrix.astype(float)) + 100_000
    y = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(y.T @ y / len(y))
    order = np.argsort(-values)[:k]
    return x.astype(np.int64), values[order], y @ turn[:, order] / np.sqrt(values[order]), values.sum()


def check_whitening(got, ids, matrix, k):
    x, values, z, trace = plain_whitening(matrix, k)
    n = len(x)
    dev = {i: int(((n * r.astype(object) - x.sum(axis=0)) ** 2).sum()) for i, r in zip(ids, x)}
    assert len(got) == n * k
    at = {i: p for p, i in enumerate(ids)}
    signs = {}
    for r in got:
        p, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and int(r["deviation"]) == dev[r["vec_id"]]
        assert abs(r["explained"] / (values[c] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9
        assert abs(abs(r["whitened"]) - abs(z[p, c])) < 1e-7
        if abs(z[p, c]) > 1e-3:
            signs.setdefault(c, set()).add(bool(r["whitened"] * z[p, c] > 0))
    assert all(len(s) == 1 for s in signs.values())      # one sign for all rows of a component


def test_whitening_brute(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    check_whitening(wh.whiten(df.repartition(7)).collect(), [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float32), 8)


def test_whitening_awkward(spark):
    good, bad = awkward(5)
    df = frame(spark, good + bad).repartition(3)
    check_whitening(wh.whiten(df).collect(), [i for i, _ in good], np.array([v for _, v in good], np.float32), 5)
    check_whitening(wh.whiten(df, components=2).collect(), [i for i, _ in good], np.array([v for _, v in good], np.float32), 2)
    assert wh.whiten(df.limit(0)).collect() == [] and wh.whiten(frame(spark, bad[:2] + bad[3:])).collect() == []
    assert dict(wh.whiten(df.limit(0)).dtypes) == dict(wh.whiten(df).dtypes)


def test_whitening_without_variance(spark):
    same = frame(spark, [(None, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0])])
    got = wh.whiten(same).collect()
    assert len(got) == 9 and {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in got} == {(None, None, None, 0)}
    flat = wh.whiten(frame(spark, [(k, [float(k), 1.0, 2.0 * k]) for k in range(5)])).collect()
    by = {c: {r["whitened"] for r in flat if r["component"] == c} for c in (1, 2, 3)}
    assert by[2] == by[3] == {None} and len(by[1]) == 5 and {round(r["explained"], 9) for r in flat if r["component"] == 1} == {1.0}


def test_wide_sums_stay_exact():
    y = np.array([[1 << 40, -(1 << 41)], [3, 4]])
    assert [int(v) for v in wh.deviations(y).to_pylist()] == [(1 << 80) + (1 << 82), 25]


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1.0] * 6, [3, 3, 3, 1e-9, 0, 0, 0], [1, 1 - 1e-7, 1 - 2e-7, 0.5, 0.4], [7], list(range(40, 0, -1)),
                                    [1e6] + [1 + k * 1e-5 for k in range(30)]])
def test_feast_finds_what_the_inertia_counts(values):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = (q * np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    inertia = wh.Inertia(a)
    exact = np.linalg.eigvalsh(a)
    for shift in np.linspace(inertia.low, inertia.high, 23):
        if np.abs(exact - shift).min() > 1e-9 * max(values):
            assert inertia.above(shift) == (exact > shift).sum()
    k = min(8, len(values))
    got, turn = wh.principal(a, k)
    assert np.allclose(got, np.sort(values)[::-1][:k], rtol=1e-12, atol=1e-12 * max(values))
    assert np.abs(turn.T @ turn - np.eye(k)).max() < 1e-13 and np.abs(a @ turn - turn * got).max() < 1e-12 * max(values)


def test_feast_tells_when_pairs_are_missing(monkeypatch):
    monkeypatch.setattr(wh, "SWEEPS", 3)
    with pytest.raises(ArithmeticError):
        wh.feast(np.diag([3.0, 2.0, 1.0]), 1.5, 3.5, 3)


def plain_clusters(rows, k=16, rounds=3, scale=64):
    x = {i: np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows}
    centroids = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]]

    def assign():
        return {i: min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(centroids)) for i, v in x.items()}
    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            own = [x[i] for i in x if at[i][1] == n]
            if own:
                centroids[n] = np.array([int(s) // len(own) for s in np.sum(own, axis=0)])
    at = assign()
    total = {n: sum(d for d, m in at.values() if m == n) for n in range(len(centroids))}
    return {i: (n, d, total[n], sum(total.values()), hashlib.sha256(",".join(str(int(v)) for v in centroids[n]).encode()).hexdigest())
            for i, (d, n) in at.items()}


FIELDS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_brute(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = plain_clusters(rows)
    for pivots in (16, 3, 1):
        got = sc.simplex_clusters(df.repartition(5), pivots=pivots).collect()
        assert {r["vec_id"]: tuple(r[f] for f in FIELDS) for r in got} == want and len(got) == len(rows)
        assert all(1 <= r["compared"] <= 16 for r in got)


def test_clusters_awkward(spark):
    good, bad = awkward(64, 9)
    got = sc.simplex_clusters(frame(spark, good + bad)).collect()
    assert {r["vec_id"]: tuple(r[f] for f in FIELDS) for r in got} == plain_clusters(good)
    twice = good + [(k, v) for k, v in good] + [(None, good[0][1])] * 3
    got = sc.simplex_clusters(frame(spark, twice), k=4, rounds=1).collect()
    assert len(got) == len(twice) and len({r["inertia"] for r in got}) == 1
    by = {}
    for r in got:
        if r["vec_id"] is not None:
            assert by.setdefault(r["vec_id"], tuple(r)) == tuple(r)
    for few in (frame(spark, []), frame(spark, bad)):
        assert sc.simplex_clusters(few).collect() == []


def test_bounds_hold_and_rule_centroids_out(spark):
    """Bounds enclose the exact distances, also with pivots in one line, and clustered vectors need few comparisons."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-60, 60, (16, 64))
    x = (middle[rng.integers(0, 16, 3000)] + rng.integers(-4, 5, (3000, 64))).astype(np.int64)
    line = np.array([middle[0], middle[0] + 1, middle[0] + 2, middle[0]])
    assert len(sc.Simplex(line).pivots) == 2
    for pivots in (middle, middle[:5], line):
        s = sc.Simplex(pivots)
        moved = middle + rng.integers(-2, 3, middle.shape)
        exact = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
        low, high = sc.bounds(s.apexes(x), s.apexes(moved))
        assert (low <= exact).all() and (exact <= high).all()
        label, best, compared = sc.nearest(x, s.apexes(x), moved, s.apexes(moved))
        assert (best == exact.min(axis=1)).all() and (label == exact.argmin(axis=1)).all()
        if len(pivots) == 16:
            assert compared.mean() < 2


def test_vectors_are_not_shuffled(spark):
    """Only the sums of a task and the counts of lengths are dealt out."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    plan = wh.whiten(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert df.where(vectors.finite("embedding")).count() == df.where(F.col("embedding").isNotNull()).count()
