"""Golden rows of the temporal operators, each in the plain and the blocked form."""

import random

import pytest
from pyspark.sql import functions as F

from halfseen.operators import temporal as tm

D = tm.DAY


@pytest.fixture(params=["plain", "blocked"])
def form(request, spark):
    if request.param == "blocked":
        spark.conf.set("spark.halfseen.blockRows", "3")
    yield request.param
    spark.conf.unset("spark.halfseen.blockRows")


def test_nearest_boundaries_and_ties(spark, form):
    left = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1000 * D)],
                                 "id int, subject int, time bigint")
    right = spark.createDataFrame(
        [(11, 1, 365 * D), (12, 2, 366 * D), (13, 3, -365 * D),
         (30, 5, 990 * D), (10, 5, 1010 * D), (20, 5, 1475 * D)], "rid int, subject int, rt bigint")
    rows = {r["id"]: r for r in tm.nearest_join(left, right, by="subject", time="time", right_time="rt",
                                                right_id="rid", window=365 * D).collect()}
    assert [rows[i]["t"] for i in (1, 2, 3, 4)] == [1, 0, 1, 0]
    assert rows[2]["gap"] == 366 * D and rows[2]["nearest_id"] == 12
    assert rows[3]["gap"] == -365 * D
    assert rows[4]["nearest_id"] is None and rows[4]["gap"] is None
    assert rows[5]["nearest_id"] == 10


def test_duplicate_units_are_an_error(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(ValueError, match="unique"):
        tm.unique_or_fail(df, "id")


def test_coverage(spark):
    recs = spark.createDataFrame([(i, i * D) for i in range(-5, 16)], "id int, time bigint")
    cover = tm.coverage(spark.createDataFrame([(0,), (10 * D,)], "t bigint"), "t")
    assert tm.restrict_to_coverage(recs, cover, "time", 2 * D).count() == 15
    assert tm.restrict_to_coverage(recs, cover, "time", 0).count() == 11


def greedy(times, gap):
    kept, last = [], None
    for t, i in sorted(times):
        if last is None or t - last >= gap:
            kept.append(i)
            last = t
    return sorted(kept)


def test_greedy_gap(spark, form):
    days = [0, 10, 29, 30, 45, 61]
    df = spark.createDataFrame([(1, i, d * D) for i, d in enumerate(days)], "subject int, id int, time bigint")
    out = tm.greedy_gap(df, by="subject", ident="id", time="time", gap=30 * D)
    assert sorted(r["id"] for r in out.collect()) == [0, 3, 5]
    tie = spark.createDataFrame([(1, 4, 0), (1, 3, 40 * D), (1, 2, 65 * D), (1, 1, 0)],
                                "subject int, id int, time bigint")
    out = tm.greedy_gap(tie, by="subject", ident="id", time="time", gap=30 * D)
    assert sorted(r["id"] for r in out.collect()) == [1, 3]


def test_greedy_gap_random_against_loop(spark, form):
    rnd = random.Random(5)
    rows = [(s, s * 1000 + i, rnd.randrange(0, 400)) for s in range(3) for i in range(120)]
    out = tm.greedy_gap(spark.createDataFrame(rows, "subject int, id int, time bigint"),
                        by="subject", ident="id", time="time", gap=17)
    want = sum((greedy([(t, i) for s, i, t in rows if s == k], 17) for k in range(3)), [])
    assert sorted(r["id"] for r in out.collect()) == sorted(want)


def test_asof_random_against_loop(spark, form):
    rnd = random.Random(6)
    left = [(i, rnd.randrange(3), rnd.randrange(200)) for i in range(150)]
    right = [(i, rnd.randrange(3), rnd.randrange(200)) for i in range(60)]
    look = tm.Lookup(spark.createDataFrame(right, "rid int, k int, rt bigint"), "rt", ["rid"], "m",
                     tie="rid", tolerance=25)
    got = {r["id"]: (r["m_backward"], r["m_forward"]) for r in tm.asof_join(
        spark.createDataFrame(left, "id int, k int, lt bigint"), [look], "k", "lt",
        ("backward", "forward")).collect()}
    for i, k, t in left:
        back = [(rt, rid) for rid, rk, rt in right if rk == k and rt <= t]
        fwd = [(rt, -rid) for rid, rk, rt in right if rk == k and rt >= t]
        b, f = max(back, default=None), min(fwd, default=None)
        b = b[1] if b and t - b[0] <= 25 else None
        f = -f[1] if f and f[0] - t <= 25 else None
        assert (got[i][0]["rid"] if got[i][0] else None, got[i][1]["rid"] if got[i][1] else None) == (b, f)


def test_first_containing_and_counts_against_loop(spark, form):
    rnd = random.Random(7)
    left = [(i, rnd.randrange(2), rnd.randrange(300)) for i in range(120)]
    spans = []
    for j in range(40):
        a = rnd.randrange(280)
        spans.append((j, rnd.randrange(2), a, a + rnd.randrange(60)))
    ldf = spark.createDataFrame(left, "id int, k int, t bigint")
    sdf = spark.createDataFrame(spans, "sid int, k int, a bigint, b bigint")
    got = {r["id"]: r["span_id"] for r in tm.first_containing(
        ldf, sdf, by="k", time="t", start="a", end="b", ident="sid").collect()}
    wide = ldf.withColumns({"lo": F.col("t") - 9, "hi": F.col("t") + 9})
    cnt = {r["id"]: (r["n_w"], r["even_w"]) for r in tm.windowed_counts(
        wide, sdf, by="k", ident="id", windows={"w": ("lo", "hi")}, start="a", end="b",
        counts={"n": F.lit(1), "even": (F.col("sid") % 2 == 0)}).collect()}
    pairs = tm.overlap_pairs(wide, sdf, by="k", lower="lo", upper="hi", start="a", end="b", cell=50)
    assert pairs.count() == pairs.select("id", "sid").distinct().count() == sum(n for n, _ in cnt.values())
    for i, k, t in left:
        inside = [(a, -b, s) for s, sk, a, b in spans if sk == k and a <= t <= b]
        assert (got[i] is None) == (not inside)
        if inside:
            assert [s for s in spans if s[0] == got[i]][0][2] == min(inside)[0]
        over = [s for s, sk, a, b in spans if sk == k and a <= t + 9 and b >= t - 9]
        assert cnt[i] == (len(over), sum(s % 2 == 0 for s in over))


def test_decision_maker_chain(spark, form):
    recs = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "subject int, time bigint")
    units = spark.createDataFrame([(1, "MICU", 5, 20), (2, "ICU", 1, 9), (3, "Cardiac Surgery", 2, None),
                                   (3, " ", 9, None)],
                                  "subject int, unit string, intime bigint, outtime bigint")
    stays = spark.createDataFrame([(2, "EMERGENCY ROOM", 0, 30)],
                                  "subject int, location string, admittime bigint, dischtime bigint")
    serv = spark.createDataFrame([(2, "CMED", 3, 30), (4, "SURG", 3, 9)],
                                 "subject int, service string, transfertime bigint, endtime bigint")
    z = lambda **kw: [r["z"] for r in tm.attach_decision_maker(
        recs, units, by="subject", time="time", **kw).orderBy("subject").collect()]
    assert z() == ["MICU", "unknown", "Cardiac Surgery", "unknown"]
    assert z(stays=stays)[1] == "EMERGENCY ROOM"
    assert z(stays=stays, services=serv) == ["MICU", "CMED", "Cardiac Surgery", "unknown"]


def test_rows_without_key_or_time_stay_and_match_nothing(spark, form):
    left = spark.createDataFrame([(1, None, 5), (2, 7, None), (3, 7, 5), (4, None, None), (5, 7, 9)], "id int, k int, lt bigint")
    right = spark.createDataFrame([(1, 7, 4), (2, None, 4), (3, 7, None), (4, 7, 6)], "rid int, k int, rt bigint")
    got = tm.asof_join(left, [tm.Lookup(right, "rt", ["rid"], "m", tie="rid")], "k", "lt", ("backward", "forward"))
    rows = {r["id"]: (r["m_backward"] and r["m_backward"]["rid"], r["m_forward"] and r["m_forward"]["rid"]) for r in got.collect()}
    assert rows == {1: (None, None), 2: (None, None), 3: (1, 4), 4: (None, None), 5: (4, None)}


def test_many_rows_at_one_instant(spark, form):
    left = spark.createDataFrame([(i, 1, 5 if i < 40 else 4) for i in range(60)], "id int, k int, lt bigint")
    right = spark.createDataFrame([(1, 1, 3), (2, 1, 5), (3, 1, 5), (4, 1, 9)], "rid int, k int, rt bigint")
    got = tm.asof_join(left, [tm.Lookup(right, "rt", ["rid"], "m", tie="rid")], "k", "lt", ("backward", "forward"))
    for r in got.collect():
        assert (r["m_backward"]["rid"], r["m_forward"]["rid"]) == ((3, 3) if r["id"] < 40 else (1, 3))


def test_asof_null_ties_and_keys(spark, form):
    left = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, None, 10), (4, 3, None), (5, 3, 10)], "id int, k int, t bigint")
    right = spark.createDataFrame([(1, 5, None, 7), (2, 5, None, 8), (2, 5, 1, 9), (2, 5, 2, 6), (None, 5, 1, 1), (3, 5, 3, 4), (3, 5, None, 5)],
                                  "k int, rt bigint, tie int, val int")
    for smallest, want in ((False, {1: 7, 2: 6, 5: 4}), (True, {1: 7, 2: 9, 5: 4})):
        look = tm.Lookup(right, "rt", ["val"], "m", tie="tie", smallest=smallest)
        got = {r["id"]: r["m"]["val"] for r in tm.asof_join(left, [look], "k", "t").collect() if r["m"]}
        assert got == want


def test_first_containing_prefers_start_then_id(spark, form):
    spans = [(1, "b", 0, 5), (1, "c", 0, 10), (1, "a", 0, 3), (1, "d", 2, 20), (1, "e", 0, 5)]
    left = spark.createDataFrame([(t, 1, t) for t in (0, 3, 4, 5, 6, 10, 11, 20, 21)], "id int, k int, t bigint")
    got = {r["id"]: r["span_id"] for r in tm.first_containing(
        left, spark.createDataFrame(spans, "k int, sid string, a bigint, b bigint"), by="k", time="t", start="a", end="b", ident="sid").collect()}
    assert got == {0: "a", 3: "a", 4: "b", 5: "b", 6: "c", 10: "c", 11: "d", 20: "d", 21: None}


def test_hot_null_key_is_cut(spark, tiny_blocks):
    from halfseen.operators import scan
    rows = spark.createDataFrame([(None if i % 2 else 1, i) for i in range(60)], "k int, v bigint")
    one = scan.OrderedScan(rows, ["k"], ["v"])
    assert one.df.groupBy("k", scan._BLOCK).count().agg(F.max("count")).first()[0] <= 12
    got = {(r["k"], r["v"]): r["s"] for r in one.add(s=("sum", F.lit(1))).result().collect()}
    assert got == {(None if i % 2 else 1, i): i // 2 + 1 for i in range(60)}


def test_greedy_gap_over_batches_with_whole_rows(spark, form):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, *range(200)]), [f"n{i}"], rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "subject string, id int, time bigint, notes array<string>, __t double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = tm.greedy_gap(df, by="subject", ident="id", time="time", gap=11).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sum((greedy([(t, i) for s, i, t, *_ in rows if s == k and t is not None], 11) for k in "ab"), [])
    assert sorted(r["id"] for r in got) == sorted(want)
    assert all(tuple(r) == (rows[r["id"]][0], r["id"], rows[r["id"]][2], [f"n{r['id']}"], rows[r["id"]][4]) for r in got)
    assert tm.greedy_gap(df.limit(0), by="subject", ident="id", time="time", gap=11).count() == 0
