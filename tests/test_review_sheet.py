"""The review pool, the sheet handed to reviewers, and the report of the code route."""

import pytest
from pyspark.sql import functions as F

from halfseen.functions.hashing import hash32
from halfseen.operators import review as rv
from halfseen.plans import cohorts as co

ORDER = ("positive", "negative", "missing")


def pool(spark, n=3000):
    st = F.when(F.col("id") % 10 == 0, "missing").when(F.col("id") % 3 == 0, "positive").otherwise("negative")
    return spark.range(n).select(F.col("id").alias("note_id"), st.alias("st"), F.repeat(F.lit("x"), 50).alias("text"))


@pytest.mark.parametrize("most", [0, 1, 40, 2999])
def test_pool_is_the_first_in_hash_order(spark, most):
    df = pool(spark)
    want = [r[0] for r in df.orderBy(hash32("note_id", "s"), "note_id").limit(most).collect()]
    got = rv.pool_sample(df, most, "note_id", "s")
    assert sorted(r["note_id"] for r in got.collect()) == sorted(want) and got.columns == df.columns


def test_small_pool_stays_whole(spark):
    df = pool(spark, 30)
    assert rv.pool_sample(df, 30, "note_id", "s").count() == 30
    assert rv.pool_sample(df.limit(0), 5, "note_id", "s").count() == 0


def test_sheet_is_shuffled_and_blank(spark):
    rows = rv.review_sheet(pool(spark), "st", ORDER, 90, "note_id", "s").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(90))
    assert {s: sum(r["st"] == s for r in rows) for s in ORDER} == dict.fromkeys(ORDER, 30)
    assert all(r[c] == "" for r in rows for c in rv.TRUTH_COLUMNS)
    changes = sum(a["st"] != b["st"] for a, b in zip(rows, rows[1:]))
    assert changes > 30                                   # in the order of strata there would be two
    again = rv.review_sheet(pool(spark).repartition(7), "st", ORDER, 90, "note_id", "s").orderBy("position").collect()
    assert [r["note_id"] for r in again] == [r["note_id"] for r in rows]
    assert rv.review_sheet(pool(spark).limit(0), "st", ORDER, 90, "note_id", "s").count() == 0


def test_code_route_report(spark):
    df = spark.createDataFrame([(1, 10, 1.0, "stay"), (1, None, 0.0, "stay"), (0, 11, 0.0, "record_table"), (0, None, None, "none"), (0, 12, 1.0, "stay")],
                               "t int, nearest_id long, y_code double, code_source string")
    circ, sources = co.code_route(df)
    got = {r["split"]: r for r in circ.collect()}
    assert (got["selected"]["n1"], got["selected"]["k1"], got["selected"]["n0"], got["selected"]["k0"]) == (2, 1, 2, 1)
    assert (got["linked"]["n1"], got["linked"]["k1"], got["linked"]["n0"], got["linked"]["k0"]) == (3, 2, 1, 0)
    assert got["linked"]["risk_ratio"] is None and got["selected"]["risk_ratio"] == pytest.approx(1.0)
    assert sorted(map(tuple, sources.collect())) == [(0, "none", 1, 0), (0, "record_table", 1, 1), (0, "stay", 1, 1), (1, "stay", 2, 2)]
