"""Work that must not be repeated as tables grow: plans and counts, not times."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from halfseen.catalog import base
from halfseen.catalog import model_queries as mq
from halfseen.catalog import text_queries as tq
from halfseen.functions import notes as patterns
from halfseen.operators import boosting as bo
from halfseen.operators import gamma as gm
from halfseen.operators import learners as ln
from halfseen.operators import notes as no
from halfseen.operators import outcomes as oc
from halfseen.operators import quantile as qt
from halfseen.operators import temporal as tm
from halfseen.operators import validate as vd
from halfseen.plans import cohorts as co


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_primary_pick_reads_the_text_once(spark):
    rows = [("Prior echo EF 60%.\nEcho today shows EF 35%.",), ("Echo today shows EF 35%.\nPrior echo EF 60%.",), ("Prior EF 40%.",),
            ("Volume. EF 50%.\nEcho: EF 30%.\nVolume of the cells seen" + " fine" * 50 + ". EF 45%.",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "text string").select(patterns.pick_primary(patterns.ef_numeric("text"))["value"].alias("v"))
    assert plan(df).count("regexp_extract_all(") == 1
    assert [r["v"] for r in df.collect()] == [35.0, 35.0, 40.0, 30.0, None, None]


SF = "/root/testdata/sf0.001"


def counted(df, column):
    """The rows with a counter of how often they are computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v
    kind = df.schema[column].dataType
    return df.withColumn(column, F.udf(look, kind).asNondeterministic()(F.col(column))), seen


def test_features_of_orders_are_joined_once(spark):
    assert "Join" not in plan(mq.order_features(spark, SF))


def test_calibration_computes_its_rows_twice_at_most(spark):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 5 % 11 > 4).cast("double").alias("y"))
    rows, seen = counted(df, "x")
    ln.fit_calibrated(rows, ["x"], "y", "id")
    assert seen.value <= 800              # the class counts, and the folds that are handed over


def test_split_points_are_searched_in_generated_code(spark):
    rng = np.random.default_rng(3)
    marks = np.unique(np.round(rng.normal(size=255), 3))
    values = [*np.round(rng.normal(size=500), 3).tolist(), *marks[:40].tolist(), float(marks[-1]) + 1, float(marks[0]) - 1]
    ends = ["0L AS __base", "CAST(NULL AS double) AS __lo", "CAST(NULL AS double) AS __hi", "0L AS n"]
    within = spark.createDataFrame([("a", v, 1) for v in values], "name string, value double, __f long").selectExpr("*", *ends)
    table = spark.createDataFrame([("a", marks.tolist())], "name string, __marks array<double>").withColumn("__lo", F.lit(None).cast("double"))
    got = qt._cells(within, table, ["name"], ["name", "n", "__lo", "__hi", "__base"])
    assert "lambda" not in plan(got)
    want = Counter(int(np.searchsorted(marks, v, "left") + np.searchsorted(marks, v, "right")) for v in values)
    assert {r["__cell"]: r["__rows"] for r in got.collect()} == want


def test_derived_units_compute_their_rows_once(spark):
    rows, seen = counted(base.order_units(spark, SF).drop("z"), "bal")
    co.derive_units(rows, centre="segment", decision="t", outcome="y", covariates={"b": F.col("bal"), "p": F.col("price")})[1].collect()
    assert seen.value == rows.count()


def test_loan_features_compute_their_rows_once(spark):
    rows, seen = counted(base.order_units(spark, SF).withColumns({"rate": F.lit(3.0), "grade": F.lit("C4")}), "bal")
    co.loan_features(rows, numeric=["bal", "price"], money=["bal"], term="grade", employment="priority", scale={"1-URGENT": 0.0, "2-HIGH": 1.0},
                     verification="segment", rate="rate", grade="grade").agg(F.avg("x_bal")).collect()
    assert seen.value == rows.count()


def test_equal_notes_are_read_once(spark):
    texts = ["Echo: EF 30%. IVSd 1.5 cm.", "Severe aortic stenosis on echo; EF preserved.", None, ""]
    many = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "id int, text string")
    once = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    read = no.extract(many)
    assert "regexp_extract_all(" not in plan(read) and "regexp_extract_all(" in plan(no.extract(once))
    assert read.columns == no.extract(once).columns
    told = {r["id"]: r.asDict(True) for r in no.extract(once).collect()}
    for r in read.collect():
        assert r.asDict(True) == told[r["id"] % 4] | {"id": r["id"]}


def test_rules_are_judged_once(spark):
    rows, seen = counted(spark.range(50).withColumn("v", F.col("id") % 5), "v")
    got = vd.violations(rows, {"zero": F.col("v") == 0, "four": F.col("v") == 4, "never": F.col("v") == 9}, "id", 2).collect()
    assert {(r["rule"], r["n"], *r["first_ids"]) for r in got} == {("zero", 10, 0, 5), ("four", 10, 4, 9)}
    assert seen.value == 50


def test_leniency_computes_its_units_once(spark):
    units, seen = counted(base.order_units(spark, SF).withColumn("s0", (F.col("segment") == "BUILDING").cast("double")), "s0")
    gm.leniency(units, ["s0"], z="z", t="t", y="y_obs", ident="okey", seeds=1, folds=2, boot=False)
    assert seen.value == units.count()


def test_folds_of_folds_compute_their_rows_once(spark):
    rows = spark.range(60).withColumn("s", F.col("id") % 3)
    both = vd.stratified_folds(vd.stratified_folds(rows, ["s"], "id", 3, "a").withColumnRenamed("fold", "f"), ["s", "f"], "id", 2, "b")
    assert "Range (" not in plan(both)
    assert sorted(r["count"] for r in both.groupBy("s", "f", "fold").count().collect()) == [3] * 12 + [4] * 6


def test_bins_seen_before_are_not_scored_again():
    class Told(bo.Boosted):
        asked = 0

        def scores(self, bins):
            self.asked += len(bins)
            return bins.sum(axis=1, keepdims=True).astype(float)

    own, known = Told(["a", "b"], [], [], bo.Settings()), {}
    bins = np.array([[1, 2], [3, 4], [1, 2], [255, 0]])
    for _ in range(3):
        assert own.recalled(bins, known).ravel().tolist() == [3.0, 7.0, 3.0, 255.0]
    assert own.asked == 3
    assert own.recalled(np.array([[9, 9], [1, 2]]), known, lambda v: v * 2).ravel().tolist() == [36.0, 3.0]


def test_linked_outcomes_compute_units_and_notes_once(spark):
    n, many = 40, 400
    units = spark.range(n).select("id", (F.col("id") % 4).alias("by"), (F.col("id") * 10).alias("at"), (F.col("id") % 2).cast("int").alias("t"),
                                  F.lit(None).cast("bigint").alias("study_time"), F.lit(None).cast("bigint").alias("nearest_id"))
    units, asked = counted(units, "at")
    stays = spark.range(many).select((F.col("id") % 4).alias("by"), F.col("id").alias("stay_id"), F.col("id").alias("start"), (F.col("id") + 5).alias("stop"))
    notes = stays.select((F.col("stay_id") * 10).alias("note"), "stay_id", F.concat(F.lit("Echo: EF "), (20 + F.col("stay_id") % 60).cast("string"), F.lit("%.")).alias("text"))
    notes, rendered = counted(notes, "text")
    dx = stays.select("stay_id", F.lit("I35.0").alias("code"), F.lit(10).alias("version"))
    x = co.linked_outcomes(units, ident="id", by="by", time="at", notes=notes, note="note", note_stay="stay_id", stays=stays, window=7, diagnoses=dx)
    got = {r["id"]: r for r in x.collect()}
    assert (asked.value, rendered.value) == (n, many)
    for i in range(n):
        near = [s for s in range(many) if s % 4 == i % 4 and s <= i * 10 + 7 and s + 5 >= i * 10 - 7]
        inside = [s for s in near if s <= i * 10 <= s + 5]
        assert (got[i]["note_n"], got[i]["code_source"]) == (len(near), "stay" if inside else "none")
        assert got[i]["y_note"] == (max(float(20 + s % 60 <= 45) for s in near) if near else None)


def test_planning_to_spread_texts_runs_nothing(spark):
    many, seen = counted(spark.range(60).select("id", F.concat(F.lit("EF "), (30 + F.col("id") % 3).cast("string"), F.lit("%.")).alias("text")), "text")
    assert no.extract(many).select("id", "lvef").distinct().count() == 60
    assert seen.value <= 180              # counted, made distinct, joined to the records


@pytest.mark.parametrize("limit", ["3", "2000000"])
def test_lookups_are_measured_without_their_condition(spark, limit):
    left = spark.createDataFrame([(1, 1, 50), (2, 1, 5), (3, 2, 50), (4, 2, 31)], "id int, k int, at bigint")
    rows = [(k, 10 * i, " " if i % 2 else f"U{i}") for k in (1, 2) for i in range(5)]
    units = spark.createDataFrame(rows, "k int, intime bigint, unit string").withColumn("outtime", F.lit(None).cast("bigint"))
    units, seen = counted(units, "unit")
    spark.conf.set("spark.halfseen.blockRows", limit)
    try:
        got = {r["id"]: (r["z"], r["z_source"]) for r in tm.attach_decision_maker(left, units, by="k", time="at").collect()}
    finally:
        spark.conf.unset("spark.halfseen.blockRows")
    assert got == {1: ("U4", "careunit"), 2: ("U0", "careunit"), 3: ("U4", "careunit"), 4: ("U2", "careunit")}
    assert seen.value == len(rows)


def test_codes_are_normalised_once(spark):
    records = spark.createDataFrame([(1, 1, 5)], "id int, k int, at bigint")
    stays = spark.createDataFrame([(1, 7, 0, 9)], "k int, stay_id bigint, start bigint, stop bigint")
    dx = spark.createDataFrame([(7, " i35.0", 10), (7, "i50", 9), (7, "Z1", 10)], "stay_id bigint, code string, version int")
    x = oc.label_from_codes(records, ident="id", by="k", time="at", stays=stays, diagnoses=dx)
    assert plan(x).count("regexp_replace(") == 1
    assert x.select("y_code", "code_source", "code_matched").first() == (1.0, "stay", "I350")


def test_linked_outcomes_parse_their_events_once(spark):
    assert "get_json_object" not in plan(tq.coded_units(spark, SF))
    whole, handed = base.events(spark, SF), base.event_kinds(spark, SF)
    for kind in ("view", "purchase", "signup", "click", "error"):
        names = ["event_id", "subject", "at", "event_type", "k"]
        want = whole.filter(F.col("event_type") == kind).select(*names)
        got = base.events(spark, handed, kind)
        assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect()) and got.count() > 0
