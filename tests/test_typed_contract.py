"""The typed screening contract: each rule alone, missing columns and empty tables first."""

import pytest
from pyspark.sql import functions as F

from halfseen.sources import typed as ty


def good(i):
    row = {"exam_id": str(i), "subject_id": f"p{i}", "exam_date": "2019-03-0%d" % (1 + i % 9), "centre_id": "c1", "age": "54", "sex": "F",
           "followup_test_ordered": "1", "outcome": "0", "followup_days": "400", "public_model_score": ""}
    row |= {n: str((lo + hi) / 2) for n, (_, lo, hi) in ty.SCREENING_NUMBERS.items()}
    return row | {n: "1" for n in (*ty.SCREENING_LEVELS, *ty.SCREENING_FLAGS)}


def table(spark, changes):
    rows = [good(i) for i in range(len(changes) + 1)]
    for row, change in zip(rows, changes):
        row.update(change)
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


BROKEN = [
    ({"sex": "X"}, "sex must be one of ['F', 'M'] (no missing)"), ({"sex": None}, "sex must be one of ['F', 'M'] (no missing)"),
    ({"bmi": "999.0"}, "bmi outside [10.0, 80.0] kg/m^2"), ({"bmi": "4d"}, "bmi must be numeric"), ({"ast": "Infinity"}, "ast must be numeric"),
    ({"exam_date": "2019/01/01"}, "exam_date must be formatted YYYY-MM-DD"), ({"exam_date": None}, "exam_date must be formatted YYYY-MM-DD"),
    ({"exam_date": "2019-02-30"}, "exam_date is not a valid calendar date"),
    ({"outcome": ""}, "outcome must be recorded wherever followup_test_ordered == 1"),
    ({"outcome": "1"}, "outcome == 1 requires followup_days <= 365"), ({"outcome": "2"}, "outcome must be one of [0, 1]"),
    ({"age": "54.5"}, "age must be an integer in [19, 110] (no missing)"), ({"age": ""}, "age must be an integer in [19, 110] (no missing)"),
    ({"age": "111"}, "age must be an integer in [19, 110] (no missing)"), ({"subject_id": "  "}, "subject_id must be a non-empty string"),
    ({"exercise_freq": "8"}, "exercise_freq must be one of [0, 1, 2, 3, 4, 5, 6, 7]"), ({"fh_cvd": "yes"}, "fh_cvd must be one of [0, 1]"),
    ({"followup_test_ordered": None}, "followup_test_ordered must be one of [0, 1] (no missing)"),
    ({"followup_days": "-1"}, "followup_days must be an integer in [0, None] (no missing)"), ({"public_model_score": "a"}, "public_model_score must be numeric"),
]


def test_each_rule(spark):
    got = {r["rule"]: r for r in ty.check(table(spark, [c for c, _ in BROKEN]), ty.screening(), "exam_id").collect()}
    for i, (_, rule) in enumerate(BROKEN):
        assert str(i) in got[rule]["first_ids"], rule
    # nothing else: an unreadable 2 as outcome of a decided row is one finding, not a missing one
    expected = {rule for _, rule in BROKEN}
    assert set(got) == expected
    assert got["sex must be one of ['F', 'M'] (no missing)"]["n"] == 2


def test_valid_table_and_types(spark):
    df = table(spark, [{"bmi": "", "outcome": "", "followup_test_ordered": "0"}, {"bmi": "nan"}][:1])
    assert ty.check(df, ty.screening(), "exam_id").count() == 0
    out = ty.require(df, ty.screening(), "exam_id")
    kinds = dict(out.dtypes)
    assert (kinds["age"], kinds["bmi"], kinds["exam_date"], kinds["outcome"], kinds["smoking_status"]) == ("bigint", "double", "date", "int", "double")
    assert out.filter("bmi IS NULL").count() == 1
    # typed input is as good as text
    assert ty.check(out.withColumn("age", F.col("age").cast("double")), ty.screening(), "exam_id").count() == 0


def test_missing_columns_then_empty_table(spark):
    df = table(spark, [{"sex": "X"}])
    r = ty.check(df.drop("centre_id", "ldl"), ty.screening(), "exam_id").collect()
    assert [(x["rule"], x["n"]) for x in r] == [("missing required columns: ['centre_id', 'ldl']", 2)]
    assert [x["rule"] for x in ty.check(df.filter("false"), ty.screening(), "exam_id").collect()] == ["no rows"]
    with pytest.raises(ValueError, match="sex must be one of"):
        ty.require(df, ty.screening(), "exam_id")
    assert ty.check(df.drop("public_model_score").filter("sex = 'F'"), ty.screening(), "exam_id").count() == 0


def test_contracts_are_checked_when_made():
    with pytest.raises(ValueError, match="unknown kind"):
        ty.Field("a", "colour")
    with pytest.raises(ValueError, match="allowed"):
        ty.Field("a", "choice")
