"""A caller's extractor: once per distinct text, set up once per worker, failures stay with their note."""

import os

import pytest

from halfseen.operators import notes as no


def make(folder):
    def setup():
        open(os.path.join(folder, f"setup-{os.urandom(6).hex()}"), "w").close()

        def read(text):
            open(os.path.join(folder, f"call-{os.urandom(6).hex()}"), "w").close()
            if "boom" in text:
                raise KeyError("boom")
            if "stammer" in text:
                return "hm, not sure"
            return {"lvef": 30} if "dict" in text else 'Here: {"lvef": 0.55, "wall_thickness_cm": 14}'
        return read
    return setup


ROWS = [(1, "dict"), (2, "text"), (3, "boom"), (4, "stammer"), (5, None), (6, "  "), *[(i, "dict") for i in range(10, 60)]]


def test_records_calls_and_failures(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, text string").repartition(8)
    out = no.extract_with(df, "text", make(str(tmp_path)), name="m")
    for _ in range(2):                                   # asking twice runs the extractor once
        got = {r["id"]: r for r in out.collect()}
    calls = [f for f in os.listdir(tmp_path) if f.startswith("call")]
    setups = [f for f in os.listdir(tmp_path) if f.startswith("setup")]
    assert len(calls) == 4 and 1 <= len(setups) <= 8
    assert len(got) == len(ROWS)
    assert all(got[i]["lvef"] == 30.0 and got[i]["lvef_le_45"] for i in [1, *range(10, 60)])
    assert got[2]["lvef"] == pytest.approx(55.0) and got[2]["wall_thickness_cm"] == pytest.approx(1.4)
    assert [(got[i]["extractor"], got[i]["parse_error"]) for i in range(1, 7)] == [
        ("m", 0), ("m", 0), ("m:error", 1), ("m:parse_error", 1), ("m", 0), ("m", 0)]
    assert "boom" in got[3]["failure"] and got[5]["lvef"] is None
    assert no.extract_with(df.limit(0), "text", make(str(tmp_path))).count() == 0


def test_merge_keeps_first_where_the_caller_failed(spark, tmp_path):
    rows = [(1, "EF 60%. boom"), (2, "EF 60%. dict"), (3, "EF 60%. stammer"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    second = no.extract_with(df, "text", make(str(tmp_path)), template="Read this: {text}")
    for policy, want in (("second_overrides", {1: 60.0, 2: 30.0, 3: 60.0, 4: None}), ("first_overrides", {1: 60.0, 2: 60.0, 3: 60.0, 4: None})):
        got = {r["id"]: r["lvef"] for r in no.merge(no.extract(df), second, "id", policy).collect()}
        assert got == want
