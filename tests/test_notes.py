"""Golden sentences of the note extraction."""

import pytest
from pyspark.sql import functions as F

from halfseen.functions import notes as patterns
from halfseen.operators import notes

# text, lvef, composite, valve component
GOLDEN = [
    ("TTE showed LVEF 30% with global hypokinesis.", 30.0, 1, None),
    ("Echo: EF 55-60%, no evidence of moderate or severe AS or MR.", 57.5, 0, False),
    ("Severe aortic stenosis was noted on echocardiogram; EF preserved.", None, 1, True),
    ("Echo: no LVH. Normal LVEF. Mild MR.", None, 0, False),
    ("Patient has a history of multiple sclerosis (MS); admitted for cellulitis.", None, None, None),
    ("IVSd 1.5 cm, LVPWd 1.4 cm, EF 60%.", 60.0, 1, None),
    ("Echo without significant mitral regurgitation, EF 65%.", 65.0, 0, False),
    ("", None, None, None),
    (None, None, None, None),
    ("Prior echo EF 60%. TTE now with ejection fraction of 25 to 30 %.", 27.5, 1, None),
    ("EF > 55 percent. 3+ MR and trace TR. Moderate-to-severe aortic regurgitation.", 55.0, 1, True),
    ("Echo with moderate concentric LVH; EF is mildly reduced.", None, 1, None),
    ("LVH by voltage criteria on ECG. EF 0.35.", 35.0, 1, None),
    ("EF: 12 mm. The septum measured 14 mm.", None, 1, None),
]


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, text string")
    return {r["id"]: r for r in notes.extract(df).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_sentence(records, i):
    r = records[i]
    assert (r["lvef"], r["shd_composite"], r["valve_moderate_or_severe"]) == GOLDEN[i][1:]


def test_details(records):
    assert (records[5]["wall_thickness_cm"], records[5]["septal_cm"], records[5]["posterior_cm"]) == (1.5, 1.5, 1.4)
    assert [(x["valve"], x["severity"], x["negated"]) for x in records[1]["lesions"]][0] == ("AS", "none", True)
    assert records[7]["confidence"] == 0.0 and records[7]["n_fields_found"] == 0
    assert records[3]["lvef_qualitative"] == "normal" and records[3]["lvh_negated"] is True
    assert [(x["valve"], x["severity"]) for x in records[10]["lesions"]] == [
        ("MR", "moderate_severe"), ("TR", "trace"), ("AR", "moderate_severe")]


def test_parse_and_merge(spark):
    rows = [(1, 'Answer: {"lvef": "0.4", "wall_thickness_cm": 14, "valve_lesions": [{"valve": "mr", '
                '"severity": "Moderate-Severe"}, {"valve": "XX", "severity": "mild"}, {"valve": "TR"}]} done'),
            (2, "no json"), (3, '{"lvef": 95, "lvef_qualitative": "hyperdynamic"}'), (4, '{"lvef": ')]
    got = notes.parse_answer(spark.createDataFrame(rows, "id int, answer string"), "answer")
    r = {x["id"]: x for x in got.collect()}
    assert (r[1]["lvef"], r[1]["wall_thickness_cm"], r[1]["shd_composite"], r[1]["n_fields_found"]) == (40.0, 1.4, 1, 3)
    assert [(x["valve"], x["severity"], x["negated"]) for x in r[1]["lesions"]] == [
        ("MR", "moderate_severe", False), ("TR", "none", True)]
    assert [r[i]["parse_error"] for i in (1, 2, 3, 4)] == [0, 1, 0, 1]
    assert (r[3]["lvef"], r[3]["shd_composite"]) == (None, 0)
    first = notes.extract(spark.createDataFrame([(1, "EF 60%."), (2, "EF 60%."), (3, "Echo: EF 30%.")],
                                                "id int, text string"))
    m = {x["id"]: x for x in notes.merge(first, got, "id").collect()}
    assert (m[1]["lvef"], m[1]["shd_composite"]) == (40.0, 1)
    assert (m[2]["lvef"], m[2]["shd_composite"]) == (60.0, 0)
    assert (m[3]["lvef"], m[3]["lvef_qualitative"], m[3]["shd_composite"]) == (30.0, "hyperdynamic", 1)
    back = {x["id"]: x["lvef"] for x in notes.merge(first, got, "id", "first_overrides").collect()}
    assert back == {1: 60.0, 2: 60.0, 3: 30.0}


def test_locate_many_matches(spark):
    """Positions of every match, also over several chunks, and time that grows far slower than the square of their number."""
    import re
    import time
    rows = ["", "none", "ent", "x" * 7 + "ent ent" + "é" * 3, "ab ent " * 500, "entent" * 700]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    for r in df.select("k", patterns.locate(F.col("t"), "ent").alias("m")).collect():
        assert [(m["pos"], m["stop"], m["hit"]) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("ent", rows[r["k"]])]
    took = []
    for n in (10_000, 40_000):
        one = spark.createDataFrame([("ab ent " * n,)], "t string")
        start = time.time()
        assert one.select(F.size(patterns.locate(F.col("t"), "ent"))).first()[0] == n
        took.append(time.time() - start)
    assert took[1] < 12 * took[0] + 2
