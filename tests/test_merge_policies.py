"""Both merge policies of note records, every field, against a plain rule per row."""

import itertools
import json

import pytest

from halfseen.operators import notes as no

PARTS = [{}, {"lvef": 40, "wall_thickness_cm": 1.4}, {"lvef": 60, "valve_lesions": [{"valve": "mr", "severity": "severe"}]},
         {"wall_thickness_cm": 0.9, "valve_lesions": [{"valve": "as", "severity": "mild"}]}, None]


@pytest.mark.parametrize("policy", ["second_overrides", "first_overrides"])
def test_merge_of_all_fields(spark, policy):
    pairs = list(itertools.product(range(len(PARTS)), repeat=2))
    say = lambda p: "unreadable" if PARTS[p] is None else json.dumps(PARTS[p])
    read = lambda side: no.parse_answer(spark.createDataFrame(
        [(i, say(p[side])) for i, p in enumerate(pairs)], "note_id long, answer string"), "answer")
    first, second = read(0), read(1).filter("note_id % 7 <> 3")              # some notes have no second record
    a = {r["note_id"]: r.asDict(True) for r in first.collect()}
    b = {r["note_id"]: r.asDict(True) for r in second.collect()}
    got = no.merge(first, second, "note_id", policy).collect()
    assert sorted(r["note_id"] for r in got) == list(range(len(pairs)))
    for r in got:
        r = r.asDict(True)
        one, two = a[r["note_id"]], b.get(r["note_id"])
        two = None if two is None or two["parse_error"] else two
        order = [x for x in ((two, one) if policy == "second_overrides" else (one, two)) if x is not None]
        for c in no.RECORD_FIELDS:
            assert r[c] == next((x[c] for x in order if x[c] is not None), None), (r["note_id"], c)
        keep = next((x["lesions"] for x in order if x["lesions"]), one["lesions"])
        valves = lambda x: [(v["valve"], v["severity"]) for v in x or []]
        assert valves(r["lesions"]) == valves(keep)
        assert r["confidence"] == max((x["confidence"] for x in order if x["confidence"] is not None), default=None)


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        no.merge(spark.range(1), spark.range(1), "id", "both")
