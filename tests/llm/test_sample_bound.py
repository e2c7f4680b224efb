"""The labelled sample goes on behind long texts and holds one text of an id."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from halfseen.llm import toxicity  # noqa: E402


def test_sample_skips_long_texts_and_repeated_ids(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "id long, label int")
    for long in (150, 90):      # longer than the room, and than what is left of it
        for first in range(20):
            docs = spark.createDataFrame([(k, ("x" * long) if k == first else f"t{k:02d}") for k in range(20)] + [(3, "t")] * 30, "id long, body string")
            if first in (0, 7):
                got = toxicity.labelled_sample(docs, labels, 100, 100)
                assert sum(len(t) for t, _ in got) <= 100 and len(got) >= 4
                assert long == 90 or len(got) == 19
