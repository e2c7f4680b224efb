"""Batches of sampled texts stay within a segment."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from halfseen.llm import repeats  # noqa: E402


def test_long_text_behind_short_ones(monkeypatch):
    sizes, plain = [], repeats.samples
    monkeypatch.setattr(repeats, "SEGMENT", 5_000)
    monkeypatch.setattr(repeats, "samples", lambda x, a, b: (sizes.append(len(x)), plain(x, a, b))[1])
    rng = random.Random(3)
    bodies = [bytes(rng.choices(range(97, 123), k=n)) for n in (300, 200, 4_900, 400, 150)]
    got = [np.concatenate(c) for c in zip(*repeats.sampled(bodies))]
    assert max(sizes) <= 5_000
    alone = [(k, *map(int, row)) for k, b in enumerate(bodies) for row in zip(*[c.tolist() for c in plain(
        np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))][1:])]
    assert [tuple(map(int, row)) for row in zip(*[c.tolist() for c in got])] == alone
