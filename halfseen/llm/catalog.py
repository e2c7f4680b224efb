"""Queries of this package; importing the modules registers them."""

from __future__ import annotations

from halfseen.llm import (  # noqa: F401
    decontaminate, exact_dedup, near_dedup, packing, pieces, repeats, secrets, sharding, simplex_clusters, toxicity, url_filter, warc, whitening,
)
from halfseen.llm.common import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    return QUERIES, ORACLES
