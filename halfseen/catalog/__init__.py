"""Every registered query, one per operator of the inventory."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    from halfseen.catalog import base, model_queries, rank_queries, table_queries, text_queries  # noqa: F401
    return base.QUERIES, base.ORACLES
