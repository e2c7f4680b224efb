"""Equi-joins that keep rows whose key is null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-null keys; the right side's key columns are dropped.

    The condition is a conjunction of ``<=>``, which Spark still plans as an equi-join.
    """
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"__r_{c}" for c in on])
