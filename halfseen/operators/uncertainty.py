"""Entropy decompositions of ensemble predictions, with and without the box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions import scalar as s


def naive_parts(members="member_p") -> dict[str, Column]:
    """Total, aleatoric and epistemic entropy from an array of member probabilities."""
    p = s.as_col(members)
    size = F.size(p).cast("double")
    total = s.entropy(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / size)
    inner = F.aggregate(p, F.lit(0.0), lambda a, x: a + s.entropy(x)) / size
    return {"total": total, "aleatoric": inner, "epistemic": total - inner}


def credal_parts(members="member_p", lo="lo", hi="hi") -> dict[str, Column]:
    """Adds the part that more data cannot remove: censoring."""
    p = s.as_col(members)
    low, high = F.least(F.array_min(p), s.as_col(lo)), F.greatest(F.array_max(p), s.as_col(hi))
    inner, outer = s.entropy_range(low, high)
    c0, c1 = s.entropy_range(lo, hi)
    return {"total": outer, "aleatoric": inner, "epistemic": outer - inner, "censoring": c1 - c0,
            "sampling": F.greatest(outer - inner - (c1 - c0), F.lit(0.0))}


def summary(units: DataFrame, parts: dict[str, Column], weight=None) -> DataFrame:
    w = F.lit(1.0) if weight is None else s.as_col(weight)
    rows = units.select(w.alias("__w"), *[c.alias(n) for n, c in parts.items()])
    return rows.agg(*[(F.sum(F.col("__w") * F.col(n)) / F.sum("__w")).alias(n) for n in parts])


def aleatoric_interval(units: DataFrame, lo="lo", hi="hi", weight=None) -> DataFrame:
    a, b = s.entropy_range(lo, hi)
    return summary(units, {"lower": a, "upper": b}, weight)
