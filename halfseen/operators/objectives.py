"""Robust risks and regrets over a box, as weighted aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions import scalar as s
from halfseen.operators.lineage import cut
from halfseen.operators.scan import OrderedScan


def mean(value, weight=None) -> Column:
    value = s.as_col(value)
    if weight is None:
        return F.avg(value)
    w = s.as_col(weight)
    return F.sum(w * value) / F.sum(w)


def worst_case_risk(score="s", lo="lo", hi="hi", loss="logistic", weight=None) -> Column:
    return mean(s.worst_loss(score, lo, hi, loss), weight)


def risk_parts(score="s", lo="lo", hi="hi", loss="logistic", weight=None) -> tuple[Column, Column]:
    """Midpoint risk and censoring penalty; they add up to the worst-case risk."""
    mid = (s.as_col(lo) + s.as_col(hi)) * 0.5
    gap = (s.as_col(hi) - s.as_col(lo)) * s.loss_gap(score, loss)
    return mean(s.loss_at(score, mid, loss), weight), 0.5 * mean(gap, weight)


def minimax_regret(score="s", lo="lo", hi="hi", weight=None) -> Column:
    return mean(s.worst_regret(score, lo, hi), weight)


def abstention_rate(lo="lo", hi="hi", weight=None) -> Column:
    return mean(s.abstains(lo, hi).cast("double"), weight)


def tilt_choices(score, p1, e, gamma: float, points: int = 129, loss="logistic") -> Column:
    """Array over the tilt grid of (risk, |tilt|)."""
    top = math.log(gamma)
    one, zero = s.loss_pair(score, loss)

    def at(i: Column) -> Column:
        tau = -top + i * (2.0 * top / (points - 1))
        p = s.as_col(e) * s.as_col(p1) + (1.0 - s.as_col(e)) * s.tilt(p1, F.exp(tau))
        return F.struct((p * one + (1.0 - p) * zero).alias("r"), F.abs(tau).alias("a"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def dual_point(choices: Column, lam: Column) -> Column:
    """The first grid point maximising ``r - lam * a``: struct(r, a)."""
    def better(acc: Column, x: Column) -> Column:
        value = x["r"] - lam * x["a"]
        return F.when(value > acc["v"], F.struct(value.alias("v"), x["r"].alias("r"), x["a"].alias("a"))
                      ).otherwise(acc)
    start = F.struct(F.lit(float("-inf")).alias("v"), F.lit(0.0).alias("r"), F.lit(0.0).alias("a"))
    return F.aggregate(choices, start, better)


def budget_at(units: DataFrame, lams: Sequence[float], *, gamma: float, score="s", p1="p1", e="e",
              weight=None, loss="logistic", points: int = 129) -> DataFrame:
    """For each multiplier: risk and mean |tilt| of the pointwise best responses, one pass.

    Units are packed to distinct (score, p1, e) before they meet the multipliers.
    """
    w = F.lit(1.0) if weight is None else s.as_col(weight)
    packed = units.groupBy(s.as_col(score).alias("s"), s.as_col(p1).alias("p1"), s.as_col(e).alias("e")).agg(
        F.sum(w).alias("w"))
    rows = packed.select("w", tilt_choices("s", "p1", "e", gamma, points, loss).alias("__c"))
    rows = rows.withColumn("lam", F.explode(F.array(*[F.lit(float(v)) for v in lams])))
    rows = rows.select("lam", "w", dual_point(F.col("__c"), F.col("lam")).alias("__b"))
    return rows.groupBy("lam").agg((F.sum(F.col("w") * F.col("__b.r")) / F.sum("w")).alias("risk"),
                                   (F.sum(F.col("w") * F.col("__b.a")) / F.sum("w")).alias("tilt"))


def tilt_steps(units: DataFrame, *, gamma: float, score="s", p1="p1", e="e", weight=None, loss="logistic",
               points: int = 129) -> DataFrame:
    """Per distinct (score, p1, e): weight, risk and tilt at the least tilt, and the steps of its concave envelope.

    The envelope of (|tilt|, risk) over the grid is what any multiplier can choose from; a
    step goes from one of its corners to the next and pays ``slope`` risk per tilt. Slopes
    fall along a row and steps that pay nothing are left out.
    """
    w = F.lit(1.0) if weight is None else s.as_col(weight)
    packed = units.groupBy(s.as_col(score).alias("s"), s.as_col(p1).alias("p1"), s.as_col(e).alias("e")).agg(
        F.sum(w).alias("w"))
    risks = F.transform(tilt_choices("s", "p1", "e", gamma, points, loss), lambda x: x["r"])
    size = np.linspace(-math.log(gamma), math.log(gamma), points)[points // 2:]
    size[0] = max(size[0], 0.0)

    def envelopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            w, grid = batch["w"].to_numpy(), np.stack(batch["r"].to_numpy())
            best = np.maximum(grid[:, points // 2:], grid[:, ::-1][:, points // 2:])     # of both signs of a tilt
            at, rows, steps = np.zeros(len(w), int), np.arange(len(w)), [[] for _ in w]
            while len(rows):
                run = size[None, :] - size[at[rows]][:, None]
                rise = best[rows] - best[rows, at[rows]][:, None]
                slope = np.where(run > 0, rise / np.where(run > 0, run, 1.0), -np.inf)
                top = slope.max(axis=1)
                far = slope.shape[1] - 1 - np.argmax((slope == top[:, None])[:, ::-1], axis=1)
                rows, far, top, pick = (x[top > 0] for x in (rows, far, top, np.arange(len(rows))))
                for i, t, da, dr in zip(rows, top, run[pick, far] * w[rows], rise[pick, far] * w[rows]):
                    steps[i].append((t, da, dr))
                at[rows] = far
            yield pd.DataFrame({"w": w, "risk": w * best[:, 0], "tilt": w * size[0], "steps": [
                [dict(zip(("slope", "da", "dr"), x)) for x in row] for row in steps]})

    return packed.select("w", risks.alias("r")).mapInPandas(
        envelopes, "w double, risk double, tilt double, steps array<struct<slope: double, da: double, dr: double>>")


def budgeted_risks(units: DataFrame, budgets: Sequence[float], *, gamma: float, score="s", p1="p1", e="e",
                   weight=None, loss="logistic", points: int = 129) -> DataFrame:
    """Worst-case risk under each average-tilt budget: rows (budget, risk, lam, tilt), exact on the tilt grid.

    Steps of all units are bought in falling order of slope until the budget is spent, so
    the multiplier is the slope at which the running sum of tilt crosses it: one ordered
    scan, no search. The step that crosses is taken in part, which is the supremum.
    A budget that buys every step has multiplier 0. No units: no rows.
    """
    rows = cut(tilt_steps(units, gamma=gamma, score=score, p1=p1, e=e, weight=weight, loss=loss, points=points))
    total = rows.agg(F.sum("w").alias("w"), F.sum("risk").alias("risk0"), F.sum("tilt").alias("tilt0"),
                     F.sum(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["da"])).alias("all_a"),
                     F.sum(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["dr"])).alias("all_r"))
    asked = F.array(*[F.lit(float(b)) for b in budgets])
    total = total.filter("w IS NOT NULL").withColumn("budget", F.explode(asked))
    total = total.withColumn("room", F.greatest(F.col("budget") * F.col("w") - F.col("tilt0"), F.lit(0.0)))
    steps = rows.select(F.inline("steps")).groupBy("slope").agg(F.sum("da").alias("da"), F.sum("dr").alias("dr"))
    run = OrderedScan(steps, [], ["slope"], desc=True).add(a=("sum", F.col("da")), r=("sum", F.col("dr"))).result()
    crossing = run.join(F.broadcast(total.select(F.col("budget").alias("b"), "room")),
                        (F.col("a") > F.col("room")) & (F.col("a") - F.col("da") <= F.col("room")))
    crossing = crossing.select("b", "slope", (F.col("a") - F.col("da")).alias("a0"), (F.col("r") - F.col("dr")).alias("r0"))
    # rounding of the running sum could let a budget cross at two neighbouring steps
    crossing = crossing.groupBy("b").agg(F.max_by(F.struct("slope", "a0", "r0"), "slope").alias("x"))
    out = total.join(crossing, F.col("budget") == F.col("b"), "left")
    part = F.col("x.r0") + F.col("x.slope") * (F.col("room") - F.col("x.a0"))
    return out.select("budget", ((F.col("risk0") + F.coalesce(part, F.col("all_r"))) / F.col("w")).alias("risk"),
                      F.coalesce("x.slope", F.lit(0.0)).alias("lam"),
                      ((F.col("tilt0") + F.least("room", "all_a")) / F.col("w")).alias("tilt"))


def budgeted_risk(units: DataFrame, *, gamma: float, budget: float, score="s", p1="p1", e="e",
                  weight=None, loss="logistic", points: int = 129) -> tuple[float, float, float]:
    """``(risk, multiplier, mean |tilt|)`` of one budget; a budget of log(gamma) or more leaves the pointwise worst case."""
    log_g = math.log(gamma)
    if budget >= log_g - 1e-12:
        lo, hi = s.box(p1, e, gamma)
        return units.agg(worst_case_risk(score, lo, hi, loss, F.lit(1.0) if weight is None else s.as_col(weight))).collect()[0][0], 0.0, log_g
    row = budgeted_risks(units, [budget], gamma=gamma, score=score, p1=p1, e=e, weight=weight, loss=loss, points=points).collect()[0]
    return row["risk"], row["lam"], row["tilt"]
