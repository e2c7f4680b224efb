"""Rank metrics and their sharp intervals over an identified box.

Everything starts from one table with a row per distinct score: weights and
weighted sums are combined map-side before the only large shuffle, then an
ordered scan turns them into mid-ranks and a piecewise-linear profile.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions.scalar import EPS, as_col, clip
from halfseen.operators.cell_join import match_cells
from halfseen.operators.scan import OrderedScan, block_rows

MARGIN = 1e-6
SHARE = "share"          # coefficient filled with the weight share of phi <> 0


@dataclass(frozen=True)
class Metric:
    """``(<p, phi> + c0 + c1 pi + c2 pi^2) / (d0 + d1 pi + d2 pi^2)``.

    ``phi`` maps the score column to a column; ``None`` means the mid-rank.
    A coefficient is a number or ``SHARE``.
    """

    name: str
    phi: object = None
    c: tuple = (0.0, 0.0, 0.0)
    d: tuple = (0.0, 0.0, 0.0)


AUROC = Metric("AUROC", None, (0.0, 0.0, -0.5), (0.0, 1.0, -1.0))


def tpr_at(tau: float) -> Metric:
    return Metric(f"TPR@{tau:g}", lambda s: (s > tau).cast("double"), d=(0.0, 1.0, 0.0))


def tnr_at(tau: float) -> Metric:
    return Metric(f"TNR@{tau:g}", lambda s: -(s <= tau).cast("double"), c=(SHARE, 0.0, 0.0),
                  d=(1.0, -1.0, 0.0))


def ppv_at(tau: float) -> Metric:
    return Metric(f"PPV@{tau:g}", lambda s: (s > tau).cast("double"), d=(SHARE, 0.0, 0.0))


def _weight(weight) -> Column:
    if weight is None:
        return F.lit(1.0)
    w = as_col(weight).cast("double")
    return F.when(w < 0, F.raise_error(F.lit("weights must be non-negative"))).otherwise(w)


def _few_values(units: DataFrame, score: str) -> bool:
    """Is the number of distinct scores below one block?

    The row count bounds it (and comes from file footers when ``units`` is a bare
    scan); only a larger table needs a pass over its score column.
    """
    if units.select(score).count() <= block_rows(units):
        return True
    distinct = units.agg(F.approx_count_distinct(score).alias("n")).collect()[0]["n"]
    return distinct * 1.25 < block_rows(units)


def rank_table(units: DataFrame, score: str, sums: Mapping[str, object], *, weight=None,
               keys: Sequence[str] = (), phi=None, scores: DataFrame | None = None) -> DataFrame:
    """One row per (keys, score): weight share ``w``, weighted means of ``sums``
    (shares of the key total) and ``phi``.

    ``scores`` is an optional cheaper table with the same score column, used only
    to measure how many distinct values there are.
    """
    w = _weight(weight)
    value = "__phi" if phi is not None else score
    if phi is not None:
        units = units.withColumn("__phi", phi(F.col(score)))
    grouped = units.groupBy(*keys, value).agg(
        F.sum(w).alias("w"), *[F.sum(w * as_col(c)).alias(n) for n, c in sums.items()])
    small = phi is not None or _few_values(scores if scores is not None else units, score)
    # the raw score column is the cheaper table to take split points from
    raw = scores is not None and phi is None and set(keys) <= set(scores.columns)
    scan = OrderedScan(grouped, keys, [value], measured_small=small, measure=scores if raw else None)
    scan.add(__tot=("total", F.col("w")), __cum=("sum", F.col("w")))
    total = F.when(F.col("__tot") > 0, F.col("__tot")).otherwise(
        F.raise_error(F.lit("weights must sum to a positive number")))
    rank = F.col("__phi") if phi is not None else (F.col("__cum") - 0.5 * F.col("w")) / total
    scan.df = scan.df.withColumns({"phi": rank, "weight_total": total})
    scan.df = scan.df.withColumns({n: F.col(n) / F.col("weight_total") for n in ["w", *sums]})
    scan.df = scan.df.drop("__tot", "__cum")
    return scan


def midrank(units: DataFrame, score: str, *, weight=None, keys: Sequence[str] = (),
            name: str = "midrank") -> DataFrame:
    """Every unit with its weighted mid-rank; ties share it."""
    table = rank_table(units, score, {}, weight=weight, keys=keys).result()
    return match_cells(units, table.select(*keys, score, F.col("phi").alias(name)), [*keys, score])


def auc(units: DataFrame, score: str, probs: Mapping[str, object], *, weight=None,
        keys: Sequence[str] = (), scores: DataFrame | None = None) -> DataFrame:
    """AUROC of ``score`` under each probability (or 0/1 label) column, per key."""
    table = rank_table(units, score, probs, weight=weight, keys=keys, scores=scores).result()
    out = []
    for name in probs:
        pi, num = F.sum(name), F.sum(F.col(name) * F.col("phi"))
        out.append(F.when((pi > EPS) & (pi < 1.0 - EPS),
                          (num - 0.5 * pi * pi) / (pi * (1.0 - pi))).alias(name))
    return table.groupBy(*keys).agg(*out)


def segments(units: DataFrame, score: str, lo="lo", hi="hi", *, metric: Metric = AUROC,
             weight=None, keys: Sequence[str] = (), scores: DataFrame | None = None) -> DataFrame:
    """Both knapsack profiles, one row per (keys, score).

    ``a_*``/``b_*`` are the prevalence ends of the segment in the filling order of
    that side, ``alpha_* + phi * pi`` is the profile on it.
    """
    lo_c, hi_c = as_col(lo), as_col(hi)
    lo_c = F.when(lo_c > hi_c + 1e-9, F.raise_error(F.lit("lo must be <= hi"))).otherwise(lo_c)
    scan = rank_table(units, score, {"base": lo_c, "top": hi_c}, weight=weight, keys=keys,
                      phi=metric.phi, scores=scores)
    scan.df = scan.df.selectExpr("*", "top - base AS cap", "(top - base) * phi AS gain", "base * phi AS floor_gain",
                                 "IF(phi <> 0, w, 0D) AS counted")
    scan.add(cap_sum=("sum", F.col("cap")), gain_sum=("sum", F.col("gain")), cap_all=("total", F.col("cap")),
             gain_all=("total", F.col("gain")), pi_min=("total", F.col("base")),
             v_min=("total", F.col("floor_gain")), share=("total", F.col("counted")))
    value = "__phi" if metric.phi is not None else score
    ends = scan.result().selectExpr(
        *keys, value, "phi", "cap", "share", "pi_min", "pi_min + cap_all AS pi_max", "gain",
        "pi_min + cap_sum - cap AS a_low", "pi_min + cap_all - cap_sum AS a_up",
        "v_min + gain_sum AS v_low", "v_min + gain_all - gain_sum AS v_up")
    return ends.selectExpr(
        *keys, value, "phi", "cap", "share", "pi_min", "pi_max", "a_low", "a_up",
        "a_low + cap AS b_low", "a_up + cap AS b_up",
        "v_low - gain - phi * a_low AS alpha_low", "v_up - phi * a_up AS alpha_up")


def _coefficients(metric: Metric) -> tuple[list[Column], list[Column]]:
    fill = lambda xs: [F.col("share") if x == SHARE else F.lit(float(x)) for x in xs]
    return fill(metric.c), fill(metric.d)


def _extremes(seg: DataFrame, metric: Metric, keys: Sequence[str]) -> DataFrame:
    """Best (value, prevalence) on every segment for both sides: ``low``, ``up``.

    A chain of small projections, so that no expression is repeated in the generated
    code.  The derivative of a ratio of quadratics vanishes where
    ``qa pi^2 + qb pi + qc = 0``.
    """
    text = lambda xs: ["share" if x == SHARE else f"{float(x)!r}D" for x in xs]
    (c0, c1, c2), (d0, d1, d2) = text(metric.c), text(metric.d)
    base = seg.selectExpr("*", f"greatest(pi_min, {MARGIN!r}D) AS first", f"least(pi_max, {1.0 - MARGIN!r}D) AS last",
                          f"least(greatest((pi_min + pi_max) * 0.5D, {MARGIN!r}D), {1.0 - MARGIN!r}D) AS point")
    both = base.selectExpr(
        *keys, f"phi + {c1} AS n1", f"{c2} AS n2", f"{d0} AS d0", f"{d1} AS d1", f"{d2} AS d2",
        "IF(last < first, point, first) AS first", "IF(last < first, point, last) AS last",
        f"inline(array(struct('low' AS side, a_low AS a, b_low AS b, alpha_low + {c0} AS n0),"
        f" struct('up' AS side, a_up AS a, b_up AS b, alpha_up + {c0} AS n0)))")
    # ends that differ by rounding only still carry one point
    both = both.selectExpr(*keys, "side", "n0", "n1", "n2", "d0", "d1", "d2", "greatest(a, first) AS s", "least(b, last) AS t",
                           "n2 * d1 - n1 * d2 AS qa", "2D * (n2 * d0 - n0 * d2) AS qb", "n1 * d0 - n0 * d1 AS qc"
                           ).filter("t >= s - 1e-15D")
    both = both.selectExpr("*", "qb * qb - 4D * qa * qc AS disc")
    both = both.selectExpr(
        *keys, "side", "n0", "n1", "n2", "d0", "d1", "d2", "s", "t",
        "CASE WHEN abs(qa) >= 1e-14D AND disc >= 0 THEN (sqrt(disc) - qb) / (2D * qa)"
        " WHEN abs(qa) < 1e-14D AND abs(qb) >= 1e-14D THEN -qc / qb END AS r1",
        "CASE WHEN abs(qa) >= 1e-14D AND disc >= 0 THEN -(sqrt(disc) + qb) / (2D * qa) END AS r2")
    tries = both.selectExpr(*keys, "side", "n0", "n1", "n2", "d0", "d1", "d2",
                            "explode(array(s, t, IF(r1 > s AND r1 < t, r1, NULL), IF(r2 > s AND r2 < t, r2, NULL))) AS pi"
                            ).filter("pi IS NOT NULL")
    tries = tries.selectExpr(*keys, "side", "pi", "n0 + pi * (n1 + pi * n2) AS num", "d0 + pi * (d1 + pi * d2) AS den")
    return tries.filter("abs(den) > 1e-14D").selectExpr(*keys, "side", "num / den AS value", "pi")


def sharp_interval(units: DataFrame, score: str, lo="lo", hi="hi", *, metric: Metric = AUROC,
                   weight=None, keys: Sequence[str] = (), scores: DataFrame | None = None,
                   profile: DataFrame | None = None) -> DataFrame:
    """Exact sharp interval of ``metric`` over the box: one row per key."""
    seg = profile if profile is not None else segments(
        units, score, lo, hi, metric=metric, weight=weight, keys=keys, scores=scores)
    tries = _extremes(seg, metric, keys)
    one = tries.groupBy(*keys).agg(
        F.expr("min(value) FILTER (WHERE side = 'low') AS lower"), F.expr("max(value) FILTER (WHERE side = 'up') AS upper"),
        F.expr("min_by(pi, value) FILTER (WHERE side = 'low') AS pi_lower"),
        F.expr("max_by(pi, value) FILTER (WHERE side = 'up') AS pi_upper"))
    return one.selectExpr(*keys, "lower", "upper", "pi_lower", "pi_upper", "upper - lower AS width")


def least_favourable(units: DataFrame, score: str, lo="lo", hi="hi", *, metric: Metric = AUROC,
                     weight=None, keys: Sequence[str] = (), scores: DataFrame | None = None) -> DataFrame:
    """Units with ``p_lower``/``p_upper``: members of the box attaining the bounds.

    Within the score group cut by the arg-prevalence every unit gets the same
    share of its gap, which leaves the metric unchanged.
    """
    value = "__phi" if metric.phi is not None else score
    seg = segments(units, score, lo, hi, metric=metric, weight=weight, keys=keys, scores=scores)
    bound = sharp_interval(units, score, lo, hi, metric=metric, keys=keys, profile=seg)
    join_on = list(keys)
    if not join_on:
        seg, bound, join_on = seg.withColumn("__one", F.lit(1)), bound.withColumn("__one", F.lit(1)), ["__one"]
    filled = seg.join(bound.select(*join_on, "pi_lower", "pi_upper"), join_on)

    def share(side: str, pi: str) -> Column:
        budget = F.col(pi) - F.col(f"a_{side}")
        return F.when(F.col("cap") > 0, clip(budget / F.col("cap"), 0.0, 1.0)).otherwise(0.0)

    filled = filled.select(*keys, value, share("low", "pi_lower").alias("__fl"),
                           share("up", "pi_upper").alias("__fu"))
    if metric.phi is not None:
        units = units.withColumn("__phi", metric.phi(F.col(score)))
    gap = as_col(hi) - as_col(lo)
    return (match_cells(units, filled, [*keys, value])
            .withColumns({"p_lower": as_col(lo) + F.col("__fl") * gap,
                          "p_upper": as_col(lo) + F.col("__fu") * gap})
            .drop("__fl", "__fu", "__phi"))


def corner_interval(units: DataFrame, score: str, lo="lo", hi="hi", *, weight=None,
                    keys: Sequence[str] = ()) -> DataFrame:
    """AUROC at the box corners and midpoint.  NOT a valid interval; a comparator."""
    mid = (as_col(lo) + as_col(hi)) * 0.5
    at = auc(units, score, {"at_lo": lo, "at_hi": hi, "at_mid": mid}, weight=weight, keys=keys)
    cols = ["at_lo", "at_hi", "at_mid"]
    return at.select(*keys, F.least(*cols).alias("lower"), F.greatest(*cols).alias("upper"))


def separate_interval(units: DataFrame, score: str, lo="lo", hi="hi", *, weight=None,
                      keys: Sequence[str] = (), points: int = 2001) -> DataFrame:
    """Valid but loose: numerator and denominator bounded independently on a grid."""
    table = rank_table(units, score, {"base": lo, "top": hi}, weight=weight, keys=keys).result()
    tot = table.groupBy(*keys).agg(
        F.sum("base").alias("p_lo"), F.sum("top").alias("p_hi"),
        F.sum(F.col("base") * F.col("phi")).alias("n_lo"),
        F.sum(F.col("top") * F.col("phi")).alias("n_hi"))
    first = F.greatest(F.col("p_lo"), F.lit(MARGIN))
    last = F.least(F.col("p_hi"), F.lit(1.0 - MARGIN))
    point = clip((first + last) * 0.5, MARGIN, 1.0 - MARGIN)
    grid = tot.withColumns({"__a": F.when(last < first, point).otherwise(first),
                            "__b": F.when(last < first, point).otherwise(last)})
    grid = grid.withColumn("pi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    pi = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("pi") / float(points - 1)
    den = pi * (1.0 - pi)
    return grid.groupBy(*keys).agg(
        F.greatest(F.min((F.col("n_lo") - 0.5 * pi * pi) / den), F.lit(0.0)).alias("lower"),
        F.least(F.max((F.col("n_hi") - 0.5 * pi * pi) / den), F.lit(1.0)).alias("upper"))


def metric_value(units: DataFrame, score: str, p, *, metric: Metric = AUROC, weight=None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """The metric at one member ``p`` of the box."""
    table = rank_table(units, score, {"p": p}, weight=weight, keys=keys, phi=metric.phi).result()
    c, d = _coefficients(metric)
    tot = table.groupBy(*keys).agg(
        F.sum("p").alias("pi"), F.sum(F.col("p") * F.col("phi")).alias("num"),
        F.sum(F.when(F.col("phi") != 0, F.col("w")).otherwise(0.0)).alias("share"))
    pi = F.col("pi")
    den = d[0] + d[1] * pi + d[2] * pi * pi
    return tot.select(*keys, F.when(F.abs(den) > EPS,
                                    (F.col("num") + c[0] + c[1] * pi + c[2] * pi * pi) / den).alias("value"))
