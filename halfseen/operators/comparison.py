"""Method comparison: learners and plug-in acts side by side on held-out units, one row per method.

Learners see one side of a split, the table is computed on the other.  Every score is an
entry of one array column, units with equal entries are packed, and each group of metrics
is one keyed scan over (entry, score); methods are never a loop over the units.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions import scalar as s
from halfseen.operators import boosting as bo
from halfseen.operators import evaluation as ev
from halfseen.operators import learners as ln
from halfseen.operators import nuisance as nu
from halfseen.operators.lineage import cut

GAMMAS = (1.0, 1.5, 2.0, 3.0, 5.0)
EDGE = 1e-6               # probabilities of classifiers stay this far from 0 and 1 before the logit
SQUARED_EDGE = 1e-4       # values of regressions


@dataclass(frozen=True)
class Method:
    """A scored method: a column over units that hold the features, ``e`` and ``p1``."""

    name: str
    score: Column
    gamma: float | None = None
    criterion: str | None = None


def plug_in_methods(gammas: Sequence[float] = GAMMAS, *, e="e", p1="p1", direction: str = "two-sided",
                    no_assumption: bool = True) -> list[Method]:
    """Closed-form acts on the box of each Γ for both criteria, and the risk act without an assumption (Γ = inf)."""
    made = []
    for g in gammas:
        lo, hi = s.box(p1, e, g, direction)
        made += [Method("plug_in", s.bayes_score(lo, hi, c), float(g), c) for c in ("risk", "regret")]
    if no_assumption:
        lo, hi = s.box(p1, e, float("inf"))
        made.append(Method("no_assumption", s.bayes_score(lo, hi), float("inf"), "risk"))
    return made


def learned_methods(train: DataFrame, features: Sequence[str], *, t="t", y_obs="y_obs", y: str | None = None,
                    floor: float = 0.02, rounds: int | None = None) -> list[Method]:
    """Boosted learners on ``train`` (with ``e`` and ``p1``): ERM, IPW, oracle (given full labels ``y``), AIPW and imputation.

    The classifiers are targets of one table and grown together, the regressions likewise.
    """
    e, p1 = F.col("e"), F.col("p1")
    chosen, seen = F.col(t) == 1, F.col(y_obs).cast("double")
    targets = {"erm": (F.when(chosen, seen), F.lit(1.0)), "ipw": (F.when(chosen, seen), nu.ipw_weight(e, floor))}
    if y is not None:
        targets["oracle"] = (F.col(y).cast("double"), F.lit(1.0))
    pseudo = {"aipw": (nu.aipw_target(t, y_obs, e, p1, floor), F.lit(1.0)),
              "imputation": (nu.imputation_target(t, y_obs, p1), F.lit(1.0))}
    made = []
    for group, loss, edge in ((targets, "logistic", EDGE), (pseudo, "squared", SQUARED_EDGE)):
        fields = [F.struct(F.lit(i).alias("target"), F.lit(0).alias("fold"), F.lit(0).alias("inner"), label.alias("y"), w.alias("w"))
                  for i, (label, w) in enumerate(group.values())]
        rows = train.select(*features, F.inline(F.array(*fields)))
        settings = bo.Settings(loss=loss, rounds=ln.ROUNDS["gbm"] if rounds is None else rounds)
        fitted = bo.boost(rows, features, [(i, -1, -1) for i in range(len(group))], settings=settings)[0].column()
        made += [Method(n, s.logit(s.clip(fitted[i], edge, 1.0 - edge))) for i, n in enumerate(group)]
    return made


def linear_methods(train: DataFrame, features: Sequence[str], *, gamma: float = 2.0, direction: str = "two-sided") -> list[Method]:
    """Linear scores fitted to the box of ``train`` at ``gamma``: midpoint and worst-case logistic. Standardise the features first."""
    lo, hi = s.box("p1", "e", gamma, direction)
    boxed = train.withColumns({"__lo": lo, "__hi": hi})
    mid = ln.midpoint_scorer(boxed, features, "__lo", "__hi")
    worst, _, _ = ln.worst_case_linear(boxed, features, lo="__lo", hi="__hi")
    return [Method("midpoint_linear", ln.linear([0.0, *mid], features), gamma),
            Method("worst_case_linear", ln.linear(worst, features), gamma)]


def method_table(units: DataFrame, methods: Sequence[Method], *, t="t", y_obs="y_obs", y: str | None = None, gamma_report: float = 2.0,
                 direction: str = "two-sided", digits: int = 12) -> DataFrame:
    """One row per method: metrics on full labels (null without ``y``), on observed labels, and over the box at ``gamma_report``.

    ``abstention_rate`` is the share of scores equal to 0, given for acts only.  Scores are
    rounded to ``digits`` so that values equal but for rounding are ties.  Units without a
    full label leave the full metrics alone, units without ``e`` or ``p1`` fail in the box.
    """
    if not methods:
        raise ValueError("no methods to compare")
    label = F.lit(None).cast("double") if y is None else F.col(y).cast("double")
    scores = F.array(*[F.round(m.score, digits) for m in methods])
    scored = units.select(F.col(t).alias("t"), F.col(y_obs).cast("double").alias("y_obs"), label.alias("y"), "e", "p1", scores.alias("scores"))
    packed = cut(scored.groupBy("scores", "t", "y_obs", "y", "e", "p1").agg(F.count(F.lit(1)).cast("double").alias("w")))
    lo, hi = s.box("p1", "e", gamma_report, direction)
    long = packed.select("t", "y_obs", "y", "w", lo.alias("lo"), hi.alias("hi"), F.posexplode("scores").alias("entry", "s"))
    named = F.array(*[F.struct(F.lit(m.name).alias("method"), F.lit(m.gamma).cast("double").alias("gamma"),
                               F.lit(m.criterion).cast("string").alias("criterion")) for m in methods])
    bounds = ev.bounds_report(long, keys=["entry"], weight="w").drop("abstention_rate")
    zero = long.groupBy("entry").agg((F.sum(F.when(F.col("s") == 0, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("zero"))
    out = bounds.join(zero, "entry")
    parts: list[Callable[[], DataFrame]] = [lambda: ev.observed_metrics(long.filter("y_obs IS NOT NULL"), "s", "t", "y_obs", keys=["entry"], weight="w")]
    if y is not None:
        parts.append(lambda: ev.deployment_metrics(long.filter("y IS NOT NULL"), "s", "y", keys=["entry"], weight="w"))
    for part in parts:
        out = out.join(part(), "entry", "left")
    full = ["risk", "auroc", "accuracy", "balanced_accuracy", "brier"]
    out = out.withColumn("__m", named[F.col("entry")])
    return out.select("__m.*", *[F.col(c) if y is not None else F.lit(None).cast("double").alias(c) for c in full], *[f"obs_{c}" for c in full],
                      "auroc_lo", "auroc_hi", "auroc_width", "worstcase_risk", "minimax_regret",
                      F.when(F.col("__m.criterion").isNotNull(), F.col("zero")).alias("abstention_rate"))


def compare(units: DataFrame, features: Sequence[str], *, ident: str, side: str, t="t", y_obs="y_obs", y: str | None = None,
            gammas: Sequence[float] = GAMMAS, gamma_report: float = 2.0, direction: str = "two-sided", model: str = "gbm",
            folds: int = 5, calibrate: bool = True, linear: bool = True, rounds: int | None = None, seed: int = 0) -> DataFrame:
    """The whole comparison: cross-fitted nuisances and learners on ``side`` = 'train', the method table on 'test'."""
    train, test = (units.filter(F.col(side) == v) for v in ("train", "test"))
    cf = ln.CrossFit(features, ident=ident, model=model, folds=folds, calibrate=calibrate, seed=seed, rounds=rounds)
    train = cut(cf.fit_predict(train, t, y_obs))
    test = cf.predict(test)
    methods = learned_methods(train, features, t=t, y_obs=y_obs, y=y, rounds=rounds)
    if linear:
        methods += linear_methods(train, features, gamma=gamma_report, direction=direction)
    methods += plug_in_methods(gammas, direction=direction)
    return method_table(test, methods, t=t, y_obs=y_obs, y=y, gamma_report=gamma_report, direction=direction)
