"""Models: cross-fitted nuisances, comparison learners, robust linear scorers; boosting is our own, the rest MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions import scalar as s
from halfseen.functions.hashing import poisson1, unit_interval
from halfseen.operators import boosting as bo
from halfseen.operators import nuisance as nu
from halfseen.operators import ranking as rk
from halfseen.operators.lineage import cut, spread
from halfseen.operators.validate import gram, hash_position, stratified_folds

Predictor = Callable[[DataFrame, str], DataFrame]
ROUNDS = {"gbm": 200, "mlp": 600}        # boosting rounds and epochs unless asked otherwise


class BoostedModel:
    """One boosted model; ``column`` is its probability, or its value under squared loss."""

    def __init__(self, fitted: bo.Boosted):
        self.fitted = fitted

    def column(self) -> Column:
        return self.fitted.column()[0]


class BoostedLearner:
    """Histogram boosting over named columns, to be fitted like a pipeline."""

    def __init__(self, features: Sequence[str], label: str, weight: str | None, settings: bo.Settings):
        self.features, self.label, self.weight, self.settings = list(features), label, weight, settings

    def fit(self, df: DataFrame) -> BoostedModel:
        w = F.lit(1.0) if self.weight is None else F.col(self.weight)
        rows = df.select(*self.features, F.lit(0).alias("target"), F.lit(0).alias("fold"), F.lit(0).alias("inner"), F.col(self.label).alias("y"), w.alias("w"))
        return BoostedModel(bo.boost(rows, self.features, [(0, -1, -1)], settings=self.settings)[0])


def base_learner(model: str, features: Sequence[str], label: str, *, weight: str | None = None, seed: int = 0,
                 rounds: int | None = None) -> Pipeline | BoostedLearner:
    """'gbm' (histogram boosting), 'logistic' (standardised) or 'mlp' over named columns, with ``fit``."""
    rounds = ROUNDS.get(model) if rounds is None else rounds
    parts = [VectorAssembler(inputCols=list(features), outputCol="__raw")]
    extra = {"weightCol": weight} if weight else {}
    if model == "gbm":
        return BoostedLearner(features, label, weight, bo.Settings(rounds=rounds))
    if model == "logistic":
        parts += [StandardScaler(inputCol="__raw", outputCol="__std", withMean=True, withStd=True),
                  LogisticRegression(featuresCol="__std", labelCol=label, maxIter=100, regParam=1e-6, standardization=False, **extra)]
    elif model == "mlp":
        parts += [StandardScaler(inputCol="__raw", outputCol="__std", withMean=True, withStd=True),
                  MultilayerPerceptronClassifier(featuresCol="__std", labelCol=label, layers=[len(features), 64, 32, 2],
                                                 maxIter=rounds, tol=1e-4, seed=seed)]
    else:
        raise KeyError(f"unknown nuisance model {model!r}")
    return Pipeline(stages=parts)


def probability(model: PipelineModel | BoostedModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` plus the probability of class 1."""
    if isinstance(model, BoostedModel):
        return df.withColumn(name, model.column())
    made = [c for st in model.stages for c in (
        [st.getOutputCol()] if hasattr(st, "getOutputCol") else ["rawPrediction", "probability", "prediction"])]
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop(*made)


def _class_counts(df: DataFrame, label: str) -> dict:
    return {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}


def fit_calibrated(df: DataFrame, features: Sequence[str], label: str, ident: str, *, model: str = "logistic",
                   calibrate: bool = True, seed: int = 0, least: int = 15, rounds: int | None = None, digits: int = 4) -> Predictor:
    """A predictor; with calibration the mean of three (model, isotonic map) pairs.

    The isotonic fit sees scores rounded to ``digits`` decimals, at most 10^digits + 1
    weighted points, because one task fits it.
    Degenerate labels give a constant model.  Boosted models are fitted side by side.
    """
    if model == "gbm":
        rows = stratified_folds(df.drop("fold"), [label], ident, 3, f"calibrate/{seed}")
        long = rows.select(*features, F.lit(0).alias("target"), F.lit(0).alias("fold"), F.col("fold").alias("inner"), F.col(label).alias("y"), F.lit(1.0).alias("w"))
        fitted = boosted_set(cut(long), features, [(0, -1)], calibrate=calibrate, least=least, rounds=rounds, digits=digits)
        return lambda d, name: d.withColumn(name, fitted[0])
    counts = _class_counts(df, label)
    if len(counts) < 2:
        value = float(next(iter(counts), 0))
        return lambda d, name: d.withColumn(name, F.lit(value))
    if not calibrate or min(counts.values()) < least:
        fitted = base_learner(model, features, label, seed=seed, rounds=rounds).fit(df)
        return lambda d, name: probability(fitted, d, name)
    folds = cut(stratified_folds(df.drop("fold"), [label], ident, 3, f"calibrate/{seed}"))       # read by every fit and map
    pairs: list[tuple[PipelineModel, Model]] = []
    for j in range(3):
        fitted = base_learner(model, features, label, seed=seed, rounds=rounds).fit(folds.filter(F.col("fold") != j))
        held = probability(fitted, folds.filter(F.col("fold") == j), "__p")
        points = held.groupBy(F.round("__p", digits).alias("x")).agg(
            F.avg(label).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        iso = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", predictionCol="__iso").fit(points)
        pairs.append((fitted, iso))

    def predict(d: DataFrame, name: str) -> DataFrame:
        for j, (fitted, iso) in enumerate(pairs):
            d = probability(fitted, d, "x")
            d = iso.transform(d).withColumn(f"__c{j}", F.col("__iso")).drop("x", "__iso")
        mean = (F.col("__c0") + F.col("__c1") + F.col("__c2")) / 3.0
        return d.withColumn(name, mean).drop("__c0", "__c1", "__c2")

    return predict


def boosted_set(rows: DataFrame, features: Sequence[str], wanted: Sequence[tuple[int, int]], *, calibrate: bool = True, least: int = 15,
                rounds: int | None = None, digits: int = 4) -> Column:
    """An array column with one probability per wanted (target, fold to leave out), all models fitted together.

    rows: features, target, fold, inner (three inner folds), y in {0, 1}, w.  With
    calibration an entry is the mean of three (model, isotonic map) pairs, one per inner
    fold; without it, or with a class below ``least`` rows, one model; with one class its
    value.
    """
    counts = {(r["target"], r["fold"], int(r["y"])): r["n"] for r in rows.where("y is not null").groupBy("target", "fold", "y").agg(F.sum("w").alias("n")).collect()}
    models, entries = [], []
    for target, fold in wanted:
        n = [sum(v for (t, f, y), v in counts.items() if t == target and f != fold and y == c) for c in (0, 1)]
        if min(n) == 0:
            entries.append(float(n[1] > 0))
            continue
        inner = (0, 1, 2) if calibrate and min(n) >= least else (-1,)
        entries.append(list(range(len(models), len(models) + len(inner))))
        models += [(target, fold, j) for j in inner]
    if not models:
        return F.array(*[F.lit(e) for e in entries])
    fitted, packed = bo.boost(rows, features, models, settings=bo.Settings(rounds=ROUNDS["gbm"] if rounds is None else rounds))
    inner = [m for m in models if m[2] >= 0]
    maps = bo.calibrate(fitted, packed, models, digits) if inner else {}

    def finish(scores: np.ndarray) -> np.ndarray:
        out = np.empty((len(scores), len(entries)))
        for k, e in enumerate(entries):
            out[:, k] = e if isinstance(e, float) else np.mean(
                [np.interp(scores[:, m], *maps[m]) if m in maps else scores[:, m] for m in e], axis=0)
        return out
    return fitted.column(finish)


class CrossFit:
    """K-fold nuisances: ``e`` out of fold on all rows, ``p1`` from folds of the selected rows.

    A selected row gets the model that never saw its fold (``compat=True`` gives the mean
    of the other folds' models instead), a censored row the mean of all.
    """

    def __init__(self, features: Sequence[str], *, ident: str, model: str = "gbm", folds: int = 5,
                 calibrate: bool = True, bound: float = 1e-3, seed: int = 0, compat: bool = False, rounds: int | None = None):
        self.features, self.ident, self.model, self.k = list(features), ident, model, folds
        self.calibrate, self.bound, self.seed, self.compat, self.rounds = calibrate, bound, seed, compat, rounds
        self.e_models: list[Predictor] = []
        self.p_models: list[Predictor] = []
        self.together: Column | None = None

    def _fit(self, df: DataFrame, label: str, seed: int) -> Predictor:
        return fit_calibrated(df, self.features, label, self.ident, model=self.model, calibrate=self.calibrate,
                              seed=seed, rounds=self.rounds)

    def fit_predict(self, units: DataFrame, t: str = "t", y: str = "y_obs") -> DataFrame:
        rows = stratified_folds(units, [t], self.ident, self.k, f"e/{self.seed}").withColumnRenamed("fold", "__ef")
        rows = stratified_folds(rows, [t, y], self.ident, self.k, f"p/{self.seed}").withColumnRenamed("fold", "__pf")
        if self.model == "gbm":
            return self._chosen(self._all(self._fit_together(rows, t, y)), t)
        rows = cut(rows)
        selected = rows.filter(F.col(t) == 1)
        for i in range(self.k):
            self.e_models.append(self._fit(rows.filter(F.col("__ef") != i), t, self.seed))
        if len(_class_counts(selected, y)) < 2:
            value = selected.agg(F.avg(y)).collect()[0][0] or 0.0
            self.p_models = [lambda d, name: d.withColumn(name, F.lit(float(value)))] * self.k
        else:
            for i in range(self.k):
                self.p_models.append(self._fit(selected.filter(F.col("__pf") != i), y, self.seed + i))
        return self._chosen(self._all(rows), t)

    def _fit_together(self, rows: DataFrame, t: str, y: str) -> DataFrame:
        """Folds of both targets and inner folds as keys of one table; all models of the cross-fit in one go."""
        for name, strata in (("__ei", [t, "__ef"]), ("__pi", [t, y, "__pf"])):
            rows = stratified_folds(rows, strata, self.ident, 3, f"calibrate/{name}/{self.seed}").withColumnRenamed("fold", name)
        rows = cut(rows)
        as_rows = lambda target, f, i, label: F.struct(F.lit(target).alias("target"), F.col(f).alias("fold"), F.col(i).alias("inner"),
                                                       F.col(label).cast("double").alias("y"))
        long = rows.withColumn("__r", F.explode(F.array(as_rows(0, "__ef", "__ei", t), as_rows(1, "__pf", "__pi", y))))
        long = long.where((F.col("__r.target") == 0) | (F.col(t) == 1)).select(*self.features, "__r.*", F.lit(1.0).alias("w"))
        self.together = boosted_set(long, self.features, [(c, i) for c in (0, 1) for i in range(self.k)], calibrate=self.calibrate, rounds=self.rounds)
        return spread(rows.drop("__ei", "__pi"))

    def _chosen(self, out: DataFrame, t: str) -> DataFrame:
        pick = lambda stem, fold: F.element_at(F.array(*[F.col(f"{stem}{i}") for i in range(self.k)]), F.col(fold) + 1)
        every = sum((F.col(f"__p{i}") for i in range(self.k)), F.lit(0.0))
        own = pick("__p", "__pf")
        chosen = (every - own) / (self.k - 1) if self.compat else own
        p1 = F.when(F.col(t) == 1, chosen).otherwise(every / self.k)
        out = out.withColumns({"e": s.clip(pick("__e", "__ef"), self.bound, 1.0 - self.bound),
                               "p1": s.clip(p1, self.bound, 1.0 - self.bound)})
        return out.drop("__ef", "__pf", *[f"__{c}{i}" for c in "ep" for i in range(self.k)])

    def _all(self, df: DataFrame) -> DataFrame:
        if self.together is not None:
            df = df.withColumn("__s", self.together)
            return df.withColumns({f"__{c}{i}": F.col("__s")[j * self.k + i] for j, c in enumerate("ep") for i in range(self.k)}).drop("__s")
        for i, m in enumerate(self.e_models):
            df = m(df, f"__e{i}")
        for i, m in enumerate(self.p_models):
            df = m(df, f"__p{i}")
        return df

    def predict(self, units: DataFrame) -> DataFrame:
        """New rows: the mean over the fold models."""
        out = self._all(units)
        mean = lambda c: sum((F.col(f"__{c}{i}") for i in range(self.k)), F.lit(0.0)) / self.k
        out = out.withColumns({"e": s.clip(mean("e"), self.bound, 1.0 - self.bound),
                               "p1": s.clip(mean("p"), self.bound, 1.0 - self.bound)})
        return out.drop(*[f"__{c}{i}" for c in "ep" for i in range(self.k)])


# --- comparison learners ------------------------------------------------------------

def _scorer(predict: Predictor) -> Predictor:
    return lambda d, name: predict(d, "__q").withColumn(name, s.logit("__q")).drop("__q")


def erm(units: DataFrame, features: Sequence[str], *, t="t", y="y_obs", model="logistic", seed: int = 0, rounds: int | None = None) -> Predictor:
    """Fit on the selected rows only."""
    fitted = base_learner(model, features, y, seed=seed, rounds=rounds).fit(units.filter(F.col(t) == 1))
    return _scorer(lambda d, n: probability(fitted, d, n))


def oracle(units: DataFrame, features: Sequence[str], *, y="y", model="logistic", seed: int = 0, rounds: int | None = None) -> Predictor:
    fitted = base_learner(model, features, y, seed=seed, rounds=rounds).fit(units)
    return _scorer(lambda d, n: probability(fitted, d, n))


def ipw(units: DataFrame, features: Sequence[str], *, t="t", y="y_obs", model="logistic", seed: int = 0, rounds: int | None = None) -> Predictor:
    rows = units.filter(F.col(t) == 1).withColumn("__w", nu.ipw_weight("e"))
    fitted = base_learner(model, features, y, weight="__w", seed=seed, rounds=rounds).fit(rows)
    return _scorer(lambda d, n: probability(fitted, d, n))


def target_regression(units: DataFrame, features: Sequence[str], target: Column, *, seed: int = 0,
                      rounds: int | None = None) -> Predictor:
    """Boosted regression on a pseudo-outcome, scored on the logit scale."""
    settings = bo.Settings(loss="squared", rounds=ROUNDS["gbm"] if rounds is None else rounds)
    fitted = BoostedLearner(features, "__y", None, settings).fit(units.withColumn("__y", target))
    return lambda d, name: d.withColumn(name, s.logit(s.clip(fitted.column(), 1e-4, 1.0 - 1e-4)))


def aipw(units: DataFrame, features: Sequence[str], *, t="t", y="y_obs", seed: int = 0, rounds: int | None = None) -> Predictor:
    return target_regression(units, features, nu.aipw_target(t, y, "e", "p1"), seed=seed, rounds=rounds)


def imputation(units: DataFrame, features: Sequence[str], *, t="t", y="y_obs", seed: int = 0, rounds: int | None = None) -> Predictor:
    return target_regression(units, features, nu.imputation_target(t, y, "p1"), seed=seed, rounds=rounds)


def bagged_ensemble(units: DataFrame, features: Sequence[str], *, ident: str, members: int, t="t", y="y_obs",
                    model="logistic", seed: int = 0, rounds: int | None = None) -> DataFrame:
    """Units with ``member_p``: one probability per bootstrap fit on the selected rows."""
    selected = units.filter(F.col(t) == 1)
    out, names = units, []
    for m in range(members):
        rows = selected.withColumn("__w", poisson1(ident, f"bag/{seed}/{m}").cast("double")).filter("__w > 0")
        fitted = base_learner(model, features, y, weight="__w", seed=seed + m, rounds=rounds).fit(rows)
        out, names = probability(fitted, out, f"__m{m}"), [*names, f"__m{m}"]
    clipped = F.array(*[s.clip(n, 1e-6, 1.0 - 1e-6) for n in names])
    return out.withColumn("member_p", clipped).drop(*names)


# --- linear solvers: one aggregate per step, a d x d solve on the driver ---------------

def linear(beta: Sequence[float], features: Sequence[str]) -> Column:
    """Score with an intercept first."""
    return sum((F.col(c) * float(b) for c, b in zip(features, beta[1:])), F.lit(float(beta[0])))


def residualise(units: DataFrame, features: Sequence[str], signal: str, ridge: float = 1e-3, name: str = "s_res") -> DataFrame:
    """The signal minus its ridge projection on the features, as a z-score."""
    xx, xy, _ = gram(units, features, signal)
    n = xx[0, 0]
    mean_x, mean_y = xx[0, 1:] / n, xy[0] / n
    cov = xx[1:, 1:] - n * np.outer(mean_x, mean_x)
    beta = np.linalg.solve(cov + ridge * np.eye(len(mean_x)), xy[1:] - n * mean_x * mean_y)
    out = units.withColumn(name, F.col(signal) - linear([mean_y - beta @ mean_x, *beta], features))
    row = out.agg(F.avg(name).alias("m"), F.stddev_pop(name).alias("v")).collect()[0]
    return out.withColumn(name, (F.col(name) - row["m"]) / (row["v"] if row["v"] > 1e-9 else 1.0))


def midpoint_scorer(units: DataFrame, features: Sequence[str], lo="lo", hi="hi", weight=None, ridge: float = 1e-3) -> np.ndarray:
    """Unit-norm coefficients of (X'X + ridge I) b = X'(mid - mean mid)."""
    mid = (s.as_col(lo) + s.as_col(hi)) * 0.5
    xx, xy, _ = gram(units, features, mid, weight)
    centred = xy[1:] - xx[0, 1:] * (xy[0] / xx[0, 0])
    beta = np.linalg.solve(xx[1:, 1:] + ridge * np.eye(len(features)), centred)
    norm = np.linalg.norm(beta)
    return beta / norm if norm > 0 else beta


def worst_case_linear(units: DataFrame, features: Sequence[str], *, lo="lo", hi="hi", weight=None, l2: float = 1e-4,
                      clip_score: float | None = None, tol: float = 1e-7, most: int = 500) -> tuple[np.ndarray, float, float]:
    """Linear score minimising the logistic worst-case risk plus ``l2`` times the squared norm of all parameters: (coefficients, objective,
    norm of the last step's model gradient).

    Features should be standardised.  Equal rows are packed once.  The risk is convex with a
    kink where a score is 0: there the worst outcome is the one in the box that makes the
    Newton model flattest, the box's projection of one half.  Each pass is one aggregate
    with gradient and Gram matrix and one with a fan of step lengths along the Newton and
    the gradient direction; it ends when no step lowers the objective by ``tol`` of itself,
    and fails if that takes more than ``most`` passes.
    """
    w = F.lit(1.0) if weight is None else s.as_col(weight)
    rows = cut(units.groupBy(*features, s.as_col(lo).alias("lo"), s.as_col(hi).alias("hi")).agg(F.sum(w).alias("w")))
    total = rows.agg(F.sum("w")).collect()[0][0]
    score = lambda b: s.clip(linear(b, features), -clip_score, clip_score) if clip_score else linear(b, features)

    def risks(candidates: list[np.ndarray]) -> list[float]:
        aggs = [F.sum(F.col("w") * s.worst_loss(score(b), "lo", "hi")).alias(f"r{i}") for i, b in enumerate(candidates)]
        got = rows.agg(*aggs).collect()[0]
        return [float(got[i]) / total + l2 * float(b @ b) for i, b in enumerate(candidates)]

    terms = [F.lit(1.0), *[F.col(c) for c in features]]
    d = len(terms)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    beta = np.zeros(d)
    value = risks([beta])[0]
    for _ in range(most):
        z = F.col("__z")
        worst = F.when(z < 0, F.col("hi")).when(z > 0, F.col("lo")).otherwise(s.clip(F.lit(0.5), "lo", "hi"))
        slope, bend = F.col("w") * (s.expit(z) - worst), F.col("w") * s.expit(z) * (1.0 - s.expit(z))
        if clip_score:
            slope, bend = (F.when(F.abs(z) <= clip_score, c).otherwise(0.0) for c in (slope, bend))
        flat = rows.withColumn("__z", linear(beta, features)).withColumns({"__g": slope, "__h": bend})
        got = flat.agg(*[F.sum(F.col("__g") * x).alias(f"g{i}") for i, x in enumerate(terms)],
                       *[F.sum(F.col("__h") * terms[i] * terms[j]).alias(f"h{i}_{j}") for i, j in upper]).collect()[0]
        grad = np.array([float(got[i]) for i in range(d)]) / total + 2 * l2 * beta
        gram_ = np.zeros((d, d))
        for k, (i, j) in enumerate(upper):
            gram_[i, j] = gram_[j, i] = float(got[d + k]) / total
        newton = np.linalg.solve(gram_ + (2 * l2 + 1e-12) * np.eye(d), grad)
        tries = [beta - t * newton for t in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4)]
        tries += [beta - t * grad for t in (8.0, 2.0, 0.5, 0.1, 0.01, 1e-3, 1e-4)]
        tested = risks(tries)
        best = int(np.argmin(tested))
        if tested[best] >= value - tol * max(abs(value), 1e-12):
            if tested[best] < value:
                beta, value = tries[best], tested[best]
            return beta, value, float(np.linalg.norm(grad))
        beta, value = tries[best], tested[best]
    raise ArithmeticError(f"no convergence in {most} passes; objective {value}")


def worst_case_ranker(units: DataFrame, features: Sequence[str], *, ident: str, lo="lo", hi="hi", weight=None, pairs: int = 4096,
                      rounds: int = 40, steps: int = 10, tau: float = 0.5, rate: float = 0.2, l2: float = 1e-3,
                      seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """Linear scorer trained against the exact worst-case AUROC; never worse than the midpoint start.

    Every round solves the inner problem exactly, averages the adversary's members and
    takes ``steps`` gradient steps on hash-sampled pairs (the sample size is the method's
    own parameter; rows of a packed table count ``weight`` times in the inner problem, the
    start and the pairs).  A round's samples are drawn in one pass.  Returns the best
    coefficients and the worst-case AUROC per round.
    """
    w = F.lit(1.0) if weight is None else s.as_col(weight).cast("double")
    rows = cut(units.select(ident, *features, s.as_col(lo).alias("lo"), s.as_col(hi).alias("hi"), w.alias("__w")))
    n = rows.count()
    beta = midpoint_scorer(rows, features, weight="__w")
    rows = rows.withColumn("__bar", (F.col("lo") + F.col("hi")) * 0.5)
    score = lambda b: linear([0.0, *b], features)
    worst = lambda b: float(rk.sharp_interval(rows.withColumn("__s", score(b)), "__s", weight="__w").collect()[0]["lower"])
    best, history = beta, [worst(beta)]
    top = history[0]
    for k in range(rounds):
        member = rk.least_favourable(rows.withColumn("__s", score(beta)), "__s", weight="__w")
        rows = cut(member.withColumn("__bar", F.col("__bar") + (F.col("p_lower") - F.col("__bar")) / float(k + 1))
                   .drop("__s", "p_lower", "p_upper"))
        share = min(1.0, 4.0 * pairs * steps / max(n, 1))
        salt = f"pairs/{seed}/{k}"
        placed = hash_position(rows.filter(unit_interval(ident, salt) < share), [], ident, salt, "__pos")
        few = placed.filter(F.col("__pos") < 2 * pairs * steps).select("__pos", "__w", "__bar", *features).toPandas().sort_values("__pos")
        x, bar, mass = few[list(features)].to_numpy(float), few["__bar"].to_numpy(float), few["__w"].to_numpy(float)
        rng = np.random.default_rng((seed, k))
        for j in range(steps):        # a bounded sample: pairs are drawn by weight among its rows
            a, b = rng.choice(len(x), (2, pairs), p=mass / mass.sum())
            gap = np.clip((x[a] - x[b]) @ beta / tau, -50.0, 50.0)
            sig = 1.0 / (1.0 + np.exp(-gap))
            pull = bar[a] * (1.0 - bar[b]) * sig * (1.0 - sig) / tau
            grad = (pull[:, None] * (x[a] - x[b])).mean(axis=0) - l2 * beta
            beta = beta + rate / (1.0 + k) * grad / (np.linalg.norm(grad) + 1e-12)
            beta = beta / max(np.linalg.norm(beta), 1e-12)
        history.append(worst(beta))
        if history[-1] > top:
            top, best = history[-1], beta
    return best, history
