"""Analyses of the sensitivity level: falsification, sweeps, break-even, odds ratios."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions import quantiles as qt
from halfseen.functions import scalar as s
from halfseen.operators import objectives as ob
from halfseen.operators import ranking as rk
from halfseen.operators.keyed_logistic import fit_keyed, scores
from halfseen.operators.lineage import cut
from halfseen.operators.quantile import exact_quantiles
from halfseen.operators.validate import stratified_folds


def gamma_min(zs="zs", top: float = 1e4, steps: int = 60) -> Column:
    """Smallest gamma at which the intervals of all decision makers intersect.

    ``zs`` is an array of structs with ``e`` and ``p1``.  A fold over bisection steps
    inside the row; infinity if even ``top`` does not suffice.
    """
    zs = s.as_col(zs)

    def feasible(g: Column) -> Column:
        low = F.array_max(F.transform(zs, lambda z: z["e"] * z["p1"] + (1.0 - z["e"]) * s.tilt(z["p1"], 1.0 / g)))
        high = F.array_min(F.transform(zs, lambda z: z["e"] * z["p1"] + (1.0 - z["e"]) * s.tilt(z["p1"], g)))
        return low <= high + 1e-12

    def step(acc: Column, _: Column) -> Column:
        mid = F.sqrt(acc["lo"] * acc["hi"])
        ok = feasible(mid)
        return F.struct(F.when(ok, acc["lo"]).otherwise(mid).alias("lo"),
                        F.when(ok, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(1.0).alias("lo"), F.lit(float(top)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["hi"]
    return F.when(F.size(zs) < 2, F.lit(1.0)).when(feasible(F.lit(float(top))), found).otherwise(
        F.lit(float("inf")))


def realised_gamma(cells: DataFrame, p0: str = "p0", p1: str = "p1", quantiles: Sequence[float] = (1.0,)) -> DataFrame:
    """One row: exp of the largest (1.0) or other quantiles of the log-odds gap, as ``gamma_q<k>`` in the order asked."""
    q = exact_quantiles(cells, {"gap": s.log_odds_gap(p0, p1)}, list(quantiles))
    return q.select(*[F.exp(f"q{i}").alias(f"gamma_q{i}") for i in range(len(quantiles))])


def gamma_summary(cells: DataFrame, value: str = "gamma_min", count: str = "n") -> DataFrame:
    """Maximum and 95% quantile over units (cells weighted by their size), finite only."""
    ok = cells.filter(F.col(value) < F.lit(float("inf")))
    q = exact_quantiles(ok, {value: value}, [0.95], count=F.col(count).cast("bigint"))
    top = ok.agg(F.max(value).alias("gamma_min"), F.lit(value).alias("name"))
    return top.join(q, "name").select("gamma_min", F.col("q0").alias("gamma_min_q95"), F.col("n").alias("n_units"))


def falsification(cells: DataFrame, value: str = "gamma_min", count: str = "n",
                  alpha: float = 0.05) -> DataFrame:
    """Point, 95% quantile and a bootstrap lower limit of the quantile.

    A resampled quantile is an order statistic, so the limit needs no resampling:
    it is the value whose rank share f satisfies P(Bin(n, f) >= 0.95 n) = alpha.
    """
    table = gamma_summary(cells, value, count)
    n = table.collect()[0]["n_units"]
    need, lo, hi = math.ceil(0.95 * n), 0.0, 1.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if qt.binomial_tail(n, mid, need) < alpha:
            lo = mid
        else:
            hi = mid
    ok = cells.filter(F.col(value) < F.lit(float("inf")))
    limit = exact_quantiles(ok, {value: value}, [hi], count=F.col(count).cast("bigint"))
    return table.withColumn("name", F.lit(value)).join(
        limit.select("name", F.col("q0").alias("gamma_min_boot_lo")), "name").drop("name")


def sweep(units: DataFrame, gammas: Sequence[float], *, score="s", e="e", p1="p1", weight=None,
          direction: str = "two-sided", keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, gamma): sharp AUROC interval, worst-case risk and regret.

    Units are packed to distinct (keys, score, e, p1) before they meet the grid.
    """
    w = F.lit(1.0) if weight is None else s.as_col(weight)
    packed = units.groupBy(*keys, s.as_col(score).alias("s"), s.as_col(e).alias("e"),
                           s.as_col(p1).alias("p1")).agg(F.sum(w).alias("w"))
    grid = packed.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    lo, hi = s.box("p1", "e", F.col("gamma"), direction)
    grid = grid.withColumns({"lo": lo, "hi": hi})
    on = [*keys, "gamma"]
    sharp = rk.sharp_interval(grid, "s", weight="w", keys=on, scores=packed)
    flat = grid.groupBy(*on).agg(ob.worst_case_risk(weight="w").alias("worstcase_risk"),
                                 ob.minimax_regret(weight="w").alias("minimax_regret"))
    return sharp.join(flat, on)


def geometric_grid(points: int, top: float) -> list[float]:
    return [top ** (i / (points - 1)) for i in range(points)]


def break_even(table: DataFrame, threshold: float, *, keys: Sequence[str] = ()) -> DataFrame:
    """Largest swept gamma whose lower bound still reaches the threshold, else 1."""
    ok = F.when(F.col("lower") >= threshold, F.col("gamma"))
    return table.groupBy(*keys).agg(
        F.coalesce(F.max(ok), F.lit(1.0)).alias("gamma_star"), F.max(ok).isNull().cast("int").alias("never"),
        (F.max(ok) >= F.max("gamma")).cast("int").alias("at_grid_end"))


def smallest_containing(table: DataFrame, value: float, tol: float = 1e-9) -> DataFrame:
    """Table look-up: the smallest swept gamma whose interval holds ``value``."""
    return table.agg(F.min(F.when(s.contains(F.lit(value), "lower", "upper", tol), F.col("gamma"))).alias("gamma"))


def search_containing(units: DataFrame, value: float, *, tol: float = 1e-6, fan: int = 15, **kw) -> float | None:
    """Smallest gamma whose interval holds ``value``, at most a share ``tol`` too high (intervals are nested).

    The range is widened until an interval holds the value, then refined ``fan`` gammas at
    a time; None if no gamma up to 1e16 has such an interval.
    """
    def first(gammas: list[float]) -> float | None:
        return sweep(units, gammas, **kw).filter(s.contains(F.lit(value), "lower", "upper")).agg(F.min("gamma").alias("g")).collect()[0]["g"]

    lo, hi, gammas = 1.0, 100.0, [1.0]
    while True:
        ratio = (hi / lo) ** (1.0 / fan)
        gammas += [lo * ratio ** (i + 1) for i in range(fan)]
        found = first(gammas)
        if found is not None:
            break
        if hi >= 1e16:
            return None
        lo, hi, gammas = hi, hi * hi, []
    while found > 1.0:
        lo = max((g for g in [lo, *gammas] if g < found), default=1.0)
        if found <= lo * (1.0 + tol):
            break
        ratio = (found / lo) ** (1.0 / fan)
        gammas = [lo * ratio ** (i + 1) for i in range(fan - 1)]
        found = first([*gammas, found]) or found
    return found


def odds_ratio(units: DataFrame, t="t", y="y", *, keys: Sequence[str] = ()) -> DataFrame:
    """odds(Y | T=0) / odds(Y | T=1), its direction and magnitude, with the four counts."""
    t, y = s.as_col(t), s.as_col(y)
    cell = lambda a, b: F.count(F.when((t == a) & (y == b), 1))
    table = units.groupBy(*keys).agg(cell(0, 0).alias("n00"), cell(0, 1).alias("n01"),
                                     cell(1, 0).alias("n10"), cell(1, 1).alias("n11"))
    ratio = (F.col("n01") / F.col("n00")) / (F.col("n11") / F.col("n10"))
    table = table.withColumn("odds_ratio", F.when((F.col("n00") > 0) & (F.col("n10") > 0) & (F.col("n11") > 0), ratio))
    return table.withColumns({
        "direction": F.when(F.col("odds_ratio") > 1, "censored-higher").when(F.col("odds_ratio") < 1, "censored-lower"),
        "magnitude": F.greatest(F.col("odds_ratio"), 1.0 / F.col("odds_ratio"))})


def containment(table: DataFrame, *, point, ci_lo, ci_hi) -> DataFrame:
    """Is a point, is its interval inside (or touching) each swept interval?"""
    p, a, b = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (point, ci_lo, ci_hi))
    return table.withColumns({
        "point_contained": ((p >= F.col("lower")) & (p <= F.col("upper"))).cast("int"),
        "ci_contained": ((a >= F.col("lower")) & (b <= F.col("upper"))).cast("int"),
        "ci_overlaps": ((b >= F.col("lower")) & (a <= F.col("upper"))).cast("int")})


def usable_centres(units: DataFrame, z: str, t: str, y: str, *, folds: int = 5, least: int = 10) -> DataFrame:
    """Per centre: size and whether decision and outcomes vary enough to estimate nuisances."""
    tc, yc = F.col(t), F.col(y)
    table = units.groupBy(z).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(tc == 1).alias("n1"), F.count_if(tc == 0).alias("n0"),
        F.count_if((tc == 1) & (yc == 1)).alias("pos"), F.count_if((tc == 1) & (yc == 0)).alias("neg"))
    reason = (F.when(F.col("n") < max(least, 2 * folds), "too few units")
              .when(F.least("n1", "n0") < folds, "decision does not vary enough")
              .when(F.least("pos", "neg") < folds, "too few outcomes of each class"))
    return table.withColumns({"reason": reason, "used": reason.isNull().cast("int")})


def leniency(units: DataFrame, features: Sequence[str], *, z: str, t: str, y: str, ident: str, seeds: int = 5, folds: int = 5,
             least: int = 10, bound: float = 1e-3, boot: bool = True) -> tuple[DataFrame, DataFrame]:
    """Gamma_min from the leniency of centres: (one row per seed, failures).

    Per seed, usable centre and fold a logistic model of the decision on all its units and
    one of the outcome on its selected ones, all fitted together; a centre's nuisances at a
    point are the means over its folds. The grid is all units, packed by their features. A
    row: seed, gamma_min, gamma_min_q95, gamma_min_boot_lo (null without ``boot``),
    n_units, n_groups. A fold without both classes fails its centre for that seed; failures
    are rows (seed, centre, error), and a seed with fewer than two centres has only those.
    Models are keys: seeds * centres * folds * 2 coefficient vectors are all that the driver
    holds.
    """
    spark = units.sparkSession
    units = cut(units.select(*dict.fromkeys([*features, z, t, y, ident])))        # read by the centres, the folds and the grid
    centres = sorted(r[z] for r in usable_centres(units, z, t, y, folds=folds, least=least).filter("used = 1").select(z).collect())
    many, models = len(centres), 2 * folds
    index = spark.createDataFrame([(c, i) for i, c in enumerate(centres)], f"__c {dict(units.dtypes)[z]}, __zi int")
    rows = units.select(*features, F.col(z).alias("__z"), F.col(t).cast("int").alias("__t"), F.col(y).cast("double").alias("__y"), F.col(ident).alias("__i"))
    rows = rows.join(F.broadcast(index), F.col("__z") == F.col("__c")).drop("__c")          # one row per usable centre
    rows = rows.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("__i", F.concat_ws("/", "__i", "__s"))
    rows = stratified_folds(rows, ["__s", "__z", "__t"], "__i", folds, "leniency/e").withColumnRenamed("fold", "__ef")
    rows = stratified_folds(rows, ["__s", "__z", "__t", "__y"], "__i", folds, "leniency/p").withColumnRenamed("fold", "__pf")
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("__ef").alias("fold"), F.col("__t").cast("double").alias("y")),
                    F.struct(F.lit(1).alias("kind"), F.col("__pf").alias("fold"), F.col("__y").alias("y")))
    long = rows.select(*features, "__s", "__zi", "__t", F.inline(kinds)).where("kind = 0 or __t = 1")
    long = cut(long.groupBy(*features, "__s", "__zi", "kind", "fold", "y").agg(F.count(F.lit(1)).alias("w")))
    out_of = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold")))
    key = (F.col("__s") * many + F.col("__zi")) * models + F.col("kind") * folds + F.col("left_out")
    beta, problem = fit_keyed(long.withColumn("left_out", out_of).withColumn("k", key), features, max(seeds * many * models, 1))

    failures = [(k // models // many, str(centres[k // models % many]), e) for k, e in enumerate(problem) if e and many]
    lost = {(seed, c) for seed, c, _ in failures}
    used = [[i for i, c in enumerate(centres) if (seed, str(c)) not in lost] for seed in range(seeds)]
    failures += [(seed, None, "fewer than two centres fitted") for seed in range(seeds) if len(used[seed]) < 2]
    fitted = spark.createDataFrame(failures, "seed int, centre string, error string")
    grid = cut(units.groupBy(*features).agg(F.count(F.lit(1)).alias("n")).withColumn("__q", scores(beta, features)))
    parts = []
    for seed in [k for k in range(seeds) if len(used[k]) > 1]:
        def nuisance(i: int, kind: int, seed=seed) -> Column:
            at = (seed * many + i) * models + kind * folds
            return s.clip(sum((F.col("__q")[at + f] for f in range(folds)), F.lit(0.0)) / folds, bound, 1.0 - bound)
        zs = F.array(*[F.struct(nuisance(i, 0).alias("e"), nuisance(i, 1).alias("p1")) for i in used[seed]])
        parts.append(grid.select(F.lit(seed).alias("seed"), F.lit(len(used[seed])).alias("n_groups"), "n", zs.alias("zs")))
    none = "seed int, gamma_min double, gamma_min_q95 double, gamma_min_boot_lo double, n_units long, n_groups int"
    if not parts:
        return spark.createDataFrame([], none), fitted
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = cut(cells.select("seed", "n_groups", "n", gamma_min("zs").alias("gamma_min")))
    ok = cells.filter(F.col("gamma_min") < F.lit(float("inf")))
    q = exact_quantiles(ok, {"gamma_min": "gamma_min"}, [0.95], keys=["seed"], count=F.col("n").cast("bigint")).select(
        "seed", F.col("q0").alias("gamma_min_q95"), F.col("n").cast("long").alias("n_units"))
    table = ok.groupBy("seed", "n_groups").agg(F.max("gamma_min").alias("gamma_min")).join(q, "seed")
    low = F.lit(None).cast("double")
    if boot:
        limits = {r["seed"]: falsification(ok.where(F.col("seed") == r["seed"])).first()["gamma_min_boot_lo"] for r in ok.select("seed").distinct().collect()}
        low = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[F.col("seed")] if limits else low
    return table.withColumn("gamma_min_boot_lo", low).select("seed", "gamma_min", "gamma_min_q95", "gamma_min_boot_lo", "n_units", "n_groups"), fitted


def compare_populations(row: DataFrame, here: str, there: str, ci_lo: Column, ci_hi: Column) -> DataFrame:
    """Difference, ratio, whether the interval here holds the value there, same side of 1."""
    a, b = F.col(here), F.col(there)
    return row.withColumns({
        "difference": a - b, "ratio": F.when(b != 0, a / b), "ci_contains": ((b >= ci_lo - 1e-9) & (b <= ci_hi + 1e-9)).cast("int"),
        "same_direction": ((a < 1) == (b < 1)).cast("int")})


def misspecification(rows: DataFrame, gamma: str, true_gamma: float, truth: str, *, lower: str = "lo", upper: str = "hi",
                     weight=None) -> DataFrame:
    """Coverage and width by how the assumed gamma relates to the true one."""
    ratio = F.col(gamma) / true_gamma
    bucket = F.when(ratio < 0.9, "below").when(ratio <= 1.1, "near").otherwise("above")
    hit = s.contains(truth, lower, upper, 1e-12).cast("double")
    return rows.groupBy(bucket.alias("bucket")).agg(
        ob.mean(hit, weight).alias("coverage"), ob.mean(F.col(upper) - F.col(lower), weight).alias("width"))


def infer_direction(units: DataFrame, t: str, y: str) -> str:
    """The sign of selection where both groups' outcomes are known."""
    row = units.agg(F.avg(F.when(F.col(t) == 0, F.col(y))).alias("p0"), F.avg(F.when(F.col(t) == 1, F.col(y))).alias("p1")).collect()[0]
    return "censored-lower" if row["p0"] < row["p1"] else "censored-higher"
