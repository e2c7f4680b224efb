"""Doubly-robust and binned intervals for nuisances and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfseen.functions import quantiles as qt
from halfseen.functions import scalar as s
from halfseen.functions.hashing import unit_interval
from halfseen.operators.joins import match
from halfseen.operators.lineage import cut
from halfseen.operators.scan import OrderedScan, ordered_rank


def dr_terms(t, y, e, p1, gamma, weight=None, floor: float = 0.02) -> tuple[Column, Column]:
    """Plug-in and influence terms of ``E[w (T Y + (1-T) g(p1))]``."""
    t = s.as_col(t).cast("double")
    y = F.coalesce(s.as_col(y), F.lit(0.0))
    e, p1 = s.clip(e, floor, 1.0), s.clip(p1, 1e-6, 1.0 - 1e-6)
    w = F.lit(1.0) if weight is None else s.as_col(weight)
    plug = w * (t * y + (1.0 - t) * s.tilt(p1, gamma))
    return plug, plug + w * (1.0 - e) * s.tilt_slope(p1, gamma) * t * (y - p1) / e


def dr_functional(units: DataFrame, gamma, *, t="t", y="y", e="e", p1="p1", weight=None,
                  floor: float = 0.02, keys: Sequence[str] = ()) -> DataFrame:
    plug, infl = dr_terms(t, y, e, p1, gamma, weight, floor)
    rows = units.select(*keys, plug.alias("__p"), infl.alias("__i"))
    return rows.groupBy(*keys).agg(
        F.avg("__i").alias("estimate"),
        (F.stddev_samp("__i") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg("__p").alias("plugin"))


def prevalence_bounds(units: DataFrame, gamma: float, *, alpha: float = 0.05, t="t", y="y", e="e",
                      p1="p1", floor: float = 0.02) -> DataFrame:
    """Both prevalence bounds with an outer Bonferroni interval clipped to [0, 1]."""
    lo_p, lo_i = dr_terms(t, y, e, p1, 1.0 / gamma, None, floor)
    hi_p, hi_i = dr_terms(t, y, e, p1, gamma, None, floor)
    rows = units.select(lo_p.alias("a"), lo_i.alias("b"), hi_p.alias("c"), hi_i.alias("d"))
    root = F.sqrt(F.count(F.lit(1)))
    one = rows.agg(F.avg("b").alias("lo_estimate"), (F.stddev_samp("b") / root).alias("lo_se"),
                   F.avg("a").alias("lo_plugin"), F.avg("d").alias("hi_estimate"),
                   (F.stddev_samp("d") / root).alias("hi_se"), F.avg("c").alias("hi_plugin"))
    z = qt.normal_ppf(1.0 - alpha / 4.0)
    return one.withColumns({
        "outer_lo": s.clip(F.col("lo_estimate") - z * F.col("lo_se"), 0.0, 1.0),
        "outer_hi": s.clip(F.col("hi_estimate") + z * F.col("hi_se"), 0.0, 1.0)})


STRETCHES = 256       # of the hash, per value across an edge


def equal_bins(units: DataFrame, value: str, bins: int, ident: str, name: str = "bin") -> DataFrame:
    """Equal-frequency bins ``floor(rank * bins / n)``; ties are ordered by a hash of the id.

    Values are counted and only their counts are put in order.  At most ``bins`` values lie
    across an edge; they come to the driver with the smallest value of each bin.  Every
    other unit is told its bin by comparison with these.  Units that share a value across
    an edge are counted by stretches of their hash, and only those of a stretch that holds
    an edge are ranked, about one in STRETCHES.
    """
    scan = OrderedScan(units.groupBy(value).agg(F.count(F.lit(1)).alias("__n")), [], [value])
    table = scan.add(__cum=("sum", F.col("__n")), __all=("total", F.col("__n"))).result()
    at = lambda rank: F.least(F.floor(rank * bins / F.col("__all")), F.lit(bins - 1)).cast("int")
    table = table.select(value, (F.col("__cum") - F.col("__n")).alias("__before"), "__all", "__cum").withColumns(
        {"__low": at(F.col("__before")), "__high": at(F.col("__cum") - 1)})
    marks = (table.withColumn("__torn", F.col(value).isNull() | (F.col("__low") < F.col("__high"))).groupBy("__high", "__torn")
             .agg(F.min(value).alias("__min"), F.collect_list(F.when(F.col("__torn"), F.struct("__before", F.col(value).alias("v")))).alias("__at"),
                  F.max("__all").alias("__all")).collect())       # two rows a bin; values across an edge end in bins of their own
    if not marks:
        return units.withColumn(name, F.lit(None).cast("int"))
    total = marks[0]["__all"]
    ends: dict = {}
    for r in marks:
        if r["__min"] is not None:
            ends[r["__high"]] = min(r["__min"], ends.get(r["__high"], r["__min"]))
    order = sorted(ends)
    apart = {x["v"]: x["__before"] for r in marks for x in r["__at"]}
    found = F.size(F.filter(F.array(*[F.lit(ends[b]) for b in order]), lambda m: m <= F.col(value))) if order else F.lit(0)
    plain = F.element_at(F.array(*[F.lit(b) for b in order]), found) if order else F.lit(None).cast("int")
    real = [v for v in apart if v is not None]
    across = F.col(value).isNull() | (F.col(value).isin(*real) if real else F.lit(False))
    if not apart:
        return units.withColumn(name, plain)
    # units of a torn value are counted by stretches of their hash; only stretches that hold an edge are ranked
    before = F.when(F.col(value).isNull(), F.lit(apart.get(None, 0)))
    for v in real:
        before = before.when(F.col(value) == F.lit(v), F.lit(apart[v]))
    spot = lambda rank: F.least(F.floor(rank * bins / F.lit(total)), F.lit(bins - 1)).cast("int")
    hashed = units.withColumn("__h", F.when(across, unit_interval(ident, "bins")))
    hashed = hashed.withColumn("__c", F.floor(F.col("__h") * STRETCHES))
    counts = hashed.filter(across).groupBy(value, "__c").agg(F.count(F.lit(1)).alias("__n"))
    first = before + F.sum("__n").over(Window.partitionBy(value).orderBy("__c")) - F.col("__n")
    cells = cut(counts.withColumn("__first", first).select(
        value, "__c", "__first", spot(F.col("__first")).alias("__low"), spot(F.col("__first") + F.col("__n") - 1).alias("__high")))
    placed = match(hashed, F.broadcast(cells), [value, "__c"], "left")        # at most bins * STRETCHES rows
    torn = F.coalesce(F.col("__low") < F.col("__high"), F.lit(False))
    sure = placed.filter(~torn).withColumn(name, F.when(across, F.col("__low")).otherwise(plain))
    ranked = ordered_rank(placed.filter(torn), [value, "__c"], ["__h", ident], "__k", tie="__h")
    ranked = ranked.withColumn(name, spot(F.col("__k") + F.col("__first"))).drop("__k")
    return sure.unionByName(ranked).drop("__h", "__c", "__first", "__low", "__high")


def exact_binomial(table: DataFrame, k: str, n: str, alpha: float, lo: str = "cp_lo",
                   hi: str = "cp_hi") -> DataFrame:
    """Clopper-Pearson limits per row of a small table of bins (one row per bin)."""
    @F.udf(f"struct<{lo}: double, {hi}: double>")
    def limits(k_, n_):
        return qt.clopper_pearson(int(k_), int(n_), alpha)

    return table.withColumn("__cp", limits(F.col(k), F.col(n))).select("*", "__cp.*").drop("__cp")


def binned_nuisance(units: DataFrame, *, ident: str, alpha: float = 0.10, bins: int = 10, t="t", y="y",
                    e="e", p1="p1", calibration: Column | None = None, margin: bool = False) -> DataFrame:
    """Per unit ``e_lo, e_hi, eta_lo, eta_hi`` from exact intervals of equal-frequency bins."""
    fit = F.lit(True) if calibration is None else calibration
    t, y = s.as_col(t), s.as_col(y)
    # bins read their rows several times, and so do the counts and the join after them
    rows = equal_bins(cut(units), e, bins, ident, "e_bin")
    rows = cut(equal_bins(rows, p1, bins, ident, "p_bin"))
    half = alpha / 2.0
    et = rows.groupBy("e_bin").agg(
        F.count(F.when(fit & (t == 1), 1)).alias("k"), F.count(F.when(fit, 1)).alias("n"),
        (F.max(e) - F.min(e)).alias("span"))
    et = exact_binomial(et, "k", "n", half)
    wide = F.when(F.lit(margin) & (F.col("n") > 0), F.col("span")).otherwise(0.0)
    et = et.select("e_bin", F.greatest(F.col("cp_lo") - wide, F.lit(0.0)).alias("e_lo"),
                   F.least(F.col("cp_hi") + wide, F.lit(1.0)).alias("e_hi"))
    eta = s.logit(s.clip(p1, 1e-6, 1.0 - 1e-6))
    pt = rows.groupBy("p_bin").agg(
        F.count(F.when(fit & (t == 1) & (y == 1), 1)).alias("k"), F.count(F.when(fit & (t == 1), 1)).alias("n"),
        (F.max(eta) - F.min(eta)).alias("span"))
    pt = exact_binomial(pt, "k", "n", half)
    wide = F.when(F.lit(margin), F.col("span")).otherwise(0.0)
    pt = pt.select("p_bin", (s.logit(F.col("cp_lo")) - wide).alias("eta_lo"),
                   (s.logit(F.col("cp_hi")) + wide).alias("eta_hi"))
    # one row per bin on the right
    return rows.join(F.broadcast(et), "e_bin").join(F.broadcast(pt), "p_bin")


def inflate_box(e_lo, eta_lo, eta_hi, gamma: float, direction: str = "two-sided") -> tuple[Column, Column]:
    """Widest box compatible with the nuisance intervals (lo rises with e, hi falls)."""
    if direction not in s.DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    e, a, b = s.clip(e_lo, 0.0, 1.0), s.as_col(eta_lo), s.as_col(eta_hi)
    pa, pb = s.expit(a), s.expit(b)
    if gamma == float("inf"):
        lo, hi = e * pa, e * pb + (1.0 - e)
    else:
        shift = F.log(F.lit(float(gamma)))
        lo = e * pa + (1.0 - e) * s.expit(a - shift)
        hi = e * pb + (1.0 - e) * s.expit(b + shift)
    if direction == "censored-lower":
        hi = pb
    elif direction == "censored-higher":
        lo = pa
    return s.clip(lo, 0.0, 1.0), s.clip(hi, 0.0, 1.0)


def bin_coverage(units: DataFrame, *, ident: str, lo="lo", hi="hi", y="y", bins: int,
                 least: int = 150) -> DataFrame:
    """Bins by box midpoint: does realised rate +- 1.96 se overlap the mean box?"""
    low, high = s.as_col(lo), s.as_col(hi)
    # the bins read their rows several times: what they need is handed over once
    rows = cut(units.select(ident, ((low + high) * 0.5).alias("__mid"), low.alias("__lo"), high.alias("__hi"), s.as_col(y).alias("__y")))
    table = equal_bins(rows, "__mid", bins, ident).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("rate"), F.avg("__lo").alias("mean_lo"), F.avg("__hi").alias("mean_hi"))
    half = 1.96 * F.sqrt(F.col("rate") * (1.0 - F.col("rate")) / F.col("n"))
    overlap = (F.col("rate") + half >= F.col("mean_lo")) & (F.col("rate") - half <= F.col("mean_hi"))
    return table.filter(F.col("n") >= least).withColumn("covered", overlap.cast("int"))
