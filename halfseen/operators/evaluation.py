"""Metrics of scores against labels, and summaries over seeds and methods."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from halfseen.functions import scalar as s
from halfseen.functions.hashing import hash32, replicate_weights, unit_interval
from halfseen.functions.quantiles import normal_ppf, t_ppf
from halfseen.operators import objectives as ob
from halfseen.operators import ranking as rk
from halfseen.operators.quantile import exact_quantiles
from halfseen.operators.scan import OrderedScan, ordered_rank


def deployment_metrics(units: DataFrame, score="s", y="y", *, keys: Sequence[str] = (),
                       loss: str = "logistic", prefix: str = "", weight=None) -> DataFrame:
    """Risk, AUROC, accuracy, balanced accuracy and Brier score against full labels."""
    z, label = s.as_col(score), s.as_col(y)
    positive = (z > 0).cast("double")

    def mean(value: Column, among: Column | None = None) -> Column:
        if weight is None:
            return F.avg(value if among is None else F.when(among, value))
        w = s.as_col(weight) if among is None else F.when(among, s.as_col(weight))
        return F.sum(w * value) / F.sum(w)

    flat = units.groupBy(*keys).agg(
        mean(s.loss_at(z, label, loss)).alias(f"{prefix}risk"),
        mean((positive == label).cast("double")).alias(f"{prefix}accuracy"),
        (0.5 * (mean(positive, label == 1) + mean(1.0 - positive, label == 0))).alias(f"{prefix}balanced_accuracy"),
        mean(F.pow(s.expit(z) - label, 2)).alias(f"{prefix}brier"))
    curve = rk.auc(units, score, {f"{prefix}auroc": label}, keys=keys, weight=weight)
    if not keys:
        one = F.lit(1).alias("__one")
        return flat.select("*", one).join(curve.select("*", one), "__one").drop("__one")
    return flat.join(curve, list(keys))


def observed_metrics(units: DataFrame, score="s", t="t", y="y", *, keys: Sequence[str] = (),
                     loss: str = "logistic", weight=None) -> DataFrame:
    return deployment_metrics(units.filter(s.as_col(t) == 1), score, y, keys=keys, loss=loss, prefix="obs_", weight=weight)


def bounds_report(units: DataFrame, score="s", lo="lo", hi="hi", *, keys: Sequence[str] = (),
                  weight=None) -> DataFrame:
    """Sharp AUROC interval, worst-case risk, regret and abstention per key."""
    one = [] if keys else [F.lit(1).alias("__one")]
    on = list(keys) or ["__one"]
    flat = units.groupBy(*keys).agg(
        ob.worst_case_risk(score, lo, hi, weight=weight).alias("worstcase_risk"),
        ob.minimax_regret(score, lo, hi, weight=weight).alias("minimax_regret"),
        ob.abstention_rate(lo, hi, weight=weight).alias("abstention_rate")).select("*", *one)
    sharp = rk.sharp_interval(units, score, lo, hi, keys=keys, weight=weight)
    sharp = sharp.select(*keys, F.col("lower").alias("auroc_lo"), F.col("upper").alias("auroc_hi"),
                         F.col("width").alias("auroc_width"), *one)
    return sharp.join(flat, on).drop("__one")


def contraction_failure_rate(units: DataFrame, *, score: str, t: str, y: str, z: str, tie: str,
                             rate: float) -> DataFrame:
    """Failure rate among the best-scored accepted cases of the most lenient decision maker."""
    groups = units.groupBy(z).agg(F.avg(t).alias("__r"), F.count(F.lit(1)).alias("__n"))
    # most lenient; the smallest level on ties
    best = groups.orderBy(F.col("__r").desc(), F.col(z)).limit(1)
    mine = units.join(best.select(z, "__n"), z).filter(F.col(t) == 1)
    # equal scores are ordered by a hash, so that a frequent score can be cut into blocks too
    mine = mine.withColumn("__h", unit_interval(tie, "contraction"))
    ranked = ordered_rank(mine, [], [score, "__h", tie], "__k", tie="__h")
    kept = ranked.filter(F.col("__k") < F.bround(F.lit(float(rate)) * F.col("__n"), 0))
    return kept.agg(F.avg(y).alias("failure_rate"), F.count(F.lit(1)).alias("n_kept"))


def calibration(units: DataFrame, p="p", y="y", *, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed-width bins: count, mean prediction, positive share and the bin's part of the ECE."""
    b = F.least(F.floor(s.as_col(p) * bins), F.lit(bins - 1)).cast("bigint")
    table = units.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s.as_col(p)).alias("mean_p"), F.avg(s.as_col(y)).alias("share"))
    return table.withColumn("gap", F.abs(F.col("mean_p") - F.col("share")))


def expected_calibration_error(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def t_quantile(n: Column, most: int = 200, p: float = 0.975) -> Column:
    """Student quantile at n - 1 degrees of freedom: a table up to ``most``, the normal quantile's expansion (error below 1e-12) beyond."""
    table = F.array(*[F.lit(t_ppf(p, df)) for df in range(1, most + 1)])
    v, z = (n - 1).cast("double"), normal_ppf(p)
    terms = [(z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
             (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160]
    far = sum((F.lit(c) / F.pow(v, F.lit(float(k))) for k, c in enumerate(terms, 1)), F.lit(z))
    return F.when(n - 1 > most, far).when(n >= 2, F.element_at(table, F.least(n - 1, F.lit(most)).cast("int")))


def seed_interval(runs: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, t-based 95% half-width and count over the finite values of a key."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    table = runs.filter(ok).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"), F.count(value).alias("n"))
    return table.withColumn("ci95", t_quantile(F.col("n")) * F.col("__sd") / F.sqrt("n")).drop("__sd")


CELLS = 200_000       # weights, and sums of a task, held at a time


def _numbered(spark, seeds: int, replicates: int) -> DataFrame:
    """Places of the replicates in a vector of sums."""
    return spark.range(seeds * replicates).select(
        F.col("id").cast("int").alias("__p"), F.floor(F.col("id") / replicates).cast("int").alias("seed"),
        (F.col("id") % replicates).cast("int").alias("rep"))


def replicate_sums(units: DataFrame, ident, values: Mapping[str, object], *, keys: Sequence[str] = (),
                   seeds: int, replicates: int, count=None) -> DataFrame:
    """Rows (keys, seed, rep): bootstrap-weighted sums of the values and their weight ``bw``.

    A task turns its rows into one vector of replicate sums per key and value, so what is
    exchanged is vectors of fixed length per task and key, never rows times replicates.
    Weights come from a hash of the id, so they replay after a lost executor.  Without
    ``count`` a row is one unit (Poisson(1)); with it a row stands for that many equal
    units.  A null value adds nothing but keeps its row's weight.
    """
    names, total = list(values), seeds * replicates
    n = F.lit(None).cast("double") if count is None else s.as_col(count).cast("double")
    rows = units.select(*keys, hash32(ident, "replicates").alias("__h"), n.alias("__n"),
                        *[F.coalesce(s.as_col(v).cast("double"), F.lit(0.0)).alias(f"__v{i}") for i, v in enumerate(values.values())])
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = StructType([*fields, StructField("__sums", ArrayType(ArrayType(DoubleType())))])
    packed = count is not None
    step, most = max(1, CELLS // total), max(1, CELLS // (total * (len(names) + 1)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=list(keys), index=range(len(held))) if keys else pd.DataFrame(index=range(len(held)))
            out["__sums"] = [list(v) for v in held.values()]
            held.clear()
            return out

        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                w = replicate_weights(part["__n"].to_numpy() if packed else None, part["__h"].to_numpy(), total)
                v = np.column_stack([np.ones(len(part)), *[part[f"__v{i}"].to_numpy() for i in range(len(names))]])
                codes = part.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(part), int)
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
                w, v = w[order], v[order]
                heads = part[list(keys)].iloc[order[starts]].itertuples(index=False, name=None) if keys else [()]
                by_key = np.stack([np.add.reduceat(w * v[:, [i]], starts) for i in range(v.shape[1])], axis=1)
                for key, block in zip(heads, by_key):
                    key = tuple(None if pd.isna(x) else x for x in key)
                    held[key] = held.get(key, 0.0) + block
                    if len(held) >= most:
                        yield told()
        if held:
            yield told()

    vectors = rows.mapInPandas(sums, schema)
    at = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(total - 1)), *[F.get("__sums", F.lit(i)) for i in range(len(names) + 1)]))
    flat = vectors.select(*keys, at.alias("__z")).select(*keys, *[F.col(f"__z.{i}").alias(f"__c{i}") for i in range(len(names) + 2)])
    flat = flat.groupBy(*keys, F.col("__c0").alias("__p")).agg(
        *[F.sum(f"__c{i + 1}").alias(c) for i, c in enumerate(["bw", *names])])
    numbered = F.broadcast(_numbered(units.sparkSession, seeds, replicates))
    return flat.join(numbered, "__p").select(*keys, "seed", "rep", "bw", *names)


def auc_replicates(units: DataFrame, score: str, y: str, *, seeds: int, replicates: int, count=None, blocks: int | None = None
                   ) -> DataFrame:
    """Rows (seed, rep): AUROC of each bootstrap replicate (``auc``, null for a single class).

    Rows are packed by (score, label) and range-partitioned by score once.  A task walks
    its stretch of scores and keeps, per replicate, the weight of positives and negatives
    and of concordant pairs inside the stretch (ties count half); a running sum over the
    stretches adds the pairs between them.  No rows times replicates are exchanged, and the
    result is exact for any number of distinct scores.
    """
    total = seeds * replicates
    n = F.lit(1) if count is None else s.as_col(count)
    known = units.select(s.as_col(score).cast("double").alias("s"), s.as_col(y).cast("double").alias("y"), n.alias("n"))
    packed = known.filter("s IS NOT NULL AND y IS NOT NULL").groupBy("s", "y").agg(F.sum("n").cast("double").alias("n"))
    parts = blocks or int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = packed.withColumn("h", hash32(F.concat_ws("/", "s", "y"), "replicates")).repartitionByRange(parts, "s").sortWithinPartitions("s")
    step = max(1, CELLS // total)

    def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg, within = np.zeros(total), np.zeros(total), np.zeros(total)
        first = last = None
        tie_pos, tie_neg = np.zeros(total), np.zeros(total)       # of the score that is still open
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                score_, label = part["s"].to_numpy(), part["y"].to_numpy()
                w = replicate_weights(part["n"].to_numpy(), part["h"].to_numpy(), total)
                starts = np.flatnonzero(np.r_[True, score_[1:] != score_[:-1]])
                up = np.add.reduceat(w * label[:, None], starts)
                down = np.add.reduceat(w * (1.0 - label[:, None]), starts)
                first = score_[0] if first is None else first
                if last == score_[0]:
                    up[0], down[0] = up[0] + tie_pos, down[0] + tie_neg
                elif last is not None:
                    up, down = np.vstack([tie_pos, up]), np.vstack([tie_neg, down])
                last, tie_pos, tie_neg = score_[-1], up[-1], down[-1]
                up, down = up[:-1], down[:-1]
                if len(up):
                    below = neg + np.cumsum(down, axis=0) - down
                    within += (up * (below + 0.5 * down)).sum(axis=0)
                    pos, neg = pos + up.sum(axis=0), neg + down.sum(axis=0)
        if first is not None:
            within += tie_pos * (neg + 0.5 * tie_neg)
            yield pd.DataFrame({"lo": [first], "sums": [[list(pos + tie_pos), list(neg + tie_neg), list(within)]]})

    vectors = lined.mapInPandas(stretch, "lo double, sums array<array<double>>")
    at = F.arrays_zip(F.sequence(F.lit(0), F.lit(total - 1)), *[F.get("sums", F.lit(i)) for i in range(3)])
    flat = vectors.select("lo", F.explode(at).alias("z")).select(
        "lo", *[F.col(f"z.{i}").alias(c) for i, c in enumerate(("__p", "pos", "neg", "within"))])
    lower = F.sum("neg").over(Window.partitionBy("__p").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("pairs", F.col("within") + F.col("pos") * F.coalesce(lower, F.lit(0.0)))
    sums = flat.groupBy("__p").agg(F.sum("pairs").alias("pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    auc = F.try_divide(F.col("pairs"), F.col("pos") * F.col("neg"))
    return sums.join(F.broadcast(_numbered(units.sparkSession, seeds, replicates)), "__p").select("seed", "rep", auc.alias("auc"))


def influence_interval(units: DataFrame, score: str, y: str, *, keys: Sequence[str] = (), count=None, level: float = 0.95) -> DataFrame:
    """AUROC with the interval from influence values (DeLong): one ordered scan, no resampling.

    A positive's value is the share of negatives scored below it, a negative's the share
    of positives above it (ties half); the variance is the sum of both sample variances
    over their counts.  Null where a class has fewer than two units.
    """
    n = F.lit(1) if count is None else s.as_col(count)
    known = units.filter(s.as_col(score).isNotNull() & s.as_col(y).isNotNull())
    table = known.groupBy(*keys, s.as_col(score).cast("double").alias("__s")).agg(
        F.sum(n * s.as_col(y)).cast("double").alias("__u"), F.sum(n * (1 - s.as_col(y))).cast("double").alias("__d"))
    scan = OrderedScan(table, keys, ["__s"]).add(
        __cu=("sum", F.col("__u")), __cd=("sum", F.col("__d")), __m=("total", F.col("__u")), __k=("total", F.col("__d")))
    c = F.col
    rows = scan.result().withColumns({"__a": F.try_divide(c("__cd") - 0.5 * c("__d"), c("__k")),
                                      "__b": F.try_divide(c("__m") - c("__cu") + 0.5 * c("__u"), c("__m"))})
    out = rows.groupBy(*keys).agg(
        F.first("__m").alias("n_pos"), F.first("__k").alias("n_neg"),
        F.try_divide(F.sum(c("__u") * c("__a")), F.first("__m")).alias("auc"),
        F.sum(c("__u") * c("__a") * c("__a")).alias("__aa"), F.sum(c("__d") * c("__b") * c("__b")).alias("__bb"))
    # sample variances: n (mean of squares - square of the mean) / (n - 1)
    var = lambda sq, k: F.when(c(k) > 1, F.greatest(c(sq) / c(k) - c("auc") * c("auc"), F.lit(0.0)) / (c(k) - 1))
    se = F.sqrt(var("__aa", "n_pos") + var("__bb", "n_neg"))
    z = normal_ppf(0.5 + level / 2.0)
    out = out.withColumn("se", se)
    return out.select(*keys, "auc", "se", (c("auc") - z * c("se")).alias("lo"), (c("auc") + z * c("se")).alias("hi"),
                      c("n_pos").cast("bigint").alias("n_pos"), c("n_neg").cast("bigint").alias("n_neg"))


def bootstrap_summary(stats: DataFrame, value: str) -> DataFrame:
    """Percentile interval per seed and pooled (seed null) of replicate statistics."""
    ok = stats.filter(F.col(value).isNotNull() & ~F.isnan(value))
    both = ok.select(F.explode(F.array(F.col("seed"), F.lit(None).cast("int"))).alias("seed"), value)
    q = exact_quantiles(both.withColumn("__s", F.coalesce(F.col("seed"), F.lit(-1))), {value: value},
                        [0.025, 0.975], keys=["__s"])
    mean = both.groupBy(F.coalesce(F.col("seed"), F.lit(-1)).alias("__s")).agg(F.avg(value).alias("mean"))
    return q.join(mean, "__s").select(F.nullif(F.col("__s"), F.lit(-1)).alias("seed"), "mean",
                                      F.col("q0").alias("lo"), F.col("q1").alias("hi"), F.col("n").alias("n_boot"))


def loglog_fit(df: DataFrame, x: str, y: str, *, keys: Sequence[str] = ()) -> DataFrame:
    lx, ly = F.log(F.col(x)), F.log(F.col(y))
    return df.groupBy(*keys).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"),
                                 F.regr_r2(ly, lx).alias("r2"))


def method_summary(runs: DataFrame, method: str, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation per method family (the name without its bracketed parameters)."""
    family = F.regexp_replace(F.col(method), r"\(.*\)", "")
    return runs.groupBy(*keys, family.alias("family")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n"))


def coverage_by(rows: DataFrame, truth: str, keys: Sequence[str], lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Share of intervals that hold the truth and their mean width."""
    return rows.groupBy(*keys).agg(
        F.avg(s.contains(truth, lower, upper).cast("double")).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("width"), F.count(F.lit(1)).alias("n"))


def realised_auroc(units: DataFrame, score: str, y: str, *, seeds: int = 2, replicates: int = 100, least: int = 10
                   ) -> DataFrame:
    """One row: AUROC of scored units with a known outcome, its bootstrap interval and published counts.

    Withheld (``available`` = 0) for fewer than ``least`` units or a single outcome class;
    small counts are suppressed.
    """
    known = units.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).select(
        F.col(score).cast("double").alias("s"), F.col(y).cast("double").alias("y"))
    packed = known.groupBy("s", "y").agg(F.count(F.lit(1)).alias("n"))
    point = rk.auc(packed, "s", {"point": "y"}, weight="n").withColumn("k", F.lit(1))
    pooled = bootstrap_summary(auc_replicates(packed, "s", "y", seeds=seeds, replicates=replicates, count="n"), "auc")
    pooled = pooled.filter("seed IS NULL").select(F.lit(1).alias("k"), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"), "n_boot")
    counts = packed.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).cast("bigint").alias("events"), F.lit(1).alias("k"))
    row = counts.join(point, "k").join(pooled, "k", "left")
    ok = (F.col("n") >= least) & (F.col("events") > 0) & (F.col("events") < F.col("n"))
    hide = lambda c: F.when((c == 0) | (c >= least), c)
    return row.select(
        ok.cast("int").alias("available"), *[F.when(ok, F.col(c)).alias(c) for c in ("point", "ci_lo", "ci_hi")],
        hide(F.col("n")).alias("n_units"), hide(F.col("events")).alias("n_events"), hide(F.col("n") - F.col("events")).alias("n_others"))


def odds_ratio_interval(units: DataFrame, t: str, y: str, *, seeds: int = 3, replicates: int = 100) -> DataFrame:
    """Percentile intervals of the odds ratio, resampling its four counts."""
    cells = units.filter(F.col(y).isNotNull()).groupBy(F.col(t).alias("t"), F.col(y).cast("double").alias("y")).agg(
        F.count(F.lit(1)).alias("n"))
    one = {f"c{a}{b}": F.when((F.col("t") == a) & (F.col("y") == b), 1) for a in (0, 1) for b in (0, 1)}
    sums = replicate_sums(cells, F.concat_ws("/", "t", "y"), one, seeds=seeds, replicates=replicates, count="n")
    odds = F.try_divide(F.try_divide(F.nullif(F.col("c01"), F.lit(0.0)), F.col("c00")), F.try_divide(F.col("c11"), F.col("c10")))
    stats = sums.select("seed", "rep", odds.alias("odds_ratio"))
    return bootstrap_summary(stats, "odds_ratio")
