"""Manual review: stratified samples, answer parsing and agreement scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions.hashing import unit_interval
from halfseen.functions.scalar import as_col, wilson
from halfseen.operators.validate import hash_position

NA_WORDS = ("NA", "N/A", "NONE", "NOT DOCUMENTED", "ND")   # fixed values: "documented absent"
TRUTH_COLUMNS = ("truth_lvef", "truth_wall_cm", "truth_valve_modsev", "truth_shd", "reviewer_comment")   # fixed values: left blank for the reviewer


def stratum(composite) -> Column:
    c = as_col(composite)
    return F.when(c.isNull(), "missing").when(c == 1, "positive").otherwise("negative")


def allocate(counts: Mapping[str, int], n: int) -> dict[str, int]:
    """Equal shares; what a stratum cannot give goes to the others, rounds in stratum order."""
    got = dict.fromkeys(counts, 0)
    while n > 0:
        spare = [s for s in counts if got[s] < counts[s]]
        if not spare:
            break
        share = max(1, n // len(spare))
        for s in spare:
            take = min(share, counts[s] - got[s], n)
            got[s] += take
            n -= take
    return got


def allocation(pool: DataFrame, strata: str, order: Sequence[str], n: int) -> dict[str, int]:
    seen = {r[strata]: r["count"] for r in pool.groupBy(strata).count().collect()}
    return allocate({s: seen.get(s, 0) for s in order}, n)


def stratified_sample(pool: DataFrame, strata: str, order: Sequence[str], n: int, ident: str, salt) -> DataFrame:
    """Exactly the allocated number of rows per stratum, first in hash order; shuffled position."""
    quota = allocation(pool, strata, order, n)
    limit = F.create_map(*[F.lit(v) for kv in quota.items() for v in kv])
    placed = hash_position(pool, [strata], ident, salt, "__pos")
    return placed.filter(F.col("__pos") < F.coalesce(F.try_element_at(limit, F.col(strata)), F.lit(0))).drop("__pos")


def pool_sample(notes: DataFrame, most: int, ident: str, salt) -> DataFrame:
    """All notes, or exactly ``most`` of them: the first in hash order.

    A hash bound ten deviations above the wanted share goes first, so that about ``most``
    rows are ordered and their texts moved; if it held too few, all would be.
    """
    n = notes.count()
    if n <= most:
        return notes
    few = notes.filter(unit_interval(ident, salt) < (most + 10.0 * math.sqrt(most) + 10.0) / n)
    if few.count() < most:
        few = notes
    return hash_position(few, [], ident, salt, "__pos").filter(F.col("__pos") < most).drop("__pos")


def review_sheet(pool: DataFrame, strata: str, order: Sequence[str], n: int, ident: str, salt,
                 blank: Sequence[str] = TRUTH_COLUMNS) -> DataFrame:
    """The stratified sample in a shuffled order (``position`` from 0) that does not show the strata, with blank answer columns."""
    drawn = stratified_sample(pool, strata, order, n, ident, salt)
    placed = hash_position(drawn, [], ident, f"{salt}/order", "position")
    return placed.withColumns({c: F.lit("") for c in blank})


def parse_answer_cell(x) -> Column:
    """Blank is null (not reviewed), an NA word is -1 (documented absent), else the number."""
    s = F.trim(as_col(x))
    return F.when(F.upper(s).isin(*NA_WORDS), F.lit(-1.0)).when(F.lower(s) != "nan", s.try_cast("double"))


def binary_scores(rows: DataFrame, truth, pred, rule: Callable[[Column], Column], *,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and Wilson limits.

    A missing prediction counts as negative; ``recall_documented`` leaves those out.
    """
    t, p = as_col(truth), as_col(pred)
    yt = F.when(t < 0, F.lit(False)).otherwise(rule(t))
    yp = F.coalesce(rule(p), F.lit(False))
    known = rows.filter(t.isNotNull())
    out = known.groupBy(*keys).agg(
        F.count_if(yt & yp).alias("tp"), F.count_if(~yt & yp).alias("fp"), F.count_if(yt & ~yp).alias("fn"),
        F.count_if(~yt & ~yp).alias("tn"), F.count(F.lit(1)).alias("n_reviewed"),
        F.count_if(p.isNull()).alias("n_pred_missing"),
        F.count_if(yt & yp & p.isNotNull()).alias("__dtp"), F.count_if(yt & p.isNotNull()).alias("__dt"))
    c = F.col
    ratio = lambda a, b: F.when(b > 0, a / b)
    out = out.withColumns({"precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")),
                           "accuracy": (c("tp") + c("tn")) / c("n_reviewed"),
                           "recall_documented": ratio(c("__dtp"), c("__dt")), "n_truth_positive": c("tp") + c("fn")})
    s = c("precision") + c("recall")
    plo, phi = wilson(c("tp"), c("tp") + c("fp"))
    rlo, rhi = wilson(c("tp"), c("tp") + c("fn"))
    return out.withColumns({"f1": F.when(s > 0, 2.0 * c("precision") * c("recall") / s), "precision_lo": plo,
                            "precision_hi": phi, "recall_lo": rlo, "recall_hi": rhi}).drop("__dtp", "__dt")


def bootstrap_f1(scores: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Percentile interval of F1: the four confusion counts are resampled, not the rows."""
    @F.udf("struct<f1_lo: double, f1_hi: double>")
    def limits(tp, fp, fn, tn):
        n = tp + fp + fn + tn
        if n == 0:
            return None
        draws = np.random.default_rng(seed).multinomial(n, [tp / n, fp / n, fn / n, tn / n], size=reps)
        a, b, c = draws[:, 0], draws[:, 1], draws[:, 2]
        ok = a > 0
        if not ok.any():
            return None
        f1 = 2.0 * a[ok] / (2.0 * a[ok] + b[ok] + c[ok])
        return float(np.percentile(f1, 2.5)), float(np.percentile(f1, 97.5))

    return scores.withColumn("__b", limits("tp", "fp", "fn", "tn")).select("*", "__b.*").drop("__b")


def numeric_agreement(rows: DataFrame, truth, pred, tol: float, *, keys: Sequence[str] = ()) -> DataFrame:
    t, p = as_col(truth), as_col(pred)
    told = t.isNotNull() & (t >= 0)
    both = told & p.isNotNull()
    gap = F.abs(p - t)
    out = rows.groupBy(*keys).agg(
        F.count_if(both).alias("n_both"), F.count_if(told).alias("n_truth"),
        F.avg(F.when(both, gap)).alias("mae"), F.avg(F.when(both, (gap <= tol).cast("double"))).alias("within"))
    return out.withColumn("detection_recall", F.when(F.col("n_truth") > 0, F.col("n_both") / F.col("n_truth")))


def agreement_by(rows: DataFrame, truth, pred, strata: str) -> DataFrame:
    t, p = as_col(truth), F.coalesce(as_col(pred), F.lit(0.0))
    same = ((t >= 0.5) == (p >= 0.5)).cast("double")
    return rows.groupBy(strata).agg(F.count(F.lit(1)).alias("n"), F.count(t).alias("n_reviewed"),
                                    F.avg(F.when(t.isNotNull(), same)).alias("agreement"))
