"""Contracts, invariants, splits and guards."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halfseen.functions.hashing import SPACE, hash32, unit_interval
from halfseen.functions.scalar import as_col
from halfseen.operators import ranking as rk
from halfseen.operators.joins import match
from halfseen.operators.lineage import cut


class ForbiddenFeature(AssertionError):
    """A feature is, or may be, downstream of the decision."""


class HiddenSignalLeak(AssertionError):
    """The hidden signal can be recovered from the features."""


def selective_violations(units: DataFrame, t="t", y_obs="y_obs") -> DataFrame:
    """One row of counts; all zero for a well-formed selective-label table."""
    t, y = as_col(t), as_col(y_obs)
    return units.agg(
        F.count_if(t.isNull() | ~t.isin(0, 1)).alias("bad_t"),
        F.count_if((t == 1) & y.isNull()).alias("selected_without_y"),
        F.count_if((t == 0) & y.isNotNull()).alias("censored_with_y"))


def require_selective(units: DataFrame, t="t", y_obs="y_obs") -> DataFrame:
    row = selective_violations(units, t, y_obs).collect()[0].asDict()
    if any(row.values()):
        raise ValueError(f"selective-label invariants violated: {row}")
    return units


def describe(units: DataFrame, t="t", y="y", y_obs="y_obs", z=None, d: int = 0) -> DataFrame:
    t, y, yo = as_col(t), as_col(y), as_col(y_obs)
    p1, p0 = F.avg(F.when(t == 1, y)), F.avg(F.when(t == 0, y))
    odds = (p0 / (1.0 - p0)) / (p1 / (1.0 - p1))
    return units.agg(
        F.count(F.lit(1)).alias("n"), F.lit(d).alias("d"), F.avg(t).alias("selection_rate"),
        F.avg(yo).alias("observed_prevalence"), F.avg(y).alias("true_prevalence"),
        p0.alias("censored_prevalence"), odds.alias("odds_ratio"),
        (F.count_distinct(as_col(z)) if z is not None else F.lit(0)).alias("n_decision_makers"))


# --- splits -----------------------------------------------------------------

def split(ident, test_share: float, salt) -> Column:
    """'test' or 'train' from a hash of the id."""
    return F.when(unit_interval(ident, salt) < test_share, "test").otherwise("train")


def split_exact(units: DataFrame, ident: str, test_share: float, salt, name: str = "side") -> DataFrame:
    """Units with 'test' for exactly round(share * n) of them, those first in hash order."""
    n = units.count()
    placed = hash_position(units, [], ident, salt, "__pos")
    side = F.when(F.col("__pos") < int(n * test_share + 0.5), "test").otherwise("train")
    return placed.withColumn(name, side).drop("__pos")


def three_way(ident, salt) -> Column:
    u = unit_interval(ident, salt)
    return F.when(u < 0.5, "train").when(u < 0.75, "calibration").otherwise("test")


def hash_position(units: DataFrame, strata: Sequence[str], ident: str, salt, name: str) -> DataFrame:
    """Zero-based position within a stratum in hash order, without a task per stratum.

    The hash range is cut into as many blocks as there are shuffle partitions; block
    sizes give the offsets.
    """
    blocks = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = units.withColumn("__h", hash32(ident, salt))
    rows = rows.withColumn("__b", F.floor(F.col("__h") * blocks / SPACE))
    sizes = rows.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", ident)) - 1
    return (match(rows.withColumn(name, inside), sizes, [*strata, "__b"])
            .withColumn(name, (F.col(name) + F.col("__o")).cast("bigint")).drop("__h", "__b", "__o"))


def stratified_folds(units: DataFrame, strata: Sequence[str], ident: str, k: int, salt) -> DataFrame:
    """Folds of equal size in every stratum. The rows are read twice, so they are handed over, not computed, for it:
    folds of folds would double the work with every level."""
    out = hash_position(cut(units), strata, ident, salt, "__pos")
    return out.withColumn("fold", (F.col("__pos") % k).cast("int")).drop("__pos")


def subject_split(units: DataFrame, subject: str, *, t="t", y="y", test_share: float = 0.3, seed: int = 0,
                  tries: int = 10) -> tuple[DataFrame, str]:
    """All rows of a subject on one side; salts are redrawn until both classes occur.

    The test side needs both decisions, the training side both selected outcomes.
    """
    t_c, y_c = as_col(t), as_col(y)
    for i in range(tries):
        salt = f"subject/{seed}/{i}"
        sided = units.withColumn("side", split(subject, test_share, salt))
        ok = sided.agg(
            F.count_distinct(F.when(F.col("side") == "test", t_c)).alias("a"),
            F.count_distinct(F.when((F.col("side") == "train") & (t_c == 1), y_c)).alias("b")).collect()[0]
        if ok["a"] == 2 and ok["b"] == 2:
            return sided, salt
    raise ValueError(f"no usable subject split in {tries} tries")


# --- rules ------------------------------------------------------------------

def violations(rows: DataFrame, rules: Mapping[str, Column], ident: str, examples: int = 5) -> DataFrame:
    """Per violated rule: number of rows and the first ids.  One pass over the table."""
    failing = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    bad = rows.select(ident, F.explode(F.filter(failing, lambda r: r.isNotNull())).alias("rule"))
    bad = cut(bad)                   # read twice: ids of violations are handed over, the rules are judged once
    counts = bad.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    # row_number with a limit is cut per partition before the shuffle
    first = (bad.withColumn("__k", F.row_number().over(Window.partitionBy("rule").orderBy(ident)))
             .filter(F.col("__k") <= examples)
             .groupBy("rule").agg(F.sort_array(F.collect_list(ident)).alias("first_ids")))
    return counts.join(first, "rule")


def in_range(col, lo, hi) -> Column:
    """True where a value is present and outside the range."""
    c = as_col(col)
    return c.isNotNull() & ((c < lo) | (c > hi))


def bad_date_format(col) -> Column:
    c = as_col(col)
    return c.isNull() | ~c.rlike(r"^\d{4}-\d{2}-\d{2}$")


def bad_calendar_date(col) -> Column:
    c = as_col(col)
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNull()


# --- guards -----------------------------------------------------------------

# Name patterns of columns that may lie downstream of the decision.
FORBIDDEN = (
    r"^(y|t|z)(_|$)",
    r"^(y|t|z)_(obs|hat|pred|true|note|icd|echo|struct|source)",
    r"^(outcome|label|target|decision|treat|treated|selected|censor)",
    r"^(z_source|careunit|curr_service|prev_service|admission_location)$",
    r"^(study_id|hadm_id|stay_id|note_id|transfer_id|specimen_id)$",
    r"echo", r"lvef", r"ejection", r"ivsd", r"lvpwd", r"wall_thick", r"valve",
    r"\bshd\b", r"^shd", r"_shd", r"dicom", r"study_datetime", r"nearest_echo", r"days_to",
    r"icd", r"discharge", r"note_", r"^(dod|deathtime|dischtime|outtime)$",
)


def forbidden_pattern(name: str, patterns: Sequence[str] = FORBIDDEN) -> str | None:
    return next((p for p in patterns if re.search(p, name, re.IGNORECASE)), None)


def refuse_forbidden(names: Iterable[str], patterns: Sequence[str] = FORBIDDEN) -> None:
    bad = {n: p for n in names if (p := forbidden_pattern(n, patterns))}
    if bad:
        raise ForbiddenFeature(f"features downstream of the decision: {bad}")


def correlations(units: DataFrame, features: Sequence[str], signal: str) -> DataFrame:
    """Per feature: Pearson and Spearman correlation with the signal."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    base = rk.midrank(units.select(F.col(signal).cast("double").alias("s"), *features), "s", name="rs")
    long = base.select("s", "rs", F.inline(pairs))
    long = rk.midrank(long, "x", keys=["feature"], name="rx")
    return long.groupBy("feature").agg(F.corr("x", "s").alias("pearson"), F.corr("rx", "rs").alias("spearman"))


def gram(units: DataFrame, features: Sequence[str], target=None, weight=None) -> tuple[np.ndarray, np.ndarray, float]:
    """``(X'WX, X'Wy, y'Wy)`` with an intercept first: one aggregate of d^2 / 2 sums."""
    w = F.lit(1.0) if weight is None else as_col(weight)
    cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
    y = F.lit(0.0) if target is None else as_col(target).cast("double")
    d = len(cols)
    terms = [F.sum(w * cols[i] * cols[j]) for i in range(d) for j in range(i, d)]
    terms += [F.sum(w * c * y) for c in cols] + [F.sum(w * y * y)]
    row = [float(v or 0.0) for v in units.agg(*[c.alias(f"s{i}") for i, c in enumerate(terms)]).collect()[0]]
    xx, it = np.zeros((d, d)), iter(row)
    for i in range(d):
        for j in range(i, d):
            xx[i, j] = xx[j, i] = next(it)
    xy = np.array([next(it) for _ in range(d)])
    return xx, xy, next(it)


def linear_r2(units: DataFrame, features: Sequence[str], signal: str) -> float:
    xx, xy, yy = gram(units, features, signal)
    n = xx[0, 0]
    sd = np.sqrt(np.maximum(np.diag(xx) / n, 1e-300))
    beta = np.linalg.lstsq(xx / np.outer(sd, sd), xy / sd, rcond=1e-12)[0] / sd
    total = yy - xy[0] ** 2 / n
    return float(1.0 - (yy - 2 * beta @ xy + beta @ xx @ beta) / total) if total > 0 else 0.0


def refuse_hidden_signal(units: DataFrame, features: Sequence[str], signal: str, limit: float = 0.95) -> None:
    """No feature may carry the signal by name, by correlation or jointly."""
    named = [f for f in features if signal.lower() in f.lower()]
    if named:
        raise HiddenSignalLeak(f"features named after the signal: {named}")
    near = (correlations(units, features, signal)
            .filter((F.abs("pearson") >= limit) | (F.abs("spearman") >= limit)).collect())
    if near:
        raise HiddenSignalLeak(f"features that copy the signal: {[r['feature'] for r in near]}")
    r2 = linear_r2(units, features, signal)
    if r2 >= limit:
        raise HiddenSignalLeak(f"features determine the signal jointly (R2 = {r2:.3f})")


def refuse_unit_level(out: DataFrame, id_columns: Sequence[str], most: int = 64) -> DataFrame:
    """Published tables hold no ids, no long arrays and not more than ``most`` rows."""
    ids = [c for c in out.columns if c.lower() in {i.lower() for i in id_columns}]
    if ids:
        raise AssertionError(f"unit identifiers in an aggregate: {ids}")
    def sizes(col: Column, kind: T.DataType) -> list[Column]:
        """Lengths of the arrays and maps of a column, also inside structs and arrays."""
        if isinstance(kind, T.StructType):
            return [s for f in kind.fields for s in sizes(col[f.name], f.dataType)]
        if isinstance(kind, T.MapType):
            return [F.size(col)]
        if not isinstance(kind, T.ArrayType):
            return []
        longest = lambda i: F.array_max(F.transform(col, lambda x: sizes(x, kind.elementType)[i]))
        return [F.size(col), *map(longest, range(len(sizes(F.col("x"), kind.elementType))))]

    found = [F.coalesce(s, F.lit(0)) for f in out.schema.fields for s in sizes(F.col(f"`{f.name}`"), f.dataType)]
    if found:
        longest = out.agg(F.max(F.greatest(*found, F.lit(0), F.lit(0)))).collect()[0][0] or 0
        if longest > most:
            raise AssertionError(f"arrays longer than {most} in an aggregate")
    if out.limit(most + 1).count() > most:
        raise AssertionError(f"more than {most} rows in an aggregate")
    return out
