"""Feature building.  Fitted parameters are one small row each; applying them is a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col
from halfseen.operators.quantile import exact_quantiles
from halfseen.operators.temporal import HOUR, Lookup, asof_join
from halfseen.operators.validate import refuse_forbidden


def fit_moments(df: DataFrame, columns: Sequence[str], floor: float = 1e-9) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where degenerate) of each column, from one row."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    row = stats.collect()[0]
    out = {}
    for c in columns:
        mean, sd = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0
        out[c] = (float(mean), float(sd) if sd > floor else 1.0)
    return out


def standardise(df: DataFrame, columns: Sequence[str], ref: DataFrame | None = None, prefix: str = "") -> DataFrame:
    fit = fit_moments(ref if ref is not None else df, columns)
    return df.withColumns({f"{prefix}{c}": (F.col(c) - m) / sd for c, (m, sd) in fit.items()})


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; an all-null column gets 0."""
    rows = exact_quantiles(df, {c: c for c in columns}, [0.5]).collect()
    found = {r["name"]: float(r["q0"]) for r in rows}
    return {c: found.get(c, 0.0) for c in columns}


def impute(df: DataFrame, medians: Mapping[str, float], flag_prefix: str | None = None) -> DataFrame:
    flags = {f"{flag_prefix}{c}": F.col(c).isNull().cast("double") for c in medians} if flag_prefix else {}
    return df.withColumns({**flags, **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in medians.items()}})


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None, drop_first: bool = True,
            most: int = 256) -> DataFrame:
    """0/1 columns for the sorted levels (all but the first).  Levels are few by meaning."""
    if levels is None:
        found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{column} has more than {most} levels; merge rare levels first")
        levels = sorted(r[0] for r in found)
    keep = levels[1:] if drop_first else levels
    name = lambda v: f"{column}_{v}".replace(" ", "_").replace(".", "_")
    return df.withColumns({name(v): (F.col(column) == v).cast("double") for v in keep})


def log_money(x) -> Column:
    return F.log1p(F.greatest(as_col(x), F.lit(0.0)))


def ordinal(x, scale: Mapping[str, float]) -> tuple[Column, Column]:
    """Mapped value (null if unknown) and the unknown flag."""
    c = as_col(x)
    table = F.create_map(*[F.lit(v) for kv in scale.items() for v in kv])
    value = F.try_element_at(table, c)
    return value, value.isNull().cast("double")


def digits(x) -> Column:
    return F.regexp_extract(as_col(x), r"(\d+)", 1).try_cast("int")


def letter_grade(x, letters: str = "ABCDEFG") -> tuple[Column, Column, Column]:
    """Letter index, number and their combined order of labels like ``C4``."""
    c = as_col(x)
    letter = F.instr(F.lit(letters), F.upper(F.substring(c, 1, 1))) - 1
    number = F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    return letter, number, letter * 5 + number


def demographics(records: DataFrame, patients: DataFrame, *, subject: str, ts: str) -> DataFrame:
    """Age at the record and sex flag; subjects without a patient row get nulls."""
    sex = F.upper(F.trim("gender"))
    pt = patients.select(subject, "anchor_age", "anchor_year", sex.alias("__sex"))
    out = records.join(pt, subject, "left")
    return out.withColumns({
        "age_at_record": F.col("anchor_age") + F.year(ts) - F.col("anchor_year"),
        "sex_male": F.when(F.col("__sex") == "M", 1.0).when(F.col("__sex") == "F", 0.0),
    }).drop("anchor_age", "anchor_year", "__sex")


# Analyte -> (pattern on the lower-cased label, required fluid).
ANALYTES = {
    "troponin": (r"troponin", "blood"),
    "bnp": (r"(^|[^a-z])bnp([^a-z]|$)|ntprobnp|nt-probnp|natriuretic", "blood"),
    "creatinine": (r"^creatinine(\s*,\s*whole blood)?$", "blood"),
    "hemoglobin": (r"^hemoglobin$", "blood"),
}


def resolve_items(dictionary: DataFrame, analytes: Mapping[str, tuple[str, str | None]] = ANALYTES, *,
                  item: str = "itemid", label: str = "label", fluid: str = "fluid",
                  strict: bool = True) -> DataFrame:
    """(analyte, item) pairs of the dictionary rows that match pattern and fluid."""
    text, kind = F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))), F.lower(F.trim(F.col(fluid)))
    hits = F.array(*[F.when(text.rlike(p) & (F.lit(True) if f is None else F.coalesce(kind == f, F.lit(False))),
                            F.lit(a)) for a, (p, f) in analytes.items()])
    out = dictionary.select(F.explode(F.filter(hits, lambda a: a.isNotNull())).alias("analyte"), F.col(item))
    out = out.distinct()
    if strict:
        found = {r[0] for r in out.select("analyte").distinct().collect()}
        missing = [a for a in analytes if a not in found]
        if missing:
            raise ValueError(f"analytes resolve to no item: {missing}")
    return out


def latest_values(records: DataFrame, events: DataFrame, *, by: str, time: str, event_time: str, kind: str,
                  value: str, kinds: Sequence[str], hours: float, prefix: str = "lab_") -> DataFrame:
    """Last value of each kind in [t - hours, t] with a missing flag; all kinds in one pass."""
    ok = events.filter(F.col(value).isNotNull())
    looks = [Lookup(ok.filter(F.col(kind) == k), event_time, [value], f"__k{i}", tie=value,
                    tolerance=int(hours * HOUR)) for i, k in enumerate(kinds)]
    out = asof_join(records, looks, by, time)
    new = {}
    for i, k in enumerate(kinds):
        v = F.col(f"__k{i}.{value}")
        new[f"{prefix}{k}"] = v
        new[f"{prefix}{k}_missing"] = v.isNull().cast("double")
    return out.withColumns(new).drop(*[look.name for look in looks])


def care_setting(records: DataFrame, emergency: DataFrame, stays: DataFrame, *, by: str, time: str) -> DataFrame:
    """Exactly one of ``setting_ed``, ``setting_inpatient``, ``setting_outpatient`` is 1.

    Both tables have ``start`` and ``stop`` (null = ongoing); only the latest-started
    row is tested and the emergency stay wins.
    """
    looks = [Lookup(emergency, "start", ["stop"], "__e"), Lookup(stays, "start", ["stop"], "__a")]
    out = asof_join(records, looks, by, time)
    t = F.col(time)
    active = lambda n: F.coalesce(F.col(n).isNotNull() & (F.col(f"{n}.stop").isNull() | (t <= F.col(f"{n}.stop"))),
                                  F.lit(False))
    ed, inn = active("__e"), active("__a")
    return out.withColumns({
        "setting_ed": ed.cast("double"), "setting_inpatient": (inn & ~ed).cast("double"),
        "setting_outpatient": (~ed & ~inn).cast("double")}).drop("__e", "__a")


# Plausible inclusive ranges (intervals in ms, axes in degrees).
PLAUSIBLE = {
    "ecg_rr": (200.0, 3000.0), "ecg_pr": (40.0, 500.0), "ecg_qrs": (20.0, 300.0), "ecg_qt": (100.0, 800.0),
    "ecg_qtc": (100.0, 1000.0), "ecg_p_axis": (-180.0, 360.0), "ecg_qrs_axis": (-180.0, 360.0),
    "ecg_t_axis": (-180.0, 360.0),
}


def plausible(x, lo: float, hi: float) -> Column:
    c = as_col(x)
    return F.when(c.between(lo, hi), c)


def interval_features(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = PLAUSIBLE) -> DataFrame:
    """Differences of fiducial marks, rate-corrected QT, and range checks."""
    raw = {"ecg_rr": F.col("rr_interval"), "ecg_pr": F.col("qrs_onset") - F.col("p_onset"),
           "ecg_qrs": F.col("qrs_end") - F.col("qrs_onset"), "ecg_qt": F.col("t_end") - F.col("qrs_onset"),
           "ecg_p_axis": F.col("p_axis"), "ecg_qrs_axis": F.col("qrs_axis"), "ecg_t_axis": F.col("t_axis")}
    out = df.withColumns({n: plausible(c.cast("double"), *ranges[n]) for n, c in raw.items()})
    qtc = F.col("ecg_qt") / F.sqrt(F.col("ecg_rr") / 1000.0)
    return out.withColumn("ecg_qtc", plausible(qtc, *ranges["ecg_qtc"]))


def assemble(units: DataFrame, blocks: Mapping[str, DataFrame], ident: str, train=None) -> DataFrame:
    """All feature blocks on the units: unique names, numeric, guarded, imputed on training rows."""
    names: list[str] = []
    out = units
    for block, df in blocks.items():
        cols = [c for c in df.columns if c != ident]
        twice = set(cols) & set(names)
        if twice:
            raise ValueError(f"block {block!r} repeats columns {sorted(twice)}")
        bad = [f.name for f in df.schema.fields if f.name in cols and f.dataType.typeName() in ("string", "struct", "array", "map")]
        if bad:
            raise TypeError(f"block {block!r} has non-numeric columns {bad}")
        names += cols
        out = out.join(df, ident, "left")
    refuse_forbidden(names)
    fit = out if train is None else out.filter(train)
    return impute(out, fit_medians(fit, names))


def block_profile(df: DataFrame, ident: str) -> DataFrame:
    """Per column: rows and missing share, in one pass."""
    cols = [c for c in df.columns if c != ident]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])
    return one.select("n", F.inline(pairs))


def available_blocks(builders: Mapping[str, tuple[Sequence[str], object]], inputs: Mapping[str, DataFrame]) -> dict:
    """Every block all of whose input tables exist."""
    return {name: build(*[inputs[i] for i in needs]) for name, (needs, build) in builders.items()
            if all(i in inputs for i in needs)}


def vector_columns(df: DataFrame, vector: str, size: int, prefix: str = "emb_") -> DataFrame:
    return df.withColumns({f"{prefix}{i}": F.get(F.col(vector), F.lit(i)).cast("double") for i in range(size)})


def median_split(df: DataFrame, value: str, selected) -> DataFrame:
    """``y``: value above its median among the selected; unknown for the others."""
    sel = selected if isinstance(selected, Column) else F.col(selected) == 1
    cut = fit_medians(df.filter(sel), [value])[value]
    return df.withColumn("y", F.when(sel, (F.col(value) > cut).cast("double")))
