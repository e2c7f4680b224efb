"""Cohort plans: a user calls one function and gets units (and, where useful, an attrition table)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col
from halfseen.operators import disclosure as dc
from halfseen.operators import features as ft
from halfseen.operators import gamma as gm
from halfseen.operators import notes as nt
from halfseen.operators import outcomes as oc
from halfseen.operators import temporal as tm
from halfseen.operators import validate as vd
from halfseen.operators.lineage import cut
from halfseen.operators.quantile import exact_quantiles
from halfseen.sources.typed import Contract, refuse, require

DAY_SECONDS = 86400.0


def attrition(steps: Mapping[str, DataFrame], subject: str | None = None) -> DataFrame:
    """One row per step: rows, rows dropped since the step before, subjects."""
    rows = []
    for i, (name, df) in enumerate(steps.items()):
        people = F.count_distinct(as_col(subject)) if subject else F.lit(None).cast("bigint")
        rows.append(df.agg(F.lit(i).alias("step"), F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n_after"),
                           people.alias("n_subjects")))
    table = reduce(DataFrame.unionByName, rows)
    before = table.select((F.col("step") + 1).alias("step"), F.col("n_after").alias("n_before"))
    out = table.join(before, "step", "left")
    return out.withColumn("n_before", F.coalesce("n_before", "n_after")).withColumn(
        "n_dropped", F.col("n_before") - F.col("n_after"))


# --- public decision tables -----------------------------------------------------

def custody_days(start, end) -> Column:
    return (tm.micros(end) - tm.micros(start)) / F.lit(1e6 * DAY_SECONDS)


def court_filter(df: DataFrame) -> DataFrame:
    """The published cohort filter: close screening, known recidivism, no ordinary offence, scored."""
    return df.filter((F.abs("days_b_screening_arrest") <= 30) & (F.col("is_recid") != -1)
                     & (F.col("c_charge_degree") != "O") & (F.col("score_text") != "N/A"))


def exposure_outcome(df: DataFrame, window, start="start", end="end", event="event") -> tuple[Column, Column]:
    """(kept, outcome): rearrest within ``window`` days of time at risk."""
    risk, hit = as_col(end) - as_col(start), as_col(event) == 1
    w = as_col(window)
    return (risk >= w) | hit, (hit & (risk <= w)).cast("double")


def court_base(df: DataFrame, *, release_days: float = 2.0, max_custody: float = 180.0,
               published_filter: bool = True) -> DataFrame:
    base = court_filter(df) if published_filter else df
    base = base.withColumn("custody", custody_days("c_jail_in", "c_jail_out"))
    base = base.filter(F.col("custody").isNotNull() & (F.col("custody") <= max_custody))
    return base.withColumn("t", (F.col("custody") <= release_days).cast("int"))


def court_cohort(df: DataFrame, *, numeric: Sequence[str], categorical: Sequence[str], outcome: str = "recorded",
                 recorded: str = "two_year_recid", window: float = 730.0, **kw) -> DataFrame:
    """Release decisions with a recorded or exposure-adjusted outcome and standardised features ``x_*``."""
    base = court_base(df, **kw)
    if outcome == "recorded":
        base = base.withColumn("y", F.col(recorded).cast("double"))
    elif outcome == "exposure_adjusted":
        kept, y = exposure_outcome(base, window)
        base = base.filter(kept).withColumn("y", y)
    else:
        raise ValueError("outcome must be 'recorded' or 'exposure_adjusted'")
    base = base.withColumn("y_obs", F.when(F.col("t") == 1, F.col("y")))
    return feature_block(base, numeric, categorical)


def feature_block(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Numeric columns and drop-first indicators, null as 0, standardised as ``x_*``."""
    have = set(df.columns)
    for c in categorical:
        df = ft.one_hot(df, c)
    dummies = [c for c in df.columns if c not in have]
    cols = [*numeric, *dummies]
    df = df.withColumns({f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}).drop(*dummies)
    return ft.standardise(df, [f"x_{c}" for c in cols])


def time_at_risk_audit(base: DataFrame, windows: Sequence[int], recorded: str = "y") -> DataFrame:
    """Per exposure window: kept shares by decision and the odds ratio; window 0 is the recorded outcome."""
    grid = base.withColumn("window", F.explode(F.array(*[F.lit(int(w)) for w in (0, *windows)])))
    kept, y = exposure_outcome(grid, F.col("window"))
    grid = grid.withColumns({"__k": (F.col("window") == 0) | kept,
                             "__y": F.when(F.col("window") == 0, F.col(recorded).cast("double")).otherwise(y)})
    shares = grid.groupBy("window").agg(
        F.avg(F.col("__k").cast("double")).alias("kept"),
        F.avg(F.when(F.col("t") == 1, F.col("__k").cast("double"))).alias("kept_selected"),
        F.avg(F.when(F.col("t") == 0, F.col("__k").cast("double"))).alias("kept_censored"),
        F.count_if("__k").alias("n_kept"))
    odds = gm.odds_ratio(grid.filter("__k"), "t", "__y", keys=["window"]).select("window", "odds_ratio")
    return shares.join(odds, "window")


def custody_quantiles(base: DataFrame) -> DataFrame:
    q = exact_quantiles(base, {"custody": "custody"}, [0.5, 0.9], keys=["t"])
    return q.select("t", F.col("q0").alias("median"), F.col("q1").alias("q90"), "n")


def card_cohort(df: DataFrame, *, decision: Column, share: str, numeric: Sequence[str],
                categorical: Sequence[str]) -> DataFrame:
    """Accept/reject decisions; the outcome does not exist for the rejected."""
    base = df.withColumn("t", decision.cast("int"))
    return feature_block(ft.median_split(base, share, "t").withColumnRenamed("y", "y_obs"), numeric, categorical)


def loan_features(df: DataFrame, *, numeric: Sequence[str], money: Sequence[str], term: str, employment: str,
                  scale: Mapping[str, float], verification: str, rate: str, grade: str) -> DataFrame:
    """Features ``x_*`` and the underwriter's signal ``s`` kept out of them. Levels, medians and moments each read the rows, which are handed over."""
    df = cut(df)
    years, unknown = ft.ordinal(employment, scale)
    have = set(df.columns)
    out = ft.one_hot(df, verification)
    dummies = [c for c in out.columns if c not in have]
    out = out.withColumns({
        **{f"x_{c}": (ft.log_money(c) if c in money else F.col(c)).cast("double") for c in numeric},
        "x_term": ft.digits(term).cast("double"), "x_employment": years, "x_employment_unknown": unknown,
        **{f"x_{c}": F.col(c) for c in dummies}}).drop(*dummies)
    names = [c for c in out.columns if c.startswith("x_")]
    out = ft.standardise(ft.impute(out, ft.fit_medians(out, names)), names)
    letter, number, _ = ft.letter_grade(grade)
    signal = F.col(rate) + 0.5 * (letter * 5 + F.coalesce(number, F.lit(3)))
    taken = [n for n in names if n.removeprefix("x_") in (rate, grade)]
    if taken:
        raise vd.HiddenSignalLeak(f"the signal's own columns are among the features: {taken}")
    return out.withColumn("s", signal.cast("double"))


def emergency_cohort(stays: DataFrame, tests: DataFrame, diagnoses: DataFrame, *, subject: str, stay: str,
                     arrival: str, complaint: str, words: Sequence[str], age: str, min_age: int, window_hours: float,
                     test_time: str, code: str, prefixes: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Keyword and age filter; T = a test in [-0.5 h, window]; Y = a diagnosis prefix of the stay."""
    text = F.lower(F.coalesce(F.col(complaint), F.lit("")))
    base = stays.filter(text.rlike("|".join(words)) & (F.col(age) >= min_age))
    base = base.withColumn("__from", F.col(arrival) - int(0.5 * tm.HOUR))
    near = tm.asof_join(base, [tm.Lookup(tests, test_time, [], "__test")], subject, "__from", ("forward",))
    base = near.withColumn("t", F.coalesce(F.col("__test.at") <= F.col(arrival) + int(window_hours * tm.HOUR),
                                           F.lit(False)).cast("int")).drop("__test", "__from")
    hit = diagnoses.groupBy(stay).agg(F.max(oc.has_prefix(oc.normalise_code(code), prefixes).cast("double")).alias("__y"))
    base = base.join(hit, stay, "left")
    base = base.withColumn("y_obs", F.when(F.col("t") == 1, F.coalesce("__y", F.lit(0.0)))).drop("__y")
    flags = {f"cc_{w.replace(' ', '_')}": text.contains(w).cast("double") for w in words}
    base = base.withColumns(flags)
    return ft.impute(base, ft.fit_medians(base, numeric))


# --- linked cohort ------------------------------------------------------------------

def linked_cohort(records: DataFrame, studies: DataFrame, *, by: str, ident: str, time: str, study_time: str,
                  study_id: str, window: int, gap: int, units: DataFrame, services: DataFrame | None = None,
                  stays: DataFrame | None = None, pad: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nearest study, coverage, greedy gap, decision maker; returns (units, attrition)."""
    # each later step reads the linked table more than once: hand it over, do not recompute it
    near = cut(tm.nearest_join(records, studies, by=by, time=time, right_time=study_time, right_id=study_id,
                               window=window))
    covered = tm.restrict_to_coverage(near, tm.coverage(studies, study_time), time, window if pad is None else pad)
    spaced = cut(tm.greedy_gap(covered, by=by, ident=ident, time=time, gap=gap))
    out = tm.attach_decision_maker(spaced, units, by=by, time=time, services=services, stays=stays)
    out = out.withColumn("study_time", F.when(F.col("t") == 1, F.col(time) + F.col("gap")))
    steps = attrition({"records": near, "coverage": covered, "min_gap": spaced,
                       "selected": spaced.filter("t = 1")}, by)
    return out, steps


def linked_outcomes(units: DataFrame, *, ident: str, by: str, time: str, notes: DataFrame, note: str,
                    note_stay: str, stays: DataFrame, window: int, measured: DataFrame | None = None,
                    measured_order: Sequence[str] = (), study: str = "nearest_id", codes: DataFrame | None = None,
                    diagnoses: DataFrame | None = None, study_time: str = "study_time") -> DataFrame:
    """Routes a (measured), b (notes) and c (codes); the primary outcome is a if given, else b.

    ``stays(by, stay_id, start, stop)``, ``notes(note, note_stay, text)``.  Notes of stays
    that touch no record are never extracted, the others once; a record's label comes from
    counts of positive and negative notes, so no record-note pairs are built.  A record
    whose study lies inside a stay uses the notes of such stays only.  Units, the spans of
    the notes, the touched notes and the labels are each measured or read by several steps
    and are handed over before, so that none is computed twice.

    ``measured(study_id, composite)`` is joined on the linked study: the first row of a study
    in ``measured_order`` counts, and only selected records get a value.  Route c reads a
    per-record table ``codes``, then ``diagnoses`` of the containing stay.
    """
    wide = cut(units).withColumns({"__lo": F.col(time) - window, "__hi": F.col(time) + window})
    known = stays.filter(F.col("start") <= F.col("stop")).select(by, F.col("stay_id").alias(note_stay), "start", "stop")
    spans = cut(notes.select(note, note_stay).join(known, note_stay).drop(note_stay))
    asked = tm.windowed_counts(spans, wide.select(by, "__lo", "__hi"), by=by, ident=note, start="__lo", end="__hi",
                               windows={"record": ("start", "stop")}, counts={"touched": F.lit(1)})
    touched = cut(notes.select(note, "text").join(asked.filter("touched_record > 0").drop("touched_record"), note))
    read = nt.extract(touched).select(by, note, "start", "stop", "shd_composite")
    labels = tm.windowed_counts(
        wide, cut(read), by=by, ident=ident, start="start", end="stop",
        windows={"window": ("__lo", "__hi"), "contains": (study_time, study_time)},
        counts={"n": F.lit(1), "pos": F.coalesce(F.col("shd_composite") == 1, F.lit(False)),
                "neg": F.coalesce(F.col("shd_composite") == 0, F.lit(False))})
    inside = F.col("n_contains") > 0
    pick = lambda c: F.when(inside, F.col(f"{c}_contains")).otherwise(F.col(f"{c}_window"))
    out = labels.withColumns({
        "note_n": pick("n"), "y_note": F.when(pick("pos") > 0, 1.0).when(pick("neg") > 0, 0.0),
        "note_link": F.when(inside, "contains").when(F.col("n_window") > 0, "window").otherwise("none")})
    out = out.drop("__lo", "__hi", *[f"{c}_{w}" for c in ("n", "pos", "neg") for w in ("window", "contains")])
    if codes is not None or diagnoses is not None:
        out = oc.label_from_codes(cut(out), ident=ident, by=by, time=time, direct=codes,
                                  stays=stays if diagnoses is not None else None, diagnoses=diagnoses)
    if measured is not None:
        one = tm.keep_first(measured.filter("study_id IS NOT NULL"), ["study_id"], list(measured_order) or ["composite"])
        one = one.select(F.col("study_id").alias("__study"), F.col("composite").cast("double").alias("__measured"))
        out = out.join(one, F.col(study) == F.col("__study"), "left")
        out = out.withColumn("y_struct", F.when(F.col("t") == 1, F.col("__measured"))).drop("__study", "__measured")
    primary = F.col("y_struct") if measured is not None else F.col("y_note")
    return out.withColumns({"y_obs": F.when(F.col("t") == 1, primary),
                            "route": F.lit("a_measured" if measured is not None else "b_notes")})


def code_route(units: DataFrame, *, study: str = "nearest_id") -> tuple[DataFrame, DataFrame]:
    """Report of route c, which is auxiliary since codes may follow from the decision: its circularity by selection and by
    having a linked study (a row each), and record counts by (t, source)."""
    split = {"selected": (F.col("t") == 1).cast("int"), "linked": F.col(study).isNotNull().cast("int")}
    rows = [oc.circularity(units.withColumn("__by", by), "y_code", "__by").select(F.lit(n).alias("split"), "*") for n, by in split.items()]
    sources = units.groupBy("t", "code_source").agg(F.count(F.lit(1)).alias("n"), F.count("y_code").alias("n_assessable"))
    return reduce(DataFrame.unionByName, rows), sources


def outcome_recovery(units: DataFrame) -> DataFrame:
    """One row: how many selected records got a primary outcome and why the others did not."""
    chosen, known, noted = F.col("t") == 1, F.col("y_obs").isNotNull(), F.coalesce(F.col("note_n"), F.lit(0)) > 0
    return units.agg(
        F.count_if(chosen).alias("n_selected"), F.count_if(chosen & known).alias("n_labelled"),
        (F.count_if(chosen & known) / F.greatest(F.count_if(chosen), F.lit(1))).alias("recovery_rate"),
        F.avg(F.when(chosen, F.col("y_obs"))).alias("prevalence"), F.count_if(noted).alias("n_with_notes"),
        F.count_if(chosen & F.col("y_note").isNotNull()).alias("n_note_label"),
        F.count_if(chosen & noted & F.col("y_note").isNull()).alias("n_undocumented"),
        F.count_if(chosen & ~noted).alias("n_without_note"),
        *[F.count_if(chosen & (F.col("note_link") == k)).alias(f"link_{k}") for k in ("contains", "window", "none")])


# --- screening ------------------------------------------------------------------------

def first_per_year(exams: DataFrame, subject: str, date: str, tie: str) -> DataFrame:
    year = F.year(F.to_date(F.col(date)))
    dated = exams.withColumn("exam_year", year)
    return tm.keep_first(dated, [subject, "exam_year"], [F.to_date(F.col(date)), tie])


def classifiable(exams: DataFrame, outcome: str, followup: str, window: int) -> DataFrame:
    """Drops units without an event whose follow-up is shorter than the window."""
    gone = (F.coalesce(F.col(outcome), F.lit(0)) != 1) & (F.col(followup) < window)
    return exams.filter(~F.coalesce(gone, F.lit(False)))


def derive_units(exams: DataFrame, *, centre: str, decision: str, outcome: str,
                 covariates: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Units with codes, labels, ``x_*`` (imputed, standardised), ``m_*`` and the standardisation record."""
    raw = cut(exams).withColumns({f"x_{n}": c.cast("double") for n, c in covariates.items()})
    names = [f"x_{n}" for n in covariates]
    medians = ft.fit_medians(raw, names)
    gaps = raw.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).collect()[0].asDict()
    holed = [c for c in names if gaps[c]]
    raw = raw.withColumns({"m_" + c[2:]: F.col(c).isNull().cast("double") for c in holed})
    raw = ft.impute(raw, medians)
    moments = ft.fit_moments(raw, names)
    out = raw.withColumns({c: (F.col(c) - m) / sd for c, (m, sd) in moments.items()})
    codes = out.select(F.col(centre)).distinct().withColumn("z", F.expr(
        f"CAST(row_number() OVER (ORDER BY {centre}) - 1 AS INT)"))       # one row per centre
    out = out.join(codes, centre)
    out = out.withColumns({"t": F.col(decision).cast("int"), "y": F.col(outcome).cast("double"),
                           "y_obs": F.when(F.col(decision) == 1, F.col(outcome).cast("double"))})
    spark = exams.sparkSession
    record = spark.createDataFrame(
        [(c, *moments[c], medians[c], int(gaps[c])) for c in names],
        "feature string, mean double, std double, impute_median double, n_missing bigint")
    return out, record


def screening_counts(raw_n: int, deduped: DataFrame, units: DataFrame, *, centre: str, least: int = dc.MIN_CELL
                     ) -> DataFrame:
    """Published counts (table, level, n, suppressed): totals, by decision, centre, year and centre x decision."""
    one = lambda name, df, level: dc.suppress_partition(
        dc.unit_counts(df.withColumn("__l", F.col(level).cast("string")), ["__l"]), "__l", "n", least=least
    ).select(F.lit(name).alias("table"), F.col("__l").alias("level"), "n", "suppressed")
    totals = attrition({"after_dedup": deduped, "final": units}).select(
        F.lit("total").alias("table"), F.col("rule").alias("level"), F.col("n_after").alias("n"), F.lit(False).alias("suppressed"))
    first = units.sparkSession.createDataFrame([("total", "raw", int(raw_n), False)],
                                               "table string, level string, n bigint, suppressed boolean")
    cross = dc.suppress_table(dc.unit_counts(units, [centre, "t"]), centre, "t", "n", least=least).select(
        F.lit("centre_by_decision").alias("table"), F.concat_ws("/", "row", "col").alias("level"), "n", "suppressed")
    parts = [first, totals, one("decision", units, "t"), one("centre", units, centre), one("year", units, "exam_year"), cross]
    return reduce(DataFrame.unionByName, parts)


def screening_prepare(exams: DataFrame, rules: Mapping[str, Column] | Contract, *, ident: str, subject: str, date: str, centre: str,
                      decision: str, outcome: str, followup: str, window: int, covariates: Mapping[str, Column],
                      least: int = dc.MIN_CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validate, one exam per year, window rule, derive; returns (units, record, published counts).

    Rules are named conditions, or a typed contract whose types the table then takes on.
    """
    if isinstance(rules, Contract):
        exams = require(exams, rules, ident)
    else:
        refuse(vd.violations(exams, rules, ident))
    deduped = first_per_year(exams, subject, date, ident)
    kept = classifiable(deduped, outcome, followup, window)
    units, record = derive_units(kept, centre=centre, decision=decision, outcome=outcome, covariates=covariates)
    counts = screening_counts(exams.count(), deduped, units, centre=centre, least=least)
    return units, record, counts
