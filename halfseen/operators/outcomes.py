"""Outcome labels from measurements, codes and linked notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col, wilson
from halfseen.operators.temporal import first_containing, keep_first

# Grade words and their ranks.
GRADE_WORDS = (
    r"(moderate[- ]to[- ]severe|mod(?:erate)?[-/]severe|moderately\s+severe|severe|critical|moderate|"
    r"mild[- ]to[- ]moderate|mild|trivial|trace|none|absent|large|small|normal|reduced|depressed)")
GRADE_RANKS = {
    "none": 0.0, "absent": 0.0, "normal": 0.0, "trivial": 1.0, "trace": 1.0, "small": 1.0, "mild": 2.0,
    "mild to moderate": 2.0, "reduced": 2.0, "depressed": 2.0, "moderate": 3.0, "moderate to severe": 3.5,
    "mod severe": 3.5, "moderately severe": 3.5, "severe": 4.0, "critical": 4.0, "large": 4.0,
}


def grade_rank(x) -> Column:
    """Text grade or 0-4 number (as text) to a rank; null if unknown.

    A bare number keeps its value, so a numeric 2 stays below the cut at 3.
    """
    s = F.lower(F.trim(as_col(x).cast("string")))
    number = F.when(s.rlike(r"^[0-4](\.0+)?\+?$"), F.regexp_extract(s, r"^([0-4])", 1).cast("double"))
    decimal = F.when(s.rlike(r"^[0-9.]+$") & s.try_cast("double").between(0.0, 4.0), s.try_cast("double"))
    word = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, GRADE_WORDS, 1), "[-/]", " "), r"\s+", " ")
    table = F.create_map(*[F.lit(v) for kv in GRADE_RANKS.items() for v in kv])
    return F.coalesce(number, decimal, F.try_element_at(table, word))


# Component -> (measurement, rule, threshold).
COMPONENTS = {
    "lvef_lte_45": ("lvef", "le", 45.0),
    "lvwt_gte_13": ("lvwt", "ge", 1.3),
    "aortic_stenosis_moderate_severe": ("as_grade", "grade", 3.0),
    "aortic_regurgitation_moderate_severe": ("ar_grade", "grade", 3.0),
    "mitral_regurgitation_moderate_severe": ("mr_grade", "grade", 3.0),
    "tricuspid_regurgitation_moderate_severe": ("tr_grade", "grade", 3.0),
    "pulmonary_regurgitation_moderate_severe": ("pr_grade", "grade", 3.0),
    "rv_systolic_dysfunction_moderate_severe": ("rv_function_grade", "grade", 3.0),
    "pericardial_effusion_moderate_large": ("pericardial_effusion_grade", "grade", 3.0),
    "pasp_gte_45": ("pasp", "ge", 45.0),
    "tr_max_gte_32": ("tr_vmax", "ge", 3.2),
}


def composite(df: DataFrame, columns: dict[str, str], components: dict = COMPONENTS) -> DataFrame:
    """Component flags (null where not measured), ``composite`` and ``n_evaluated``.

    ``columns`` maps measurement names to columns; fractions of EF become percent and
    wall thickness in mm becomes cm.
    """
    num = lambda m: F.col(columns[m]).try_cast("double") if m in columns else F.lit(None).cast("double")
    ef = num("lvef")
    wall = F.greatest(num("ivsd"), num("lvpwd"), num("lvwt"))
    ready = {"lvef": F.when(ef > 1.0, ef).otherwise(ef * 100.0),
             "lvwt": F.when(wall <= 5.0, wall).otherwise(wall / 10.0)}
    flags = {}
    for name, (m, rule, cut) in components.items():
        if rule == "grade":
            rank = grade_rank(columns[m]) if m in columns else F.lit(None).cast("double")
            flags[name] = (rank >= cut).cast("double")
        else:
            v = ready.get(m, num(m))
            flags[name] = ((v <= cut) if rule == "le" else (v >= cut)).cast("double")
    out = df.withColumns(flags)
    every = F.array(*[F.col(n) for n in flags])
    # greatest ignores nulls: 1 if any is 1, 0 if some are known, null otherwise
    return out.withColumns({"composite": F.greatest(*flags) if len(flags) > 1 else F.col(next(iter(flags))),
                            "n_evaluated": F.size(F.filter(every, lambda x: x.isNotNull()))})


def or_known(*parts) -> Column:
    """1 if any part is true, 0 if none is true and one is known false, else null."""
    cols = [as_col(p).cast("int") for p in parts]
    return F.greatest(*cols)


# --- codes ------------------------------------------------------------------

# Code prefixes that count as the outcome.
CODE_PREFIXES = ("I50", "I42", "I34", "I35", "I36", "I37", "I05", "I06", "I07", "I08", "I110", "I255")


def normalise_code(x) -> Column:
    return F.upper(F.regexp_replace(as_col(x), r"[.\s]", ""))


def parse_codes(x) -> Column:
    """List string such as ``"[np.str_('R079'), 'I255']"`` to an array of normalised codes."""
    quoted = F.regexp_extract_all(as_col(x), F.lit(r"'([^']*)'"), F.lit(1))
    loose = F.regexp_extract_all(as_col(x), F.lit(r"([A-Za-z]\d[0-9A-Za-z.]*)"), F.lit(1))
    plain_list = as_col(x).rlike(r"^\s*[\[(]\s*('[^']*'\s*,?\s*)*[\])]\s*$")
    return F.transform(F.coalesce(F.when(plain_list, quoted).otherwise(loose), F.array().cast("array<string>")),
                       lambda c: normalise_code(c))


def has_prefix(code, prefixes: Sequence[str] = CODE_PREFIXES) -> Column:
    c = as_col(code)
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def matching_codes(codes, prefixes: Sequence[str] = CODE_PREFIXES) -> Column:
    return F.filter(as_col(codes), lambda c: has_prefix(c, prefixes))


def label_from_codes(records: DataFrame, *, ident: str, by: str, time: str, direct: DataFrame | None = None,
                     stays: DataFrame | None = None, diagnoses: DataFrame | None = None,
                     prefixes: Sequence[str] = CODE_PREFIXES) -> DataFrame:
    """``y_code``, ``code_source``, ``code_matched``: per-record table first, then the containing stay.

    ``direct(ident, codes)`` holds list strings, ``stays(by, stay_id, start, stop)``,
    ``diagnoses(stay_id, code, version)``.  A stay with old-version codes only is not
    assessable.
    """
    if direct is None and (stays is None or diagnoses is None):
        raise ValueError("needs a per-record table, or stays together with diagnoses")
    # the stay first: its join measures the records, which must not run the other joins for that
    by_stay = stays is not None and diagnoses is not None
    out = first_containing(records, stays, by=by, time=time, start="start", end="stop", ident="stay_id") if by_stay else records
    if direct is not None:
        hit = matching_codes(parse_codes("codes"), prefixes)
        one = keep_first(direct, [ident], ["codes"]).select(ident, F.array_join(hit, ";").alias("__hit"))
        out = out.join(one, ident, "left")
    else:
        out = out.withColumn("__hit", F.lit(None).cast("string"))
    if by_stay:
        new = F.col("version") == 10
        coded = diagnoses.withColumn("__code", normalise_code("code")).select(       # once a row, not once a prefix
            "stay_id", new.cast("int").alias("__new"), F.when(new & has_prefix("__code", prefixes), F.col("__code")).alias("__code"))
        per_stay = coded.groupBy("stay_id").agg(
            F.array_join(F.sort_array(F.collect_set("__code")), ";").alias("__dx"), F.max("__new").alias("__new"))
        out = out.join(per_stay.withColumnRenamed("stay_id", "span_id"), "span_id", "left")
    else:
        out = out.withColumns({"span_id": F.lit(None).cast("bigint"), "__dx": F.lit(None).cast("string"),
                               "__new": F.lit(None).cast("int")})
    listed, stay = F.col("__hit").isNotNull(), F.col("span_id").isNotNull()
    only_old = stay & (F.col("__new") == 0)
    hits = F.when(listed, F.col("__hit")).when(stay & ~F.coalesce(only_old, F.lit(False)), F.coalesce("__dx", F.lit("")))
    return out.withColumns({
        "code_source": F.when(listed, "record_table").when(F.coalesce(only_old, F.lit(False)), "stay_old_codes_only")
        .when(stay, "stay").otherwise("none"),
        "code_matched": F.coalesce(hits, F.lit("")), "y_code": (F.length(hits) > 0).cast("double"),
    }).drop("__hit", "__dx", "__new", "span_id")


def circularity(units: DataFrame, y: str, split: str) -> DataFrame:
    """Rates by a 0/1 column with Wilson limits, their ratio and difference: one row."""
    y_c, g = F.col(y), F.col(split).cast("int")
    cells = units.agg(
        F.count(F.lit(1)).alias("n"), F.count(y_c).alias("n_assessable"),
        *[F.count(F.when(g == v, y_c)).alias(f"n{v}") for v in (0, 1)],
        *[F.coalesce(F.sum(F.when(g == v, y_c)), F.lit(0.0)).cast("bigint").alias(f"k{v}") for v in (0, 1)])
    new = {}
    for v in (0, 1):
        lo, hi = wilson(f"k{v}", f"n{v}")
        new |= {f"rate{v}": F.when(F.col(f"n{v}") > 0, F.col(f"k{v}") / F.col(f"n{v}")), f"lo{v}": lo, f"hi{v}": hi}
    out = cells.withColumns(new)
    return out.withColumns({
        "risk_ratio": F.when(F.col("rate0") > 0, F.col("rate1") / F.col("rate0")),
        "risk_difference": F.col("rate1") - F.col("rate0")})


def label_from_notes(links: DataFrame, notes: DataFrame, *, record: str, note: str) -> DataFrame:
    """Per record over its linked notes: any positive, best note, sorted ids.

    ``links(record, note, kind)`` comes from an overlap join; ``notes(note, shd,
    confidence, fields, lvef, wall)`` was extracted once per distinct note.  Records with
    a link of kind 'contains' use only those.
    """
    best_kind = links.groupBy(record).agg(F.max((F.col("kind") == "contains").cast("int")).alias("__has"))
    use = links.join(best_kind, record).filter((F.col("__has") == 0) | (F.col("kind") == "contains"))
    both = use.join(notes, note)
    rank = F.struct(F.col("confidence"), F.col("fields"), F.col(note))
    return both.groupBy(record).agg(
        F.max("shd").cast("double").alias("y_note"), F.max_by("lvef", rank).alias("note_lvef"),
        F.max_by("wall", rank).alias("note_wall_cm"), F.max("confidence").alias("note_confidence"),
        F.count(F.lit(1)).alias("note_n"),
        F.array_join(F.sort_array(F.collect_set(F.col(note).cast("string"))), ";").alias("note_ids"),
        F.when(F.max("__has") == 1, "contains").otherwise("window").alias("note_link"))
