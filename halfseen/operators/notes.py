"""One extraction record per note, as a chain of projections over the notes table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions import notes as nt
from halfseen.operators.cell_join import match_cells
from halfseen.operators.lineage import cut, spread
from halfseen.operators.outcomes import or_known


REPEATS = 2               # notes per distinct text from which equal texts are read once


def extract(notes: DataFrame, text: str = "text") -> DataFrame:
    """Adds the record columns: EF, wall, lesions, components, composite, confidence, fields.

    Where texts repeat (templates, copied notes; counted first) each distinct text is read
    once and its record handed over and joined to its notes.  The distinct texts are handed
    over before: planning how to spread them would run what they come from.
    """
    n, different = notes.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(text))).first()
    if n < REPEATS * max(different, 1):
        return _read(notes, text)
    records = cut(_read(cut(notes.select(text).distinct()), text))
    return match_cells(notes.drop(*[c for c in records.columns if c != text]), records, [text], "left", handed=True)


def _read(notes: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    out = spread(notes).withColumns({"ef_all": nt.ef_numeric(t), "wall": nt.wall_mentions(t),
                             "lvh": nt.hypertrophy(t), "lesions": nt.valve_lesions(t),
                             "echo_context": t.rlike(nt.CONTEXT)})
    out = out.withColumn("ef_words", nt.ef_qualitative(t, "ef_all"))
    out = out.withColumns({"ef": nt.pick_primary("ef_all"), "ef_word": nt.pick_primary("ef_words")})
    out = out.withColumn("ef_word", F.when(F.col("ef").isNull(), F.col("ef_word")))
    cm = lambda site: F.array_max(F.transform(
        F.filter("wall", lambda w: F.lit(True) if site is None else w["site"] == site), lambda w: w["cm"]))
    bad = F.filter("lesions", lambda x: x["ge_moderate"] & ~x["negated"])
    out = out.withColumns({
        "lvef": F.col("ef.value"), "lvef_comparator": F.col("ef.comparator"), "lvef_qualitative": F.col("ef_word.word"),
        "lvef_evidence": F.coalesce("ef.evidence", "ef_word.evidence"),
        "wall_thickness_cm": cm(None), "septal_cm": cm("septal"), "posterior_cm": cm("posterior"),
        "lvh_qualitative": F.col("lvh.word"), "lvh_negated": F.col("lvh.negated"),
        "valve_evidence": F.transform(bad, lambda x: x["evidence"]),
        "n_bad": F.size(bad), "n_lesions": F.size("lesions"),
        "any_negated": F.exists("lesions", lambda x: x["negated"])})
    best_wall = F.array_max(F.transform("wall", lambda w: F.struct(w["cm"], -w["pos"], w["evidence"])))
    out = out.withColumns({
        "wall_evidence": F.coalesce(best_wall["evidence"], F.col("lvh.evidence")),
        "lvef_le_45": nt.ef_component(F.col("ef"), F.col("ef_word.word"), F.col("ef_word.negated")),
        "wall_ge_1p3": F.when(F.col("wall_thickness_cm").isNotNull(), F.col("wall_thickness_cm") >= nt.THICK_WALL_CM)
        .when(F.col("lvh_negated"), F.lit(False))
        .when(F.col("lvh_qualitative").isin("moderate", "severe"), F.lit(True)),
        "valve_moderate_or_severe": F.when(F.col("n_bad") > 0, F.lit(True)).when(F.col("n_lesions") > 0, F.lit(False))})
    return _score(out).drop("n_bad", "any_negated", "lvh")


def _score(out: DataFrame) -> DataFrame:
    """Heuristic confidence in [0, 1] and the number of fields found."""
    has_ef = F.col("ef").isNotNull() | F.col("ef_word").isNotNull()
    values = F.transform(F.filter("ef_all", lambda f: ~f["historical"]), lambda f: f["value"])
    every = F.transform("ef_all", lambda f: f["value"])
    values = F.when(F.size(values) > 0, values).otherwise(every)
    straddle = (F.array_min(values) <= nt.LOW_EF) & (F.array_max(values) > nt.LOW_EF)
    add = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(0.0)
    ef, word = F.col("ef").isNotNull(), F.col("ef_word").isNotNull()
    wall, lvh = F.col("wall_thickness_cm").isNotNull(), F.col("lvh_qualitative").isNotNull()
    lesion = F.col("n_lesions") > 0
    conf = (add(ef, 0.35) + add(word, 0.2) - add(ef & straddle, 0.2)
            - add(ef & F.col("lvef_comparator").isNotNull() & F.col("lvef_le_45").isNull(), 0.1)
            - add(word & (F.col("lvef_qualitative") == "reduced"), 0.1)
            + add(wall, 0.2) + add(~wall & lvh, 0.1) + add(lesion, 0.25) - add(lesion & F.col("any_negated"), 0.05)
            + add(F.col("echo_context"), 0.2))
    fields = has_ef.cast("int") + (wall | lvh).cast("int") + lesion.cast("int")
    return out.withColumns({
        "n_fields_found": fields,
        "confidence": F.when(fields > 0, F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))).otherwise(0.0),
        "shd_composite": or_known("lvef_le_45", "wall_ge_1p3", "valve_moderate_or_severe")})


# Fields and accepted words of a structured answer.
ANSWER_SCHEMA = ("lvef string, lvef_qualitative string, wall_thickness_cm string, lvh_qualitative string, "
                 "valve_lesions array<struct<valve: string, severity: string, negated: string, evidence: string>>, "
                 "evidence struct<lvef: string, wall: string>")
EF_WORDS = ("normal", "mildly_reduced", "moderately_reduced", "severely_reduced", "reduced", "hyperdynamic")
LVH_WORDS = ("mild", "moderate", "severe", "unspecified")
SEVERITIES = ("none", "trace", "mild", "mild_moderate", "moderate", "moderate_severe", "severe")
LESION_TYPE = "array<struct<valve:string,severity:string,negated:boolean,ge_moderate:boolean,evidence:string>>"


def parse_answer(answers: DataFrame, column: str) -> DataFrame:
    """A model's JSON answer to the same record; unreadable answers only set ``parse_error``."""
    body = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"(?s)\{.*\}", 0)
    readable = (F.length(body) > 0) & F.try_parse_json(body).isNotNull()
    out = answers.withColumn("__ok", readable).withColumn("__j", F.when(F.col("__ok"), F.from_json(body, ANSWER_SCHEMA)))
    num = lambda c: F.col(f"__j.{c}").try_cast("double")
    ef = F.when(num("lvef") < 1.0, num("lvef") * 100.0).otherwise(num("lvef"))
    wall = F.when(num("wall_thickness_cm") > 5.0, num("wall_thickness_cm") / 10.0).otherwise(num("wall_thickness_cm"))
    word = lambda c, known: F.when(F.col(f"__j.{c}").isin(*known), F.col(f"__j.{c}"))
    severity = lambda x: F.regexp_replace(F.lower(F.coalesce(x["severity"], F.lit("none"))), "[- ]", "_")

    def lesion(x: Column) -> Column:
        sev = severity(x)
        told = F.coalesce(x["negated"].try_cast("boolean"), F.lit(False))
        return F.struct(F.upper(x["valve"]).alias("valve"), sev.alias("severity"),
                        (told | (sev == "none")).alias("negated"), sev.isin(*nt.AT_LEAST_MODERATE).alias("ge_moderate"),
                        x["evidence"].alias("evidence"))

    listed = F.coalesce(F.transform("__j.valve_lesions", lesion), F.array().cast(LESION_TYPE))
    out = out.withColumns({
        "lvef": F.when(ef.between(5.0, 90.0), ef), "lvef_qualitative": word("lvef_qualitative", EF_WORDS),
        "wall_thickness_cm": F.when(wall.between(0.4, 3.5), wall), "lvh_qualitative": word("lvh_qualitative", LVH_WORDS),
        "lvef_evidence": F.col("__j.evidence.lvef"), "wall_evidence": F.col("__j.evidence.wall"),
        "lesions": F.filter(listed, lambda x: x["valve"].isin(*nt.LESIONS) & x["severity"].isin(*SEVERITIES)),
        "confidence": F.lit(0.0), "parse_error": (~F.col("__ok")).cast("int")})
    out = out.withColumn("lvh_negated", F.when(F.col("lvh_qualitative").isNotNull(), F.lit(False)))
    return components(out.drop("__j", "__ok"))


def components(records: DataFrame) -> DataFrame:
    """Component flags, composite and field count from the field values of a record."""
    bad = F.exists("lesions", lambda x: x["ge_moderate"] & ~x["negated"])
    word = F.col("lvef_qualitative")
    worded = F.when(word.isin("normal", "hyperdynamic"), F.lit(False)).when(
        word.isin("severely_reduced", "moderately_reduced", "reduced"), F.lit(True))
    no_lvh = F.coalesce(F.col("lvh_negated"), F.lit(False))
    out = records.withColumns({
        "lvef_le_45": F.when(F.col("lvef").isNotNull(), F.col("lvef") <= nt.LOW_EF).otherwise(worded),
        "wall_ge_1p3": F.when(F.col("wall_thickness_cm").isNotNull(), F.col("wall_thickness_cm") >= nt.THICK_WALL_CM)
        .when(F.col("lvh_qualitative").isin("moderate", "severe") & ~no_lvh, F.lit(True))
        .when(F.col("lvh_qualitative").isNotNull() & no_lvh, F.lit(False)),
        "valve_moderate_or_severe": F.when(F.size("lesions") > 0, bad)})
    fields = ((F.col("lvef_le_45").isNotNull() | F.col("lvef").isNotNull()).cast("int")
              + F.coalesce(F.col("wall_thickness_cm").isNotNull() | F.col("lvh_qualitative").isNotNull(),
                           F.lit(False)).cast("int") + (F.size("lesions") > 0).cast("int"))
    return out.withColumns({
        "shd_composite": or_known("lvef_le_45", "wall_ge_1p3", "valve_moderate_or_severe"), "n_fields_found": fields})


_READY: dict[str, Callable[[str], object]] = {}          # extractors set up in this worker


def answer_each(notes: DataFrame, text: str, setup: Callable[[], Callable[[str], object]], *, name: str = "extractor",
                template: str = "{text}") -> DataFrame:
    """The notes with an extractor's ``answer`` (JSON text), its ``failure`` and ``extractor``.

    ``setup`` makes the caller's function ``text -> JSON text or dict`` once per Python
    worker (a model is loaded there, not per note); it may run anywhere, so it must not
    lean on the driver. It sees whole texts, put into ``template``, each distinct text
    once: the answers are handed over before they are joined back, so later steps never
    ask again. An exception becomes the ``failure`` of its own text and the others go on;
    blank and null texts are not asked. A lost executor's unfinished texts are asked again.
    """
    token = uuid.uuid4().hex

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _READY:
            _READY.clear()
            _READY[token] = setup()
        extract_one = _READY[token]
        for batch in batches:
            rows = []
            for body in batch["__text"]:
                try:
                    said = extract_one(template.replace("{text}", body))
                    rows.append((said if said is None or isinstance(said, str) else json.dumps(said), None))
                except Exception as exc:  # noqa: BLE001  the caller's code may raise anything
                    rows.append((None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame({"__key": batch["__key"], "answer": [r[0] for r in rows], "failure": [r[1] for r in rows]})

    asked = F.when(F.trim(F.col(text)) != "", F.col(text))
    keyed = notes.withColumn("__key", F.sha2(asked, 256))
    texts = keyed.filter("__key IS NOT NULL").select("__key", F.col(text).alias("__text")).groupBy("__key").agg(
        F.first("__text").alias("__text"))
    told = cut(spread(texts).mapInPandas(ask, "__key string, answer string, failure string"))
    out = keyed.join(told, "__key", "left").drop("__key")
    return out.withColumn("extractor", F.concat(F.lit(name), F.when(F.col("failure").isNotNull(), F.lit(":error")).otherwise(F.lit(""))))


def extract_with(notes: DataFrame, text: str, setup: Callable[[], Callable[[str], object]], *, name: str = "extractor",
                 template: str = "{text}") -> DataFrame:
    """Records of a caller's extractor, in the form of :func:`parse_answer`, ready for :func:`merge`.

    A failed or unreadable answer sets ``parse_error`` and shows in ``extractor``
    (``name:error``, ``name:parse_error``); a blank note is an empty record.
    """
    out = parse_answer(answer_each(notes, text, setup, name=name, template=template), "answer")
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    out = out.withColumn("parse_error", F.when(blank, F.lit(0)).otherwise(F.col("parse_error")))
    bad = (F.col("parse_error") == 1) & F.col("failure").isNull()
    return out.withColumn("extractor", F.when(bad, F.lit(f"{name}:parse_error")).otherwise(F.col("extractor")))


RECORD_FIELDS = ("lvef", "lvef_qualitative", "wall_thickness_cm", "lvh_qualitative", "lvh_negated",
                 "lvef_evidence", "wall_evidence")


def merge(first: DataFrame, second: DataFrame, ident: str, policy: str = "second_overrides") -> DataFrame:
    """Field-wise merge of two extractions of the same notes; components are recomputed.

    The overriding record's known fields win and the other fills the gaps.  A second
    record that is missing or could not be parsed leaves the first one as it is.
    """
    if policy not in ("second_overrides", "first_overrides"):
        raise ValueError(f"unknown policy {policy!r}")
    lesions = lambda d: F.transform("lesions", lambda x: F.struct(
        x["valve"], x["severity"], x["negated"], x["ge_moderate"], x["evidence"]))
    every = [*RECORD_FIELDS, "confidence"]
    a = first.select(ident, *every, lesions(first).alias("lesions"))
    b = second.filter("parse_error = 0") if "parse_error" in second.columns else second
    b = b.select(ident, *[F.col(c).alias(f"__{c}") for c in every], lesions(b).alias("__lesions"))
    both = a.join(b, ident, "left")
    order = (lambda c: (f"__{c}", c)) if policy == "second_overrides" else (lambda c: (c, f"__{c}"))
    known = lambda c: F.when(F.size(F.col(c)) > 0, F.col(c))
    pick: dict[str, Column] = {c: F.coalesce(*order(c)) for c in RECORD_FIELDS}
    pick["lesions"] = F.coalesce(*[known(c) for c in order("lesions")], F.col("lesions"))
    pick["confidence"] = F.greatest("confidence", "__confidence")
    return components(both.select(ident, *[c.alias(n) for n, c in pick.items()]))
