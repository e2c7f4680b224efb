"""Clinical-note extraction over whole texts: column expressions evaluated next to the scan, and one Arrow-batched function for valve lesions."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halfseen.functions.scalar import as_col

LOW_EF = 45.0
THICK_WALL_CM = 1.3

# --- fixed values: cue words and patterns ------------------------------------

NUM = r"\d{1,2}(?:\.\d+)?"
RANGE = r"\s*(?:-|–|—|to|/)\s*"
CONTEXT = (r"(?i)\b(?:echo(?:cardiogram|cardiography|cardiographic)?|TTE|TEE|transthoracic|transesophageal|"
           r"transoesophageal|LVEF|ejection\s+fraction|valve|valvular|regurgitation|stenosis|IVSd|LVPWd)\b")
HISTORY = (r"(?i)\b(?:prior|previous(?:ly)?|old|baseline|remote|historical|history\s+of|h/o|"
           r"in\s+(?:19|20)\d\d|(?:19|20)\d\d)\b[^.\n]{0,40}$")
NEGATION_CUE = (r"\b(?:no|not|without|w/o|no\s+evidence\s+(?:of|for)|absence\s+of|absent|negative\s+for|"
                r"rule\s+out|r/o|denies|denied|free\s+of|resolved|resolution\s+of)\b")
CLAUSE_BREAK = r"[,;:.\n]|\b(?:but|however|although|with|and)\b"
EF_CUE = (r"(?<![A-Za-z])(LV\s*EF|LVEF|EF|(?:left\s+ventricular\s+|LV\s+)?ejection\s+fraction)(?![A-Za-z])")
EF_GAP = r"([^.\n\d%]{0,45}?)"
COMPARATOR = r"(>=|<=|≥|≤|>|<|greater\s+than|less\s+than|at\s+least|up\s+to|above|below)?\s*"
BAD_UNIT = (r"(?!\s*(?:cm|mm|mmhg|bpm|ms|msec|m/s|kg|mg|/min|min|hours?|hrs?|days?|weeks?|months?|years?|"
            r"yo|y/o)\b)")
BAD_GAP = r"(?i)\b(?:cm|mm|IVS|LVPW|septum|wall|LA|RA|RV|BNP|troponin|HR|BP|creatinine)\b"
EF_QUAL = (r"(hyperdynamic|low[- ]normal|normal|preserved|"
           r"(?:severely|moderately|mildly|markedly|profoundly|globally)\s+"
           r"(?:reduced|depressed|decreased|diminished|impaired|dysfunction)|"
           r"reduced|depressed|decreased|diminished|impaired)")
COMPARATORS = {"≥": ">=", "≤": "<=", "greater than": ">", "less than": "<", "at least": ">=", "up to": "<=",
               "above": ">", "below": "<", ">=": ">=", "<=": "<=", ">": ">", "<": "<"}
SITE = (r"(IVSd|IVS|inter-?ventricular\s+sept(?:um|al)(?:\s+(?:wall\s+)?thickness)?|"
        r"septal(?:\s+wall)?(?:\s+thickness)?|septum(?:\s+thickness)?|LVPWd|LVPW|PWd|PW|"
        r"(?:LV\s+|left\s+ventricular\s+)?posterior\s+wall(?:\s+thickness)?|"
        r"(?:LV\s+|left\s+ventricular\s+)?wall\s+thickness)")
LENGTH_UNIT = r"(cm|mm|centimet(?:er|re)s?|millimet(?:er|re)s?)?"
LVH = (r"(?i)(mild|moderate|severe|marked|mild[- ]to[- ]moderate|moderate[- ]to[- ]severe)?\s*"
       r"(?:concentric|asymmetric|eccentric|septal|symmetric)?\s*"
       r"(LVH|left\s+ventricular\s+hypertrophy|LV\s+hypertrophy)(?![A-Za-z])")
VOLTAGE = r"(?i)\b(?:voltage|ECG|EKG|electrocardiogram|criteria)\b"
SEVERITY = (r"(mild[- ]to[- ]moderate|mild[-/]mod(?:erate)?|moderate[- ]to[- ]severe|mod(?:erate)?[-/]severe|"
            r"moderate[- ]severe|moderately[- ]severe|severe|critical|moderate|mild|trivial|trace|minimal|"
            r"physiologic(?:al)?|significant|none|absent)")
ADJECTIVES = (r"(?:(?:calcific|calcified|functional|eccentric|central|ischemic|ischaemic|degenerative|secondary|"
              r"primary|rheumatic|bicuspid|chronic|acute|valvular|native|paravalvular|residual|new|persistent|"
              r"worsening|stable|low[- ]flow|low[- ]gradient|paradoxical|posteriorly[- ]directed|"
              r"anteriorly[- ]directed|\(\s*[1-4]\+\s*\))\s+){0,3}")
LESIONS = {
    "AS": (r"aortic(?:\s+valve)?\s+stenosis|aortic\s+valvular\s+stenosis", r"AS|AoS"),
    "AR": (r"aortic(?:\s+valve)?\s+(?:regurgitation|insufficiency|regurg|incompetence)", r"AR|AI"),
    "MS": (r"mitral(?:\s+valve)?\s+stenosis", r"MS"),
    "MR": (r"mitral(?:\s+valve)?\s+(?:regurgitation|insufficiency|regurg|incompetence)", r"MR"),
    "TR": (r"tricuspid(?:\s+valve)?\s+(?:regurgitation|insufficiency|regurg)", r"TR"),
    "PR": (r"pulmon(?:ic|ary)(?:\s+valve)?\s+(?:regurgitation|insufficiency|regurg)", r"PR|PI"),
}
NEEDS_CONTEXT = ("MS", "PR")
NO_PREFIX = (r"(no|without|w/o|absence\s+of|no\s+evidence\s+(?:of|for)|negative\s+for|free\s+of)\s+"
             r"(?:significant\s+|any\s+|evidence\s+of\s+|hemodynamically\s+significant\s+)?"
             r"(?:(?:mild|moderate|severe)(?:\s+(?:or|to|-)\s+(?:mild|moderate|severe))?\s+)?")
LINK_LONG = r"(?:is|was|were|appears?|appeared|noted\s+to\s+be|remains?|graded\s+as|,|:|\(|-)?\s*(?:at\s+least\s+)?"
LINK_SHORT = r"(?:is|was|appears?|noted\s+to\s+be|remains?|graded\s+as|,|:|\(|-)?\s*(?:at\s+least\s+)?"
VALVE_CONTEXT = (r"(?i)\b(?:echo\w*|TTE|TEE|valve|valvular|regurg\w*|stenosis|LVEF|EF|aortic|mitral|tricuspid|"
                 r"pulmonic|IVSd|LVPWd|gradient|leaflets?)\b")
AT_LEAST_MODERATE = ("moderate", "moderate_severe", "severe")

# -----------------------------------------------------------------------------


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def locate(text: Column, pattern) -> Column:
    """All matches as array of (pos, stop, hit); positions count from 0.

    The text between matches and the matches alternate, so a match starts where the one
    before stopped plus the gap between them: one running pass. It is made in chunks of
    about the root of the number of matches, because every step copies what its chunk has
    found so far; n matches cost n^1.5 copies, not n^2.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    none = F.array().cast("array<struct<pos:int,stop:int,hit:string>>")

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        pos = acc["at"] + F.length(x["gap"])
        found = F.struct(pos.alias("pos"), (pos + F.length(x["hit"])).alias("stop"), x["hit"].alias("hit"))
        return F.struct((pos + F.length(x["hit"])).alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    def walk(zipped: Column) -> Column:
        many = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(zipped))).cast("int"))

        def chunk(acc: Column, first: Column) -> Column:
            part = F.aggregate(F.slice(zipped, first + 1, many), start(acc["at"]), step)
            return bind(part, lambda q: F.struct(q["at"].alias("at"), F.concat(acc["found"], q["found"]).alias("found")))
        return F.aggregate(F.sequence(F.lit(0), F.size(zipped) - 1, many), start(F.lit(0)), chunk)["found"]

    def spans(h: Column) -> Column:
        # split only where something matched; the text behind the last match is no gap
        gaps = F.slice(F.split(text, p, F.lit(-1)), F.lit(1), F.size(h))
        zipped = F.zip_with(h, gaps, lambda a, b: F.struct(a.alias("hit"), b.alias("gap")))
        return F.when(F.size(h) > 0, bind(zipped, walk)).when(h.isNotNull(), none)

    return bind(hits, spans)


def before(text: Column, pos: Column, n: int) -> Column:
    return F.substring(text, F.greatest(pos - n, F.lit(0)) + 1, F.least(pos, F.lit(n)))


def around(text: Column, start: Column, stop: Column, back: int, ahead: int) -> Column:
    a = F.greatest(start - back, F.lit(0))
    return F.substring(text, a + 1, stop + ahead - a)


def snippet(text: Column, start: Column, stop: Column, pad: int = 60) -> Column:
    return F.trim(F.regexp_replace(around(text, start, stop, pad, pad), r"\s+", " "))


def negated(text: Column, pos: Column, back: int = 45) -> Column:
    """A negation cue precedes in the same clause: no clause break after the last cue."""
    return before(text, pos, back).rlike(rf"(?isU){NEGATION_CUE}(?:(?!{CLAUSE_BREAK}).)*$")


def historical(text: Column, pos: Column) -> Column:
    return before(text, pos, 60).rlike(HISTORY)


def in_context(text: Column, pos: Column) -> Column:
    return around(text, pos, pos, 200, 60).rlike(CONTEXT)


def _group(hit: Column, pattern: str, i: int) -> Column:
    """Group ``i`` of a match, null when it did not take part."""
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    g = F.regexp_extract(hit, f"{flags}^(?:{body})$", i)
    return F.when(F.length(g) > 0, g)


def _squash(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", " ")


EF_NUMERIC = ("(?i)" + EF_CUE + EF_GAP + COMPARATOR + rf"({NUM})(?!\d)" + rf"(?:{RANGE}({NUM})(?!\d))?"
              + r"\s*(?:%|percent|per\s+cent)?" + BAD_UNIT)
EF_BEFORE = "(?i)" + EF_QUAL + r"\s+(?:LV\s+|global\s+|systolic\s+)?" + EF_CUE
EF_AFTER = ("(?i)" + EF_CUE + r"\s*(?:is|was|appears?|remains?|noted\s+to\s+be|:|,|-)?\s*(?:grossly\s+|overall\s+)?"
            + EF_QUAL + r"(?![A-Za-z])")


def ef_numeric(text) -> Column:
    """Numeric EF mentions: value (midpoint of a range), comparator, context flags."""
    text = as_col(text)

    table = F.create_map(*[F.lit(v) for kv in COMPARATORS.items() for v in kv])
    percent = lambda v: F.when(v < 1.0, v * 100.0).otherwise(v)

    def read(m: Column) -> Column:
        parts = F.struct(*[_group(m["hit"], EF_NUMERIC, i).alias(f"g{i}") for i in (2, 3, 4, 5)])
        numbers = lambda g: F.struct(g["g2"].alias("gap"), g["g3"].alias("cmp"), g["g4"].cast("double").alias("a"),
                                     g["g5"].cast("double").alias("b"))

        def record(g: Column) -> Column:
            a, b = percent(g["a"]), percent(g["b"])
            return F.struct(
                F.coalesce((a + b) / 2.0, a).alias("value"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"),
                F.try_element_at(table, _squash(g["cmp"])).alias("comparator"),
                F.coalesce(g["gap"], F.lit("")).rlike(BAD_GAP).alias("bad"),
                m["pos"].alias("pos"), historical(text, m["pos"]).alias("historical"),
                in_context(text, m["pos"]).alias("in_context"), snippet(text, m["pos"], m["stop"]).alias("evidence"))

        return bind(parts, lambda g: bind(numbers(g), record))

    found = F.transform(locate(text, EF_NUMERIC), read)
    return F.filter(found, lambda f: ~f["bad"] & f["value"].between(5.0, 90.0))


def _ef_word(q: Column) -> Column:
    q = _squash(q)
    return (F.when(q.isin("normal", "preserved", "low normal", "low-normal"), "normal")
            .when(q == "hyperdynamic", "hyperdynamic")
            .when(q.rlike("^(severely|markedly|profoundly)"), "severely_reduced")
            .when(q.startswith("moderately"), "moderately_reduced")
            .when(q.startswith("mildly"), "mildly_reduced").otherwise("reduced"))


def ef_qualitative(text, numeric) -> Column:
    """Worded EF mentions that are not within 60 characters of a numeric one."""
    text, numeric = as_col(text), as_col(numeric)

    def read(pattern: str, group: int):
        def one(m: Column) -> Column:
            return F.struct(
                m["pos"].alias("pos"), bind(_group(m["hit"], pattern, group), _ef_word).alias("word"),
                negated(text, m["pos"]).alias("negated"), historical(text, m["pos"]).alias("historical"),
                in_context(text, m["pos"]).alias("in_context"), snippet(text, m["pos"], m["stop"]).alias("evidence"))
        return one

    both = F.concat(F.transform(locate(text, EF_BEFORE), read(EF_BEFORE, 1)),
                    F.transform(locate(text, EF_AFTER), read(EF_AFTER, 2)))
    far = F.filter(both, lambda f: ~F.exists(numeric, lambda n: F.abs(n["pos"] - f["pos"]) < 60))
    return F.array_sort(far)


def pick_primary(findings) -> Column:
    """Last in-context current mention, else last current one, else the last."""
    def last(f: Column) -> Column:
        return F.when(F.size(f) > 0, F.get(f, F.size(f) - 1))

    def pick(f: Column) -> Column:
        return bind(F.filter(f, lambda x: ~x["historical"]), lambda current: F.coalesce(
            last(F.filter(current, lambda x: x["in_context"])), last(current), last(f)))

    return bind(as_col(findings), pick)


WALL = ("(?i)" + r"(?<![A-Za-z])" + SITE + r"(?![A-Za-z])" + r"([^.\n\d]{0,30}?)" + rf"({NUM})(?!\d)"
        + rf"(?:{RANGE}({NUM})(?!\d))?" + r"\s*" + LENGTH_UNIT + r"(?![A-Za-z])")


def wall_mentions(text) -> Column:
    """Septal, posterior and generic wall thickness in cm, 0.4 to 3.5."""
    text = as_col(text)

    def read(m: Column) -> Column:
        parts = F.struct(*[_group(m["hit"], WALL, i).alias(f"g{i}") for i in (1, 3, 4, 5)])

        def record(g: Column) -> Column:
            site, unit = F.lower(g["g1"]), F.coalesce(F.lower(g["g5"]), F.lit(""))
            raw = F.greatest(g["g3"].cast("double"), g["g4"].cast("double"))
            guess = ~site.isin("pw", "pwd", "septum") & g["g3"].contains(".")
            value = (F.when(unit.rlike("^(mm|milli)"), raw / 10.0).when(unit.rlike("^(cm|centi)"), raw)
                     .when((unit == "") & guess, raw))
            kind = (F.when(site.contains("post") | site.startswith("lvpw") | site.isin("pw", "pwd"), "posterior")
                    .when(site.contains("sept") | site.startswith("ivs"), "septal").otherwise("wall"))
            return F.struct(kind.alias("site"), F.round(value, 2).alias("cm"), value.between(0.4, 3.5).alias("ok"),
                            m["pos"].alias("pos"), snippet(text, m["pos"], m["stop"]).alias("evidence"))

        return bind(parts, record)

    return F.filter(F.transform(locate(text, WALL), read), lambda w: w["ok"])


def hypertrophy(text) -> Column:
    """The statement that counts: struct(word, negated, evidence) or null.

    The most severe affirmed statement wins over negated ones; mentions next to
    electrical criteria do not count.
    """
    text = as_col(text)

    def read(m: Column) -> Column:
        def grade(sev: Column) -> Column:
            return (F.when(sev.isin("severe", "marked"), "severe").when(sev.isin("moderate", "moderate to severe"), "moderate")
                    .when(sev.isin("mild", "mild to moderate"), "mild").otherwise("unspecified"))

        def record(word: Column) -> Column:
            rank = F.when(word == "severe", 3.0).when(word == "moderate", 2.0).when(word == "mild", 1.0).otherwise(0.5)
            return F.struct(word.alias("word"), negated(text, m["pos"]).alias("negated"), rank.alias("rank"),
                            around(text, m["pos"], m["stop"], 60, 40).rlike(VOLTAGE).alias("voltage"),
                            snippet(text, m["pos"], m["stop"]).alias("evidence"))

        sev = F.regexp_replace(F.lower(F.coalesce(_group(m["hit"], LVH, 1), F.lit(""))), "-", " ")
        return bind(bind(sev, grade), record)

    found = F.filter(F.transform(locate(text, LVH), read), lambda h: ~h["voltage"])
    start = F.get(found, F.lit(0))
    return F.aggregate(found, start, lambda acc, h: F.when(
        ~h["negated"] & (acc["negated"] | (h["rank"] > acc["rank"])), h).otherwise(acc))


def _lesion_patterns() -> list[tuple[str, bool, str, int, int]]:
    """(code, abbreviated, pattern, severity group, grade group) in the order in which spans are taken."""
    rows, late = [], []
    edge, end = r"(?<![A-Za-z])", r"(?![A-Za-z])"
    for code, (full, _) in LESIONS.items():
        it = f"({full})"
        rows += [(code, False, "(?i)" + SEVERITY + r"\s+" + ADJECTIVES + it + end, 1, 0),
                 (code, False, "(?i)" + edge + it + r"\s*" + LINK_LONG + SEVERITY + end, 2, 0),
                 (code, False, "(?i)" + r"([1-4])\+\s*" + ADJECTIVES + it + end, 0, 1),
                 (code, False, "(?i)" + edge + it + r"\s*\(?\s*([1-4])\+\s*\)?", 0, 2),
                 (code, False, "(?i)" + NO_PREFIX + ADJECTIVES + it + end, 1, 0)]
    for code, (_, short) in LESIONS.items():
        it = edge + f"({short})" + end
        own = [(code, True, "(?i:" + NO_PREFIX + ADJECTIVES + ")" + it, 1, 0),
               (code, True, "(?i:" + SEVERITY + r")\s+(?i:" + ADJECTIVES + ")" + it, 1, 0),
               (code, True, it + r"\s*(?i:" + LINK_SHORT + SEVERITY + ")" + end, 2, 0),
               (code, True, r"([1-4])\+\s*(?i:" + ADJECTIVES + ")" + it, 0, 1),
               (code, True, it + r"\s*\(?\s*([1-4])\+\s*\)?", 0, 2)]
        (late if code in NEEDS_CONTEXT else rows).extend(own)
    return rows + late


SEVERITIES = {
    "severe": "severe", "critical": "severe", "moderate to severe": "moderate_severe", "mod severe": "moderate_severe",
    "moderate severe": "moderate_severe", "moderately severe": "moderate_severe", "moderate": "moderate", "significant": "moderate",
    "mild to moderate": "mild_moderate", "mild mod": "mild_moderate", "mild moderate": "mild_moderate", "mild": "mild", "trivial": "trace",
    "trace": "trace", "minimal": "trace", "physiologic": "trace", "physiological": "trace",
}
GRADES = {"1": "mild", "2": "moderate", "3": "moderate_severe", "4": "severe"}


@functools.cache
def _lesion_matchers():
    """Compiled once per worker: (code, short, test for the lesion's name, its (order, pattern, severity group, grade group))."""
    by_name: dict[tuple[str, bool], list] = {}
    for i, (code, short, pattern, sev, grade) in enumerate(_lesion_patterns()):
        by_name.setdefault((code, short), []).append((i, re.compile(pattern, re.A), sev, grade))
    tests = {k: re.compile(rf"(?<![A-Za-z])(?:{LESIONS[k[0]][1]})(?![A-Za-z])" if k[1] else f"(?i:{LESIONS[k[0]][0]})", re.A) for k in by_name}
    cues = re.compile(rf"{NEGATION_CUE}(?:(?!{CLAUSE_BREAK}).)*$", re.I | re.S), re.compile(HISTORY, re.A), re.compile(VALVE_CONTEXT, re.A)
    return [(code, short, tests[code, short], rows) for (code, short), rows in by_name.items()], cues


def _lesions_of(text: str) -> list[dict]:
    matchers, (negation, history, vicinity) = _lesion_matchers()
    found = sorted((order, m.start(), m.end(), code, short, m, sev, grade) for code, short, named, rows in matchers if named.search(text)
                   for order, pattern, sev, grade in rows for m in pattern.finditer(text))
    taken, out = [], []
    for _, pos, stop, code, short, m, sev, grade in found:       # spans are taken in pattern order
        if any(a < stop and pos < b for a, b in taken):
            continue
        if short and not vicinity.search(text[max(pos - 250, 0):stop + 100]) and not any(abs(a - pos) < 300 for a, _ in taken):
            letters = [c for c in text[max(pos - 40, 0):stop + 40] if c.isascii() and c.isalpha()]
            if code in NEEDS_CONTEXT or len(letters) >= 12 and sum(c.isupper() for c in letters) / len(letters) > 0.8:
                continue
        taken.append((pos, stop))
        word = " ".join(re.sub("[-/]", " ", m[sev].lower()).split()) if sev and m[sev] else ""
        severity = GRADES.get(m[grade] if grade else "") or SEVERITIES.get(word, "none")
        around_ = re.sub(r"\s+", " ", text[max(pos - 60, 0):stop + 60], flags=re.A).strip(" ")
        out.append({"pos": pos, "valve": code, "severity": severity, "ge_moderate": severity in AT_LEAST_MODERATE,
                    "negated": severity == "none" or bool(negation.search(text[max(pos - 45, 0):pos])),
                    "historical": bool(history.search(text[max(pos - 60, 0):pos])), "evidence": around_})
    return sorted(out, key=lambda x: (x["pos"], x["valve"], x["severity"]))


LESION = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("valve", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("ge_moderate", T.BooleanType()), T.StructField("negated", T.BooleanType()), T.StructField("historical", T.BooleanType()),
    T.StructField("evidence", T.StringType())]))


@F.pandas_udf(LESION)
def _lesions_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _lesions_of(t) for t in text], dtype=object)


def valve_lesions(text) -> Column:
    """Lesion statements with severity and negation; the first pattern to match holds a span.

    Sixty patterns depend on each other's matches, which the JVM can only do by compiling
    each of them again for every row; here they are compiled once per worker and texts come
    in Arrow batches.  A text in which no lesion is named costs its twelve name tests.
    """
    return _lesions_udf(as_col(text))


def ef_component(primary: Column, word: Column, word_negated: Column) -> Column:
    """Is the EF low?  From the primary numeric mention, else from the worded one."""
    v, c = primary["value"], primary["comparator"]
    numeric = (F.when(c.isin(">", ">="), F.when(v >= LOW_EF, F.lit(False)))
               .when(c.isin("<", "<="), F.when(v <= LOW_EF, F.lit(True))).otherwise(v <= LOW_EF))
    worded = F.when(word.isin("normal", "hyperdynamic"), F.lit(False)).when(
        word.isin("severely_reduced", "moderately_reduced", "reduced"), F.lit(True))
    return F.when(primary.isNotNull(), numeric).when(~word_negated, worded)
