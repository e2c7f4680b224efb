"""Outcome labels, note extraction and review.

Clinical sentences do not occur in the given documents, so the note queries read
notes that Spark renders from every order (measurements, grades and wording are
columns), and the oracle states the expected record from those columns.  The cue
queries run over the whole given documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from halfseen.catalog.base import (
    DAY, EV, HOUR, SPANS, document_units, event_kinds, events, h32, order_units, out, query, r, signup_spans, table,
)
from halfseen.catalog.table_queries import LINKED, decision_makers, linked, nearest_views
from halfseen.functions import notes as nt
from halfseen.functions import scalar as s
from halfseen.functions.hashing import hash32, unit_interval
from halfseen.operators import notes as no
from halfseen.operators import outcomes as oc
from halfseen.operators import review as rv
from halfseen.operators import temporal as tm
from halfseen.operators.lineage import spread
from halfseen.plans import cohorts as co

W = "WITH "

# --- notes rendered from orders -----------------------------------------------------------

SEV = ["mild", "moderate", "severe", "trace", "no significant"]
VALVES = ["aortic stenosis", "mitral regurgitation", "tricuspid regurgitation"]
CODES = ["AS", "MR", "TR"]
EF_WORDS = ["normal", "severely reduced", "mildly reduced", "hyperdynamic"]


def rendered_notes(spark, d):
    """(note_id, text): one note per order, wording chosen by the order's own columns."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ef = (20 + k % 50).cast("string")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    ef_text = (F.when(k % 5 == 0, F.concat(F.lit("LVEF "), ef, F.lit("%.")))
               .when(k % 5 == 1, F.concat(F.lit("EF of "), ef, F.lit("-"), (30 + k % 50).cast("string"), F.lit(" %.")))
               .when(k % 5 == 2, F.concat(F.lit("Ejection fraction is "), pick(EF_WORDS, c % 4), F.lit(".")))
               .when(k % 5 == 3, F.concat(F.lit("EF > "), ef, F.lit(" percent.")))
               .otherwise(F.lit("Function not assessed.")))
    wall = F.when(c % 3 == 0, F.concat(F.lit(" IVSd 1."), (k % 10).cast("string"), F.lit(" cm.")))
    wall = wall.when(c % 3 == 1, F.concat(F.lit(" LVPWd "), (8 + k % 9).cast("string"), F.lit(" mm."))).otherwise(F.lit(""))
    valve = F.when(c % 4 != 3, F.concat(F.lit(" There is "), pick(SEV, c % 5), F.lit(" "), pick(VALVES, k % 3), F.lit("."))).otherwise(F.lit(""))
    return spread(o).select(k.alias("note_id"), c.alias("ckey"), F.concat(F.lit("Echo performed. "), ef_text, wall, valve).alias("text"))


NOTE = """no AS (SELECT o_orderkey AS note_id, o_orderkey % 5 AS m, o_custkey AS c, o_orderkey AS k, 20 + o_orderkey % 50 AS ef FROM orders),
  fx AS (SELECT note_id, c, k, m, CASE m WHEN 0 THEN ef + 0e0 WHEN 1 THEN ef + 5e0 WHEN 3 THEN ef + 0e0 END AS lvef, CASE WHEN m = 2 THEN (['normal', 'severely_reduced', 'mildly_reduced', 'hyperdynamic'])[c % 4 + 1] END AS word,
    CASE c % 3 WHEN 0 THEN 1e0 + (k % 10)/10e0 WHEN 1 THEN (8 + k % 9)/10e0 END AS wall, CASE WHEN c % 4 <> 3 THEN c % 5 END AS sev, (['AS', 'MR', 'TR'])[k % 3 + 1] AS valve FROM no),
  fc AS (SELECT *, CASE WHEN m IN (0, 1) THEN lvef <= 45 WHEN m = 3 THEN CASE WHEN lvef >= 45 THEN false END WHEN m = 2 THEN CASE word WHEN 'normal' THEN false WHEN 'hyperdynamic' THEN false WHEN 'severely_reduced' THEN true END END AS c1,
    CASE WHEN wall IS NOT NULL THEN round(wall, 2) >= 1.3 END AS c2, CASE WHEN sev IS NOT NULL THEN sev IN (1, 2) END AS c3 FROM fx),
  fr AS (SELECT *, greatest(CAST(c1 AS INT), CAST(c2 AS INT), CAST(c3 AS INT)) AS shd, CAST(m <> 4 AS INT) + CAST(wall IS NOT NULL AS INT) + CAST(sev IS NOT NULL AS INT) AS fields FROM fc)"""


@query("n1_numeric_mentions", W + NOTE + " SELECT note_id, round(lvef, 6) AS value, CASE WHEN m = 3 THEN '>' END AS comparator, CASE WHEN m = 1 THEN ef0 + 0e0 END AS low FROM (SELECT *, 20 + k % 50 AS ef0 FROM fr) WHERE lvef IS NOT NULL")
def _(spark, d):
    n = rendered_notes(spark, d).select("note_id", F.explode(nt.ef_numeric("text")).alias("f"))
    low = F.when(F.col("f.high") != F.col("f.low"), F.col("f.low"))
    return out(n.select("note_id", F.col("f.value").alias("value"), F.col("f.comparator").alias("comparator"), low.alias("low")))


@query("n2_qualitative_mentions", W + NOTE + " SELECT note_id, word, CAST(0 AS BIGINT) AS negated FROM fr WHERE word IS NOT NULL")
def _(spark, d):
    n = rendered_notes(spark, d).withColumn("num", nt.ef_numeric("text"))
    n = n.select("note_id", F.explode(nt.ef_qualitative("text", "num")).alias("f"))
    return out(n.select("note_id", F.col("f.word").alias("word"), F.col("f.negated").alias("negated")))


@query("n3_negation", r"""WITH m AS (SELECT doc_id, text, unnest(range(1, len(text) + 1)) AS p FROM documents), h AS (SELECT doc_id, p - 1 AS pos, regexp_replace(substr(text, greatest(p - 1 - 45, 0) + 1, least(p - 1, 45)), '[^\x00-\x7F]', 'x', 'g') AS w FROM m WHERE substr(text, p, 3) = 'ent'),
  l AS (SELECT doc_id, pos, regexp_extract(w, '(?is)^(.*)\b(no|not|without|w/o|absent|denies|denied|resolved)\b(.*)$', 3) AS rest, regexp_matches(w, '(?i)\b(no|not|without|w/o|absent|denies|denied|resolved)\b') AS cue FROM h)
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE cue AND NOT regexp_matches(rest, '(?i)[,;:.\n]|\b(but|however|although|with|and)\b')) AS n_negated FROM l GROUP BY doc_id""")
def _(spark, d):
    t = spread(table(spark, d, "documents")).select("doc_id", "text", F.explode(nt.locate(F.col("text"), "ent")).alias("m"))
    t = t.withColumn("neg", nt.negated(F.col("text"), F.col("m.pos")))
    return out(t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("neg").alias("n_negated")))


@query("n4_context_windows", W + NOTE + " SELECT note_id, CAST(1 AS BIGINT) AS in_context, CAST(0 AS BIGINT) AS historical FROM fr WHERE lvef IS NOT NULL")
def _(spark, d):
    n = rendered_notes(spark, d).select("note_id", F.explode(nt.ef_numeric("text")).alias("f"))
    return out(n.select("note_id", F.col("f.in_context").alias("in_context"), F.col("f.historical").alias("historical")))


@query("n5_primary_pick", "SELECT o_orderkey AS note_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 20 + o_orderkey % 40 WHEN o_orderkey % 3 = 1 THEN 20 + o_custkey % 50 ELSE 25 + o_custkey % 50 END AS DOUBLE) AS value FROM orders")
def _(spark, d):
    # a prior value only; a prior and a current one; a current and then a prior one
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    prior = lambda v: F.concat(F.lit("Prior echo EF "), v.cast("string"), F.lit("%.\n"))
    now = lambda v: F.concat(F.lit("Echo today shows EF "), v.cast("string"), F.lit("%.\n"))
    text = (F.when(k % 3 == 0, prior(20 + k % 40)).when(k % 3 == 1, F.concat(prior(30 + k % 40), now(20 + c % 50)))
            .otherwise(F.concat(now(25 + c % 50), prior(30 + k % 40))))
    n = spread(table(spark, d, "orders")).select(k.alias("note_id"), text.alias("text"))
    return out(n.select("note_id", nt.pick_primary(nt.ef_numeric("text"))["value"].alias("value")))


@query("n2_negated_mentions", "SELECT o_orderkey AS note_id, (['normal', 'reduced', 'severely_reduced'])[o_custkey % 3 + 1] AS word, CAST(o_orderkey % 2 AS BIGINT) AS negated FROM orders")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = F.element_at(F.array(*[F.lit(w) for w in ("normal", "reduced", "severely reduced")]), (c % 3 + 1).cast("int"))
    text = F.concat(F.lit("Echo shows "), F.when(k % 2 == 1, F.lit("no ")).otherwise(F.lit("")), word, F.lit(" EF."))
    n = spread(table(spark, d, "orders")).select(k.alias("note_id"), text.alias("text")).withColumn("num", nt.ef_numeric("text"))
    n = n.select("note_id", F.explode(nt.ef_qualitative("text", "num")).alias("f"))
    return out(n.select("note_id", F.col("f.word").alias("word"), F.col("f.negated").alias("negated")))


@query("n4_history_windows", """WITH o AS (SELECT o_orderkey AS k FROM orders)
  SELECT k AS note_id, CAST(i AS BIGINT) AS place, CAST(h AS BIGINT) AS historical, CAST(c AS BIGINT) AS in_context FROM (SELECT k, 0 AS i, 1 AS h, 1 AS c FROM o WHERE k % 3 = 0 UNION ALL SELECT k, 0, 1, 1 FROM o WHERE k % 3 = 1 UNION ALL SELECT k, 1, 0, 1 FROM o WHERE k % 3 = 1
  UNION ALL SELECT k, 0, 0, 0 FROM o WHERE k % 3 = 2) q""")
def _(spark, d):
    k = F.col("o_orderkey")
    text = (F.when(k % 3 == 0, "Prior echo EF 60%.").when(k % 3 == 1, "Previous TTE: EF 55%.\nEcho today shows EF 35%.")
            .otherwise("Cell volume fine. EF 50%."))
    n = spread(table(spark, d, "orders")).select(k.alias("note_id"), text.alias("text"))
    n = n.select("note_id", F.posexplode(nt.ef_numeric("text")).alias("place", "f"))
    return out(n.select("note_id", "place", F.col("f.historical").alias("historical"), F.col("f.in_context").alias("in_context")))


@query("n6_wall_thickness", W + NOTE + " SELECT note_id, CASE WHEN c % 3 = 0 THEN 'septal' ELSE 'posterior' END AS site, round(wall, 2) + 0e0 AS cm FROM fr WHERE wall IS NOT NULL")
def _(spark, d):
    n = rendered_notes(spark, d).select("note_id", F.explode(nt.wall_mentions("text")).alias("w"))
    return out(n.select("note_id", F.col("w.site").alias("site"), F.col("w.cm").alias("cm")))


@query("n6_hypertrophy", "SELECT o_orderkey AS note_id, (['unspecified', 'mild', 'moderate', 'severe'])[o_custkey % 4 + 1] AS word, CAST(o_orderkey % 3 = 0 AS BIGINT) AS negated FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    grade = F.element_at(F.array(*[F.lit(w) for w in ("", "mild ", "moderate ", "severe ")]), (c % 4 + 1).cast("int"))
    tail = F.when(k % 7 == 0, F.lit(" by ECG voltage criteria.")).otherwise(F.lit(" on imaging."))
    text = F.concat(F.when(k % 3 == 0, F.lit("No ")).otherwise(F.lit("There is ")), grade, F.lit("LVH"), tail)
    n = table(spark, d, "orders").select(k.alias("note_id"), nt.hypertrophy(text).alias("h")).filter("h IS NOT NULL")
    return out(n.select("note_id", "h.word", "h.negated"))


@query("n7_valve_lesions", W + NOTE + " SELECT note_id, valve, (['mild', 'moderate', 'severe', 'trace', 'moderate'])[sev + 1] AS severity, CAST(sev = 4 AS BIGINT) AS negated FROM fr WHERE sev IS NOT NULL")
def _(spark, d):
    n = rendered_notes(spark, d).select("note_id", F.explode(nt.valve_lesions("text")).alias("v"))
    return out(n.select("note_id", "v.valve", "v.severity", "v.negated"))


@query("n8_note_record", W + NOTE + f""" SELECT note_id, {r('lvef')}, {r('wall', 'wall_thickness_cm')}, word AS lvef_qualitative, CAST(c1 AS BIGINT) AS lvef_le_45, CAST(c2 AS BIGINT) AS wall_ge_1p3, CAST(c3 AS BIGINT) AS valve_moderate_or_severe,
  CAST(shd AS BIGINT) AS shd_composite, CAST(fields AS BIGINT) AS n_fields_found, CASE WHEN fields = 0 THEN 0e0 ELSE round(CASE WHEN lvef IS NOT NULL THEN 0.35e0 WHEN word IS NOT NULL THEN 0.2e0 ELSE 0e0 END - CASE WHEN m = 3 AND c1 IS NULL THEN 0.1e0 ELSE 0e0 END
   + CASE WHEN wall IS NOT NULL THEN 0.2e0 ELSE 0e0 END + CASE WHEN sev IS NOT NULL THEN 0.25e0 ELSE 0e0 END - CASE WHEN sev = 4 THEN 0.05e0 ELSE 0e0 END + 0.2e0, 6) END AS confidence FROM fr""")
def _(spark, d):
    n = no.extract(rendered_notes(spark, d))
    return out(n.select("note_id", "lvef", "wall_thickness_cm", "lvef_qualitative", "lvef_le_45", "wall_ge_1p3", "valve_moderate_or_severe",
                        "shd_composite", "n_fields_found", "confidence"))


def answers(spark, d):
    """Structured answers rendered from orders, some unreadable."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    body = F.concat(F.lit('Sure: {"lvef": '), F.when(c % 4 == 0, F.lit("null")).when(c % 4 == 1, F.concat(F.lit('"0.'), (20 + k % 60).cast("string"), F.lit('"'))).otherwise((20 + k % 90).cast("string")),
                    F.lit(', "wall_thickness_cm": '), (8 + k % 9).cast("string"), F.lit(', "valve_lesions": [{"valve": "mr", "severity": "'),
                    F.element_at(F.array(*[F.lit(x) for x in ("mild", "Moderate-Severe", "none", "huge")]), (k % 4 + 1).cast("int")), F.lit('"}]} end'))
    return table(spark, d, "orders").select(k.alias("note_id"), F.when(k % 11 == 0, F.lit("no answer")).otherwise(body).alias("answer"))


ANS = """a0 AS (SELECT o_orderkey AS note_id, o_orderkey AS k, o_custkey AS c, o_orderkey % 11 = 0 AS bad FROM orders),
  a1 AS (SELECT *, CASE WHEN bad OR c % 4 = 0 THEN NULL WHEN c % 4 = 1 THEN 20 + k % 60 ELSE 20 + k % 90 END AS v, CASE WHEN NOT bad THEN CASE WHEN 8 + k % 9 > 5 THEN (8 + k % 9)/10e0 END END AS wall, CASE WHEN NOT bad AND k % 4 <> 3 THEN k % 4 END AS sev FROM a0),
  a2 AS (SELECT *, CASE WHEN v <= 90 THEN v + 0e0 END AS lvef FROM a1), a3 AS (SELECT *, greatest(CAST(lvef <= 45 AS INT), CAST(round(wall, 2) >= 1.3 AS INT), CASE WHEN sev IS NOT NULL THEN CAST(sev = 1 AS INT) END) AS shd FROM a2)"""


@query("n9_parse_answer", W + ANS + f" SELECT note_id, {r('lvef')}, {r('wall', 'wall_thickness_cm')}, CAST(CASE WHEN sev IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_lesions, CAST(shd AS BIGINT) AS shd_composite, CAST(bad AS BIGINT) AS parse_error FROM a3")
def _(spark, d):
    a = no.parse_answer(answers(spark, d), "answer")
    return out(a.select("note_id", "lvef", "wall_thickness_cm", F.size("lesions").alias("n_lesions"), "shd_composite", "parse_error"))


@query("n10_merge_records", W + NOTE + ", " + ANS + f" SELECT note_id, {r('coalesce(a3.lvef, fr.lvef)', 'lvef')}, {r('coalesce(a3.wall, fr.wall)', 'wall_thickness_cm')}, {r('CASE WHEN fields = 0 THEN 0e0 ELSE 1e0 END', 'known')} FROM fr JOIN a3 USING (note_id)")
def _(spark, d):
    first = no.extract(rendered_notes(spark, d))
    m = no.merge(first, no.parse_answer(answers(spark, d), "answer"), "note_id")
    known = first.select("note_id", (F.col("n_fields_found") > 0).cast("double").alias("known"))
    return out(m.join(known, "note_id").select("note_id", "lvef", "wall_thickness_cm", "known"))


def caller_extractor():
    """An extractor as a caller would write it: reads the first figure, gives up on some notes, stammers on others."""
    import re
    figure = re.compile(r"EF (?:of )?(\d+)")

    def read(text):
        if "not assessed" in text:
            raise ValueError("nothing to read")
        if "EF >" in text:
            return "no figure"
        found = figure.search(text)
        return {"lvef": int(found.group(1)) if found else None}
    return read


@query("n8_caller_extractor", W + NOTE + f" SELECT note_id, {r('CASE WHEN m IN (0, 1, 3) THEN 20e0 + k % 50 END', 'lvef')}, {r('wall', 'wall_thickness_cm')}, CASE m WHEN 4 THEN 'caller:error' WHEN 3 THEN 'caller:parse_error' ELSE 'caller' END AS extractor FROM fr")
def _(spark, d):
    notes = rendered_notes(spark, d)
    second = no.extract_with(notes, "text", caller_extractor, name="caller")
    m = no.merge(no.extract(notes), second, "note_id")
    return out(m.join(second.select("note_id", "extractor"), "note_id").select("note_id", "lvef", "wall_thickness_cm", "extractor"))


# --- outcomes ---------------------------------------------------------------------------------

@query("o1_grade_rank",
       "SELECT grade, rank, count(*) AS n FROM (SELECT (['moderate', 'Moderate-to-Severe', '2+', '3', 'trace MR', 'unknown', 'mild to moderate', 'critical'])[o_orderkey % 8 + 1] AS grade, ([3e0, 3.5e0, 2e0, 3e0, 1e0, NULL, 2e0, 4e0])[o_orderkey % 8 + 1] AS rank FROM orders) GROUP BY ALL")
def _(spark, d):
    words = ["moderate", "Moderate-to-Severe", "2+", "3", "trace MR", "unknown", "mild to moderate", "critical"]
    g = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, d, "orders").select(g.alias("grade")).withColumn("rank", oc.grade_rank("grade"))
    return out(o.groupBy("grade", "rank").agg(F.count(F.lit(1)).alias("n")))


def measured(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("study_id"), F.when(c % 5 == 0, (20 + k % 60) / 100.0).when(c % 5 < 3, (20 + k % 60).cast("double")).alias("ef"),
        F.when(k % 3 == 0, (6 + c % 10).cast("double")).when(k % 3 == 1, (6 + c % 10) / 10.0).alias("septum"),
        F.element_at(F.array(*[F.lit(w) for w in ("none", "mild", "moderate", "severe")]), (c % 4 + 1).cast("int")).alias("mr"),
        F.when(k % 4 == 0, 30.0 + c % 30).alias("rvsp"))


MEAS = """ms AS (SELECT o_orderkey AS study_id, CASE WHEN o_custkey % 5 < 3 THEN 20 + o_orderkey % 60 END AS ef, CASE WHEN o_orderkey % 3 < 2 THEN (6 + o_custkey % 10)/10e0 END AS wall, o_custkey % 4 AS mr, CASE WHEN o_orderkey % 4 = 0 THEN 30 + o_custkey % 30 END AS pasp FROM orders),
  mf AS (SELECT *, CAST(round(ef + 0e0, 6) <= 45 AS INT) AS f1, CAST(round(wall, 6) >= 1.3 AS INT) AS f2, CAST(mr >= 2 AS INT) AS f3, CAST(pasp >= 45 AS INT) AS f4 FROM ms)"""


def composite(spark, d):
    return oc.composite(measured(spark, d), {"lvef": "ef", "ivsd": "septum", "mr_grade": "mr", "pasp": "rvsp"})


@query("o2_composite", W + MEAS + " SELECT study_id, CAST(greatest(f1, f2, f3, f4) AS DOUBLE) AS composite, CAST((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT + 1 + (f4 IS NOT NULL)::INT AS BIGINT) AS n_evaluated, CAST(f1 AS DOUBLE) AS lvef_lte_45, CAST(f2 AS DOUBLE) AS lvwt_gte_13 FROM mf")
def _(spark, d):
    return out(composite(spark, d).select("study_id", "composite", "n_evaluated", "lvef_lte_45", "lvwt_gte_13"))


def note_pieces(spark, d):
    """Views linked to signup spans; each span carries one note rendered from its k."""
    spans = signup_spans(spark, d)
    notes = spans.select((F.col("stay_id") * 10).alias("note"), "stay_id",
                         F.concat(F.lit("Echo: EF "), (20 + F.col("k") % 60).cast("string"), F.lit("%.")).alias("text"))
    return spans.select("subject", "stay_id", "start", "stop"), notes


NOTE_LINK = SPANS + f""", lk AS (SELECT l.event_id, sp.stay_id * 10 AS note, CAST(20 + sp.k % 60 AS DOUBLE) AS ef, l.st BETWEEN sp.start AND sp.stop AS c FROM vw l JOIN sp ON l.subject = sp.subject AND sp.start <= l.tat + {DAY} AND sp.stop >= l.tat - {DAY}),
  lb AS (SELECT *, max(CAST(coalesce(c, false) AS INT)) OVER (PARTITION BY event_id) AS has FROM lk), us AS (SELECT * FROM lb WHERE has = 0 OR c),
  yn AS (SELECT event_id, CAST(max(CAST(ef <= 45 AS INT)) AS DOUBLE) AS y_note, arg_max(ef, note) AS note_lvef, count(*) AS note_n, array_to_string(list_sort(list(CAST(note AS VARCHAR))), ';') AS note_ids, CASE WHEN max(has) = 1 THEN 'contains' ELSE 'window' END AS note_link FROM us GROUP BY event_id)"""
VIEWS = EV + ", vw AS (SELECT *, CASE WHEN k % 2 = 0 THEN tat + k * 60000000 END AS st FROM ev WHERE event_type = 'view')"


@query("o3_label_from_notes", W + VIEWS + ", " + NOTE_LINK + f" SELECT event_id, y_note, {r('note_lvef')}, note_n, note_ids, note_link FROM yn")
def _(spark, d):
    v = events(spark, d, "view").withColumns({"st": F.when(F.col("k") % 2 == 0, F.col("at") + F.col("k") * 60000000),
                                              "lo": F.col("at") - DAY, "hi": F.col("at") + DAY})
    spans, notes = note_pieces(spark, d)
    pairs = tm.overlap_pairs(v.select("event_id", "subject", "st", "lo", "hi"), spans, by="subject", lower="lo", upper="hi", start="start", end="stop", cell=2 * DAY)
    inside = F.coalesce(F.col("st").between(F.col("start"), F.col("stop")), F.lit(False))
    links = pairs.select("event_id", "stay_id", F.when(inside, "contains").otherwise("window").alias("kind")).join(notes.select("note", "stay_id"), "stay_id")
    read = no.extract(notes).select("note", F.col("shd_composite").alias("shd"), "confidence", F.col("n_fields_found").alias("fields"), "lvef", F.col("wall_thickness_cm").alias("wall"))
    return out(oc.label_from_notes(links, read, record="event_id", note="note").select("event_id", "y_note", "note_lvef", "note_n", "note_ids", "note_link"))


@query("o4_code_lists", """SELECT o_orderkey AS okey, CASE o_orderkey % 4 WHEN 0 THEN 'I50' || (o_custkey % 10) WHEN 1 THEN 'I255' WHEN 2 THEN '' ELSE '' END AS hits, CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS n_codes FROM orders""")
def _(spark, d):
    o = code_strings(spark, d)
    codes = oc.parse_codes("codes")
    return out(o.select("okey", F.array_join(oc.matching_codes(codes), ";").alias("hits"), F.size(codes).alias("n_codes")))


def code_strings(spark, d):
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 10).cast("string")
    text = (F.when(k % 4 == 0, F.concat(F.lit("[np.str_('R07.9'), 'I50"), c, F.lit("']"))).when(k % 4 == 1, F.lit("['i25.5', 'E119']"))
            .when(k % 4 == 2, F.concat(F.lit("['I2"), c, F.lit("1']"))).otherwise(F.lit("[]")))
    return table(spark, d, "orders").select(k.alias("okey"), text.alias("codes"))


def code_inputs(spark, d):
    v = events(spark, d, "view")
    direct = v.filter(F.col("k") % 3 == 0).select("event_id", F.when(F.col("k") % 2 == 0, "['I50.1', 'E11']").otherwise("['E11']").alias("codes"))
    spans = signup_spans(spark, d)
    dx = spans.filter(F.col("k") % 5 != 0).select("stay_id", F.when(F.col("k") % 4 == 0, "I35.0").when(F.col("k") % 4 == 1, "4280").otherwise("Z99").alias("code"),
                                                  F.when(F.col("k") % 4 == 1, 9).otherwise(10).alias("version"))
    return v, direct, spans.select("subject", "stay_id", "start", "stop"), dx


@query("o5_label_from_codes", W + EV + ", " + SPANS + """, l AS (SELECT * FROM ev WHERE event_type = 'view'), p AS (SELECT l.event_id, l.k, sp.stay_id, sp.k AS sk, row_number() OVER (PARTITION BY l.event_id ORDER BY sp.start, sp.stay_id) AS rn FROM l LEFT JOIN sp ON l.subject = sp.subject AND l.tat BETWEEN sp.start AND sp.stop),
  q AS (SELECT *, k % 3 = 0 AS dir, stay_id IS NOT NULL AS st, sk % 5 <> 0 AS hasdx FROM p WHERE rn = 1)
  SELECT event_id, CASE WHEN dir THEN CASE WHEN k % 2 = 0 THEN 1e0 ELSE 0e0 END WHEN st AND hasdx AND sk % 4 = 1 THEN NULL WHEN st THEN CASE WHEN hasdx AND sk % 4 = 0 THEN 1e0 ELSE 0e0 END END AS y_code,
  CASE WHEN dir THEN 'record_table' WHEN st AND hasdx AND sk % 4 = 1 THEN 'stay_old_codes_only' WHEN st THEN 'stay' ELSE 'none' END AS code_source, CASE WHEN dir AND k % 2 = 0 THEN 'I501' WHEN NOT dir AND st AND hasdx AND sk % 4 = 0 THEN 'I350' ELSE '' END AS code_matched FROM q""")
def _(spark, d):
    v, direct, stays, dx = code_inputs(spark, d)
    x = oc.label_from_codes(v, ident="event_id", by="subject", time="at", direct=direct, stays=stays, diagnoses=dx)
    return out(x.select("event_id", "y_code", "code_source", "code_matched"))


CIRC = W + """cc AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_totalprice > 250000 AS DOUBLE) END AS y, CAST(o_orderstatus <> 'P' AS INT) AS t FROM orders),
  c AS (SELECT count(*) AS n, count(y) AS na, count(y) FILTER (WHERE t=0) AS n0, count(y) FILTER (WHERE t=1) AS n1, CAST(sum(y) FILTER (WHERE t=0) AS BIGINT) AS k0, CAST(sum(y) FILTER (WHERE t=1) AS BIGINT) AS k1 FROM cc)"""
WIL = lambda k, n, sign: f"((({k}/{n}+1.96e0*1.96e0/(2e0*{n}))/(1e0+1.96e0*1.96e0/{n})) {sign} (1.96e0*sqrt(({k}/{n})*(1e0-{k}/{n})/{n}+1.96e0*1.96e0/(4e0*{n}*{n}))/(1e0+1.96e0*1.96e0/{n})))"


@query("o6_circularity", CIRC + f" SELECT n, na AS n_assessable, n0, n1, k0, k1, {r('k0/n0', 'rate0')}, {r('k1/n1', 'rate1')}, {r(WIL('k0', 'n0', '-'), 'lo0')}, {r(WIL('k0', 'n0', '+'), 'hi0')}, {r(WIL('k1', 'n1', '-'), 'lo1')}, {r(WIL('k1', 'n1', '+'), 'hi1')}, {r('(k1/n1)/(k0/n0)', 'risk_ratio')}, {r('k1/n1-k0/n0', 'risk_difference')} FROM c")
def _(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_totalprice") > 250000).cast("double")).alias("y"), (F.col("o_orderstatus") != "P").cast("int").alias("t"))
    return out(oc.circularity(o, "y", "t"))


@query("o7_wilson", f"SELECT o_orderpriority AS priority, {r(WIL('k', 'n', '-'), 'lo')}, {r(WIL('k', 'n', '+'), 'hi')} FROM (SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_totalprice > 250000) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_totalprice") > 250000).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = s.wilson("k", "n")
    return out(g.select("priority", lo.alias("lo"), hi.alias("hi")))


@query("o8_nullable_or", W + MEAS + " SELECT study_id, CAST(greatest(f1, f2, f4) AS BIGINT) AS either FROM mf")
def _(spark, d):
    c = composite(spark, d)
    return out(c.select("study_id", oc.or_known("lvef_lte_45", "lvwt_gte_13", "pasp_gte_45").alias("either")))


C7_SQL = LINKED + ", vw AS (SELECT *, CASE WHEN t = 1 THEN tat + gap END AS st FROM dm), " + NOTE_LINK


@query("c7_linked_outcomes", C7_SQL + " SELECT vw.event_id, CASE WHEN t = 1 THEN y_note END AS y_obs, coalesce(note_n, 0) AS note_n, 'b_notes' AS route FROM vw LEFT JOIN yn USING (event_id)")
def _(spark, d):
    d = event_kinds(spark, d)
    units, _ = linked(spark, d)
    spans, notes = note_pieces(spark, d)
    x = co.linked_outcomes(units, ident="event_id", by="subject", time="at", notes=notes, note="note", note_stay="stay_id", stays=spans, window=DAY)
    return out(x.select("event_id", "y_obs", "note_n", "route"))


def study_measurements(spark, d):
    """Two measurement rows per second study, of which the first by ``seq`` counts."""
    studies = events(spark, d, "purchase").select(F.col("event_id").alias("study_id"))
    v = F.when(F.col("study_id") % 3 == 0, 1.0).when(F.col("study_id") % 3 == 1, 0.0)
    first = studies.filter("study_id % 2 = 0").select("study_id", v.alias("composite"), F.lit(1).alias("seq"))
    return first.unionByName(first.select("study_id", (1.0 - F.col("composite")).alias("composite"), F.lit(2).alias("seq")))


def measured_units(spark, d):
    d = event_kinds(spark, d)
    units, _ = linked(spark, d)
    spans, notes = note_pieces(spark, d)
    return co.linked_outcomes(units, ident="event_id", by="subject", time="at", notes=notes, note="note", note_stay="stay_id", stays=spans, window=DAY,
                              measured=study_measurements(spark, d), measured_order=["seq"])


@query("c7_measured_route", C7_SQL + " SELECT event_id, CASE WHEN t = 1 AND nearest_id % 2 = 0 THEN CASE nearest_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 END END AS y_obs, 'a_measured' AS route FROM vw")
def _(spark, d):
    return out(measured_units(spark, d).select("event_id", "y_obs", "route"))


@query("c7_recovery", C7_SQL + f""", j AS (SELECT vw.t, CASE WHEN vw.t = 1 THEN y_note END AS y_obs, y_note, coalesce(note_n, 0) AS k FROM vw LEFT JOIN yn USING (event_id))
  SELECT count(*) FILTER (WHERE t = 1) AS n_selected, count(y_obs) AS n_labelled, {r('count(y_obs) / greatest(count(*) FILTER (WHERE t = 1), 1)', 'recovery_rate')}, {r('avg(y_obs)', 'prevalence')},
  count(*) FILTER (WHERE k > 0) AS n_with_notes, count(*) FILTER (WHERE t = 1 AND k > 0 AND y_note IS NULL) AS n_undocumented, count(*) FILTER (WHERE t = 1 AND k = 0) AS n_without_note FROM j""")
def _(spark, d):
    d = event_kinds(spark, d)
    units, _ = linked(spark, d)
    spans, notes = note_pieces(spark, d)
    x = co.linked_outcomes(units, ident="event_id", by="subject", time="at", notes=notes, note="note", note_stay="stay_id", stays=spans, window=DAY)
    return out(co.outcome_recovery(x).select("n_selected", "n_labelled", "recovery_rate", "prevalence", "n_with_notes", "n_undocumented", "n_without_note"))


C7_CODE = C7_SQL + """, cp AS (SELECT vw.event_id, vw.t, ev.k, sp.stay_id, sp.k AS sk, row_number() OVER (PARTITION BY vw.event_id ORDER BY sp.start, sp.stay_id) AS rn FROM vw JOIN ev ON ev.event_id = vw.event_id LEFT JOIN sp ON vw.subject = sp.subject AND vw.tat BETWEEN sp.start AND sp.stop),
  cq AS (SELECT *, k % 3 = 0 AS dir, stay_id IS NOT NULL AS st, sk % 5 <> 0 AS hasdx FROM cp WHERE rn = 1),
  cy AS (SELECT event_id, t, CASE WHEN dir THEN CASE WHEN k % 2 = 0 THEN 1e0 ELSE 0e0 END WHEN st AND hasdx AND sk % 4 = 1 THEN NULL WHEN st THEN CASE WHEN hasdx AND sk % 4 = 0 THEN 1e0 ELSE 0e0 END END AS y_code,
  CASE WHEN dir THEN 'record_table' WHEN st AND hasdx AND sk % 4 = 1 THEN 'stay_old_codes_only' WHEN st THEN 'stay' ELSE 'none' END AS code_source FROM cq)"""


def coded_units(spark, d):
    d = event_kinds(spark, d)
    units, _ = linked(spark, d)
    spans, notes = note_pieces(spark, d)
    _, direct, _, dx = code_inputs(spark, d)
    return co.linked_outcomes(units, ident="event_id", by="subject", time="at", notes=notes, note="note", note_stay="stay_id", stays=spans, window=DAY,
                              codes=direct, diagnoses=dx)


@query("c7_code_route", C7_CODE + " SELECT event_id, CASE WHEN cy.t = 1 THEN y_note END AS y_obs, y_code, code_source FROM cy LEFT JOIN yn USING (event_id)")
def _(spark, d):
    return out(coded_units(spark, d).select("event_id", "y_obs", "y_code", "code_source"))


@query("c7_code_sources", C7_CODE + " SELECT CAST(t AS BIGINT) AS t, code_source, count(*) AS n, count(y_code) AS n_assessable FROM cy GROUP BY t, code_source")
def _(spark, d):
    return out(co.code_route(coded_units(spark, d))[1])


@query("c7_code_circularity", C7_CODE + f""", ch AS (SELECT count(*) AS n, count(y_code) AS na, count(y_code) FILTER (WHERE t=0) AS n0, count(y_code) FILTER (WHERE t=1) AS n1, CAST(coalesce(sum(y_code) FILTER (WHERE t=0), 0) AS BIGINT) AS k0, CAST(coalesce(sum(y_code) FILTER (WHERE t=1), 0) AS BIGINT) AS k1 FROM cy)
  SELECT n, na AS n_assessable, n0, n1, k0, k1, {r('k0/n0', 'rate0')}, {r('k1/n1', 'rate1')}, {r('(k1/n1)/(k0/n0)', 'risk_ratio')}, {r('k1/n1-k0/n0', 'risk_difference')} FROM ch""")
def _(spark, d):
    x = co.code_route(coded_units(spark, d))[0].filter("split = 'selected'")
    return out(x.select("n", "n_assessable", "n0", "n1", "k0", "k1", "rate0", "rate1", "risk_ratio", "risk_difference"))


# --- review -------------------------------------------------------------------------------------

POOL = """pl AS (SELECT o_orderkey AS note_id, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'positive' ELSE 'negative' END AS st FROM orders)"""
STRATA = ("positive", "negative", "missing")


def pool(spark, d):
    k = F.col("o_orderkey")
    comp = F.when(k % 10 == 0, F.lit(None)).when(k % 3 == 0, 1).otherwise(0).cast("int")
    return table(spark, d, "orders").select(k.alias("note_id"), rv.stratum(comp).alias("st"))


@query("r1_allocation", W + POOL + """, c AS (SELECT count(*) // 2 AS n, count(*) // 2 // 3 AS s, least(count(*) FILTER (WHERE st = 'missing'), count(*) // 2 // 3) AS m FROM pl), d AS (SELECT *, n - 2 * s - m AS rest FROM c)
  SELECT st, CAST(CASE st WHEN 'missing' THEN m WHEN 'positive' THEN s + rest // 2 + rest % 2 ELSE s + rest // 2 END AS BIGINT) AS allocated, count(*) AS available FROM pl, d GROUP BY st, n, s, m, rest""")
def _(spark, d):
    p = pool(spark, d)
    quota = rv.allocation(p, "st", STRATA, p.count() // 2)
    got = F.create_map(*[F.lit(v) for kv in quota.items() for v in kv])
    return out(p.groupBy("st").agg(F.count(F.lit(1)).alias("available")).select("st", got[F.col("st")].cast("bigint").alias("allocated"), "available"))


R2N = 300


@query("r2_stratified_sample", W + POOL + f", q AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {h32('note_id', 'review')}, note_id) AS rn FROM pl) SELECT note_id, st FROM q WHERE rn <= {R2N // 3}")
def _(spark, d):
    return out(rv.stratified_sample(pool(spark, d), "st", STRATA, R2N, "note_id", "review").select("note_id", "st"))


SHEET = 150


@query("r2_review_sheet", W + POOL + f""", pn AS (SELECT *, row_number() OVER (ORDER BY {h32('note_id', 'pool')}, note_id) AS pr, count(*) OVER () // 2 AS most FROM pl), q AS (SELECT note_id, st, row_number() OVER (PARTITION BY st ORDER BY {h32('note_id', 'sheet')}, note_id) AS rn FROM pn WHERE pr <= most)
  SELECT note_id, st, row_number() OVER (ORDER BY {h32('note_id', 'sheet/order')}, note_id) - 1 AS position, '' AS truth_shd, '' AS reviewer_comment FROM q WHERE rn <= {SHEET // 3}""")
def _(spark, d):
    p = pool(spark, d)
    drawn = rv.pool_sample(p, p.count() // 2, "note_id", "pool")
    return out(rv.review_sheet(drawn, "st", STRATA, SHEET, "note_id", "sheet").select("note_id", "st", "position", "truth_shd", "reviewer_comment"))


@query("r3_parse_review_cells", "SELECT cell, CASE WHEN cell = '' THEN NULL WHEN upper(cell) IN ('NA', 'ND') THEN -1e0 ELSE TRY_CAST(cell AS DOUBLE) END AS value, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'na' WHEN 2 THEN 'ND' WHEN 3 THEN CAST(o_orderkey % 60 AS VARCHAR) ELSE 'abc' END AS cell FROM orders) GROUP BY ALL")
def _(spark, d):
    k = F.col("o_orderkey")
    c = F.when(k % 5 == 0, "").when(k % 5 == 1, "na").when(k % 5 == 2, "ND").when(k % 5 == 3, (k % 60).cast("string")).otherwise("abc")
    x = table(spark, d, "orders").select(c.alias("cell")).withColumn("value", rv.parse_answer_cell("cell"))
    return out(x.groupBy("cell", "value").agg(F.count(F.lit(1)).alias("n")))


REV = """rvw AS (SELECT d.doc_id, lang, CASE WHEN toxic IS NULL THEN NULL WHEN d.doc_id % 13 = 0 THEN -1e0 ELSE CAST(quality AS DOUBLE) END AS truth, CASE WHEN d.doc_id % 6 <> 0 THEN CAST(n_chars > 1500 AS DOUBLE) END AS pred FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def reviewed(spark, d):
    u = document_units(spark, d)
    k = F.col("doc_id")
    return u.select("doc_id", "lang", F.when(F.col("t") == 1, F.when(k % 13 == 0, -1.0).otherwise(F.col("y_obs"))).alias("truth"),
                    F.when(k % 6 != 0, (F.col("n_chars") > 1500).cast("double")).alias("pred"))


@query("r4_binary_scores", W + REV + f""", b AS (SELECT CASE WHEN truth < 0 THEN false ELSE truth >= 0.5 END AS y, coalesce(pred >= 0.5, false) AS p, pred IS NULL AS mi FROM rvw WHERE truth IS NOT NULL),
  c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) FILTER (WHERE mi) AS n_pred_missing, count(*) FILTER (WHERE y AND p AND NOT mi) AS dtp, count(*) FILTER (WHERE y AND NOT mi) AS dt FROM b)
  SELECT tp, fp, fn, tn, n_pred_missing, {r('tp/(tp+fp)', 'precision')}, {r('tp/(tp+fn)', 'recall')}, {r('2e0*tp/(2e0*tp+fp+fn)', 'f1')}, {r('(tp+tn)/(tp+fp+fn+tn)', 'accuracy')}, {r('dtp/dt', 'recall_documented')}, {r(WIL('tp', '(tp+fp)', '-'), 'precision_lo')}, {r(WIL('tp', '(tp+fn)', '+'), 'recall_hi')} FROM c""")
def _(spark, d):
    x = rv.binary_scores(reviewed(spark, d), "truth", "pred", lambda v: v >= 0.5)
    return out(x.select("tp", "fp", "fn", "tn", "n_pred_missing", "precision", "recall", "f1", "accuracy", "recall_documented", "precision_lo", "recall_hi"))


@query("r5_bootstrap_f1")
def _(spark, d):
    x = rv.bootstrap_f1(rv.binary_scores(reviewed(spark, d), "truth", "pred", lambda v: v >= 0.5))
    return out(x.select("f1", "f1_lo", "f1_hi", ((F.col("f1") >= F.col("f1_lo")) & (F.col("f1") <= F.col("f1_hi"))).cast("int").alias("inside")))


@query("r6_numeric_agreement", """SELECT lang, count(*) FILTER (WHERE t IS NOT NULL AND t >= 0 AND p IS NOT NULL) AS n_both, count(*) FILTER (WHERE t >= 0) AS n_truth, round(avg(CASE WHEN t >= 0 THEN abs(p - t) END), 6) + 0e0 AS mae,
  round(avg(CASE WHEN t >= 0 AND p IS NOT NULL THEN CAST(abs(p - t) <= 100 AS DOUBLE) END), 6) + 0e0 AS within, round(count(*) FILTER (WHERE t >= 0 AND p IS NOT NULL) / count(*) FILTER (WHERE t >= 0), 6) + 0e0 AS detection_recall
  FROM (SELECT lang, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 9 = 0 THEN -1 ELSE n_chars END END AS t, CASE WHEN doc_id % 5 <> 0 THEN n_chars + doc_id % 200 END AS p FROM documents) GROUP BY lang""")
def _(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "documents").select("lang", F.when(k % 4 != 0, F.when(k % 9 == 0, -1.0).otherwise(F.col("n_chars"))).alias("t"), F.when(k % 5 != 0, F.col("n_chars") + k % 200).alias("p"))
    return out(rv.numeric_agreement(x, "t", "p", 100, keys=["lang"]).select("lang", "n_both", "n_truth", "mae", "within", "detection_recall"))


@query("r7_agreement_by_stratum", W + REV + " SELECT lang, count(*) AS n, count(truth) AS n_reviewed, round(avg(CASE WHEN truth IS NOT NULL THEN CAST((truth >= 0.5) = (coalesce(pred, 0) >= 0.5) AS DOUBLE) END), 6) + 0e0 AS agreement FROM rvw GROUP BY lang")
def _(spark, d):
    return out(rv.agreement_by(reviewed(spark, d), "truth", "pred", "lang"))
