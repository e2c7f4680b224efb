"""Joins in time, features, cohorts, guards, disclosure, sources and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from halfseen.catalog.base import (
    CELLS, DAY, EV, HOUR, SPANS, V1, V1N, V2, V3, box_sql, document_units, events, grid_sql, h32, hu, lineitem_boxes,
    lineitem_nuisance, lineitem_units, order_units, out, packed_boxes, packed_lineitem, query, r, sharp_sql,
    signup_spans, table,
)
from halfseen.functions import scalar as s
from halfseen.functions.hashing import poisson1, poisson_steps, unit_interval
from halfseen.operators import disclosure as dc
from halfseen.operators import evaluation as ev
from halfseen.operators import features as ft
from halfseen.operators import gamma as gm
from halfseen.operators import nuisance as nu
from halfseen.operators import ranking as rk
from halfseen.operators import temporal as tm
from halfseen.operators import validate as vd
from halfseen.operators.lineage import shared_folder
from halfseen.plans import cohorts as co
from halfseen.sources import contracts, reader, sinks, typed

W = "WITH "
LV = "l AS (SELECT * FROM ev WHERE event_type = 'view')"


def kind(k, name):
    return f"{name} AS (SELECT * FROM ev WHERE event_type = '{k}')"


# --- temporal joins ---------------------------------------------------------------

NEAR = W + EV + ", " + LV + ", " + kind("purchase", "rr") + f""", x AS (SELECT l.event_id, l.subject, l.tat, l.value, rr.event_id AS rid, rr.tat - l.tat AS gap,
  row_number() OVER (PARTITION BY l.event_id ORDER BY abs(rr.tat - l.tat), rr.event_id) AS rn FROM l LEFT JOIN rr ON l.subject = rr.subject),
  nr AS (SELECT event_id, subject, tat, value, rid AS nearest_id, gap, CAST(coalesce(abs(gap) <= {DAY}, false) AS BIGINT) AS t FROM x WHERE rn = 1)"""


def nearest_views(spark, d):
    views = events(spark, d, "view")
    right = events(spark, d, "purchase").select("subject", F.col("at").alias("rat"), F.col("event_id").alias("rid"))
    return tm.nearest_join(views, right, by="subject", time="at", right_time="rat", right_id="rid", window=DAY)


@query("j1_nearest_join", NEAR + " SELECT event_id, nearest_id, gap, t FROM nr")
def _(spark, d):
    return out(nearest_views(spark, d).select("event_id", "nearest_id", "gap", "t"))


@query("j2_coverage", W + EV + ", " + LV + f""", c AS (SELECT min(tat) AS a, max(tat) AS b FROM ev WHERE event_type = 'purchase'),
  k AS (SELECT l.* FROM l, c WHERE l.tat >= a + {2 * DAY} AND l.tat <= b - {2 * DAY})
  SELECT (SELECT count(*) FROM l) AS n_before, count(*) AS n_after, (SELECT count(DISTINCT subject) FROM l) AS subjects_before, count(DISTINCT subject) AS subjects_after FROM k""")
def _(spark, d):
    views = events(spark, d, "view")
    kept = tm.restrict_to_coverage(views, tm.coverage(events(spark, d, "purchase"), "at"), "at", -2 * DAY)
    a = views.agg(F.count(F.lit(1)).alias("n_before"), F.count_distinct("subject").alias("subjects_before"), F.lit(1).alias("k"))
    b = kept.agg(F.count(F.lit(1)).alias("n_after"), F.count_distinct("subject").alias("subjects_after"), F.lit(1).alias("k"))
    return out(a.join(b, "k").select("n_before", "n_after", "subjects_before", "subjects_after"))


def greedy_sql(src: str, gap: int, name: str = "gk") -> str:
    return f"""{name}n AS (SELECT a.subject, a.tat, min(b.tat) AS nx FROM {src} a LEFT JOIN {src} b ON a.subject = b.subject AND b.tat >= a.tat + {gap} GROUP BY ALL),
  {name}r AS (SELECT subject, min(tat) AS tat FROM {src} GROUP BY subject UNION ALL SELECT n.subject, n.nx FROM {name}r k JOIN {name}n n ON k.subject = n.subject AND k.tat = n.tat WHERE n.nx IS NOT NULL),
  {name} AS (SELECT o.* FROM {src} o JOIN {name}r USING (subject, tat))"""


@query("j3_greedy_gap", "WITH RECURSIVE " + EV + ", " + LV + ", " + greedy_sql("l", DAY) + " SELECT event_id, subject FROM gk")
def _(spark, d):
    return out(tm.greedy_gap(events(spark, d, "view"), by="subject", ident="event_id", time="at", gap=DAY).select("event_id", "subject"))


@query("j4_asof_join", W + EV + ", " + LV + ", " + kind("click", "c") + f""", j AS (SELECT l.event_id, l.tat, c.event_id AS cid, c.value AS cv, c.tat AS cat FROM l ASOF LEFT JOIN c ON l.subject = c.subject AND l.tat >= c.tat)
  SELECT event_id, CASE WHEN tat - cat <= {12 * HOUR} THEN cid END AS click_id, CASE WHEN tat - cat <= {12 * HOUR} THEN round(cv, 6) + 0e0 END AS click_value FROM j""")
def _(spark, d):
    look = tm.Lookup(events(spark, d, "click"), "at", ["event_id", "value"], "c", tie="event_id", tolerance=12 * HOUR)
    j = tm.asof_join(events(spark, d, "view"), [look], "subject", "at")
    return out(j.select("event_id", F.col("c.event_id").alias("click_id"), F.col("c.value").alias("click_value")))


def decision_makers(spark, d):
    k = F.col("k")
    u = events(spark, d, "signup").select("subject", F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("U"), k % 4)).alias("unit"),
                                          F.col("at").alias("intime"), F.when(k % 10 != 0, F.col("at") + k * HOUR).alias("outtime"))
    v = events(spark, d, "click").select("subject", F.concat(F.lit("S"), k % 3).alias("service"), F.col("at").alias("transfertime"),
                                         (F.col("at") + k * HOUR / 2).cast("bigint").alias("endtime"))
    a = events(spark, d, "error").select("subject", F.concat(F.lit("L"), k % 5).alias("location"), F.col("at").alias("admittime"),
                                         (F.col("at") + k * HOUR).alias("dischtime"))
    return u, v, a


DM = kind("signup", "su") + ", " + kind("click", "cl") + ", " + kind("error", "er") + f""", uu AS (SELECT subject, 'U' || (k % 4) AS unit, tat AS intime, CASE WHEN k % 10 <> 0 THEN tat + k * {HOUR} END AS outtime FROM su WHERE k % 7 <> 0),
  ss AS (SELECT subject, 'S' || (k % 3) AS service, tat AS transfertime, tat + k * {HOUR // 2} AS endtime FROM cl), aa AS (SELECT subject, 'L' || (k % 5) AS location, tat AS admittime, tat + k * {HOUR} AS dischtime FROM er)"""


def dm_sql(src, name="dm"):
    return f"""{name}0 AS (SELECT b.*, unit, outtime FROM {src} b ASOF LEFT JOIN uu u ON b.subject = u.subject AND b.tat >= u.intime),
  {name}1 AS (SELECT b.*, service, endtime FROM {name}0 b ASOF LEFT JOIN ss u ON b.subject = u.subject AND b.tat >= u.transfertime),
  {name}2 AS (SELECT b.*, location, dischtime FROM {name}1 b ASOF LEFT JOIN aa u ON b.subject = u.subject AND b.tat >= u.admittime),
  {name}3 AS (SELECT *, CASE WHEN unit IS NOT NULL AND (outtime IS NULL OR tat < outtime) THEN unit END AS z1, CASE WHEN tat <= endtime THEN service END AS z2, CASE WHEN tat <= dischtime THEN location END AS z3 FROM {name}2),
  {name} AS (SELECT *, coalesce(z1, z2, z3, 'unknown') AS z, CASE WHEN z1 IS NOT NULL THEN 'careunit' WHEN z2 IS NOT NULL THEN 'curr_service' WHEN z3 IS NOT NULL THEN 'admission_location' ELSE 'unknown' END AS z_source FROM {name}3)"""


@query("j5_decision_maker", W + EV + ", " + LV + ", " + DM + ", " + dm_sql("l") + " SELECT event_id, z, z_source FROM dm")
def _(spark, d):
    u, v, a = decision_makers(spark, d)
    return out(tm.attach_decision_maker(events(spark, d, "view"), u, by="subject", time="at", services=v, stays=a).select("event_id", "z", "z_source"))


@query("j6_first_per_year", W + V3 + " SELECT ckey, CAST(year(odate) AS BIGINT) AS exam_year, arg_min(okey, (odate, okey)) AS okey FROM ov GROUP BY ALL")
def _(spark, d):
    return out(co.first_per_year(order_units(spark, d), "ckey", "odate", "okey").select("ckey", "exam_year", "okey"))


@query("j7_keep_first", W + EV + " SELECT subject, event_type, arg_min(event_id, tat) AS event_id FROM ev GROUP BY ALL")
def _(spark, d):
    e = events(spark, d)
    return out(tm.keep_first(e, ["subject", "event_type"], ["at", "event_id"]).select("subject", "event_type", "event_id"))


def exams(spark, d):
    """Orders as screening exams with a follow-up length."""
    o = order_units(spark, d)
    return o.withColumns({"followup": F.col("okey") % 400, "exam_date": F.date_format("odate", "yyyy-MM-dd")})


EXAM = V3 + ", ex AS (SELECT *, okey % 400 AS followup, strftime(odate, '%Y-%m-%d') AS exam_date FROM ov)"


@query("j8_followup_window", W + EXAM + " SELECT segment, count(*) AS n, CAST(sum(y) AS DOUBLE) AS events FROM ex WHERE NOT (y <> 1 AND followup < 365) GROUP BY segment")
def _(spark, d):
    return out(co.classifiable(exams(spark, d), "y", "followup", 365).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events")))


@query("j9_interval_overlap", W + EV + ", " + SPANS + ", " + LV + f""", p AS (SELECT l.event_id, sp.k, CASE WHEN l.tat BETWEEN start AND stop THEN 1 ELSE 0 END AS c FROM l LEFT JOIN sp ON l.subject = sp.subject AND sp.start <= l.tat + {2 * DAY} AND sp.stop >= l.tat - {2 * DAY}),
  q AS (SELECT event_id, max(c) AS anyc, count(k) AS n_w, count(*) FILTER (WHERE c = 1) AS n_c, count(*) FILTER (WHERE k >= 80) AS p_w, count(*) FILTER (WHERE c = 1 AND k >= 80) AS p_c, count(*) FILTER (WHERE k < 40) AS z_w, count(*) FILTER (WHERE c = 1 AND k < 40) AS z_c FROM p GROUP BY event_id)
  SELECT event_id, CASE WHEN anyc = 1 THEN n_c ELSE n_w END AS n_linked, CASE WHEN (CASE WHEN anyc = 1 THEN p_c ELSE p_w END) > 0 THEN 1e0 WHEN (CASE WHEN anyc = 1 THEN z_c ELSE z_w END) > 0 THEN 0e0 END AS y FROM q""")
def _(spark, d):
    spans = signup_spans(spark, d)
    flags = {"n": F.lit(1), "p": F.col("k") >= 80, "q": F.col("k") < 40}
    views = events(spark, d, "view").select("event_id", "subject", "at").withColumns({"lo": F.col("at") - 2 * DAY, "hi": F.col("at") + 2 * DAY})
    both = tm.windowed_counts(views, spans, by="subject", ident="event_id", start="start", end="stop", counts=flags,
                              windows={"w": ("lo", "hi"), "c": ("at", "at")})
    pick = lambda n: F.when(F.col("n_c") > 0, F.col(f"{n}_c")).otherwise(F.col(f"{n}_w"))
    return out(both.select("event_id", pick("n").alias("n_linked"), F.when(pick("p") > 0, 1.0).when(pick("q") > 0, 0.0).alias("y")))


@query("j10_containing_interval", W + EV + ", " + SPANS + ", " + LV + """, p AS (SELECT l.event_id, stay_id, row_number() OVER (PARTITION BY l.event_id ORDER BY start, stay_id) AS rn
  FROM l LEFT JOIN sp ON l.subject = sp.subject AND l.tat BETWEEN start AND stop) SELECT event_id, stay_id AS span_id FROM p WHERE rn = 1""")
def _(spark, d):
    j = tm.first_containing(events(spark, d, "view"), signup_spans(spark, d), by="subject", time="at", start="start", end="stop", ident="stay_id")
    return out(j.select("event_id", "span_id"))


@query("j11_event_in_window", W + EV + ", " + LV + ", " + kind("click", "c") + f""" SELECT l.event_id, CAST(max(CASE WHEN c.tat - l.tat BETWEEN {-HOUR // 2} AND {6 * HOUR} THEN 1 ELSE 0 END) AS BIGINT) AS t
  FROM l LEFT JOIN c ON l.subject = c.subject GROUP BY l.event_id""")
def _(spark, d):
    views = events(spark, d, "view").withColumn("from", F.col("at") - HOUR // 2)
    j = tm.asof_join(views, [tm.Lookup(events(spark, d, "click"), "at", [], "c")], "subject", "from", ("forward",))
    return out(j.select("event_id", F.coalesce((F.col("c.at") <= F.col("at") + 6 * HOUR).cast("int"), F.lit(0)).alias("t")))


@query("j12_align_by_key", "SELECT lang, count(*) AS n, count(l.doc_id) AS n_matched, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return out(j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_matched"), F.sum("toxic").alias("toxic")))


@query("j13_merge_rare", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT lang, n, CASE WHEN n >= 120 THEN lang ELSE 'other' END AS z FROM c),
  t AS (SELECT z, sum(n) AS k FROM m GROUP BY z), x AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS i, k / sum(k) OVER () AS sh FROM t)
  SELECT lang, z AS z_merged, i AS z_index, round(sh, 6) + 0e0 AS z_share, n FROM m JOIN x USING (z)""")
def _(spark, d):
    m = tm.merge_rare(table(spark, d, "documents").select("lang"), "lang", 120)
    return out(m.groupBy("lang", "z_merged", "z_index", "z_share").agg(F.count(F.lit(1)).alias("n")))


@query("j14_semi_join", """SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice), 2) + 0e0 AS total FROM lineitem WHERE l_linestatus IN ('F') AND l_suppkey IN
  (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY 1""")
def _(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    li = table(spark, d, "lineitem").filter(F.col("l_linestatus").isin("F")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    g = li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("t"))
    return out(g.select("flag", "n", F.round("t", 2).alias("total")))


Z5 = ("z5 AS (SELECT c1, c2, c3, z, n, e, p1 FROM (SELECT c1, c2, c3, z, n, least(greatest((nt+0.5e0)/(n+1e0), 0.001e0), 0.999e0) AS e, least(greatest((ny+0.5e0)/(nt+1e0), 0.001e0), 0.999e0) AS p1 "
      "FROM (SELECT c1, c2, c3, z, CAST(count(*) AS DOUBLE) AS n, CAST(sum(t) AS DOUBLE) AS nt, CAST(sum(CASE WHEN t = 1 AND y_obs = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS ny FROM u GROUP BY ALL)))")


@query("j15_grid_join", W + V1 + ", " + Z5 + ", " + grid_sql([1.5, 3.0], "z5") + ", " + box_sql("gamma", "gg") + f" SELECT gamma, z, {r('sum(n*lo)/sum(n)', 'mean_lo')}, {r('sum(n*hi)/sum(n)', 'mean_hi')} FROM bx GROUP BY gamma, z")
def _(spark, d):
    g = nu.by_decision_maker(lineitem_units(spark, d), CELLS, "z", "t", "y_obs")
    g = g.withColumn("gamma", F.explode(F.array(F.lit(1.5), F.lit(3.0))))
    lo, hi = s.box("p1", "e", F.col("gamma"))
    return out(g.groupBy("gamma", "z").agg((F.sum(F.col("n") * lo) / F.sum("n")).alias("mean_lo"), (F.sum(F.col("n") * hi) / F.sum("n")).alias("mean_hi")))


@query("j16_anti_join", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def _(spark, d):
    pending = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    c = table(spark, d, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return out(c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")))


@query("j17_union", """SELECT run, count(*) AS n, round(sum(amount), 2) + 0e0 AS amount, count(status) AS n_status FROM (SELECT 'events' AS run, value AS amount, NULL AS status FROM events
  UNION ALL SELECT 'orders', o_totalprice, o_orderstatus FROM orders) GROUP BY run""")
def _(spark, d):
    a = table(spark, d, "events").select(F.lit("events").alias("run"), F.col("value").alias("amount"))
    b = table(spark, d, "orders").select(F.lit("orders").alias("run"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    u = a.unionByName(b, allowMissingColumns=True)
    return out(u.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.count("status").alias("n_status")))


@query("j18_attrition", W + EXAM + """, f AS (SELECT arg_min(okey, (odate, okey)) AS okey FROM ex GROUP BY ckey, year(odate)), a AS (SELECT ex.* FROM ex JOIN f USING (okey)), b AS (SELECT * FROM a WHERE NOT (y <> 1 AND followup < 365)),
  s AS (SELECT 0 AS step, 'exams' AS rule, count(*) AS n, count(DISTINCT ckey) AS m FROM ex UNION ALL SELECT 1, 'first_per_year', count(*), count(DISTINCT ckey) FROM a UNION ALL SELECT 2, 'window', count(*), count(DISTINCT ckey) FROM b)
  SELECT CAST(step AS BIGINT) AS step, rule, coalesce(lag(n) OVER (ORDER BY step), n) AS n_before, n AS n_after, coalesce(lag(n) OVER (ORDER BY step), n) - n AS n_dropped, m AS n_subjects FROM s""")
def _(spark, d):
    e = exams(spark, d)
    a = co.first_per_year(e, "ckey", "odate", "okey")
    t = co.attrition({"exams": e, "first_per_year": a, "window": co.classifiable(a, "y", "followup", 365)}, "ckey")
    return out(t.select("step", "rule", "n_before", "n_after", "n_dropped", "n_subjects"))


# --- features -----------------------------------------------------------------------

@query("f1_standardise", W + V1 + f" SELECT z, {r('avg((qty-mq)/sq)', 'qty')}, {r('avg((price-mp)/sp)', 'price')} FROM u, (SELECT avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM u) GROUP BY z")
def _(spark, d):
    x = ft.standardise(lineitem_units(spark, d).select("z", "qty", "price"), ["qty", "price"])
    return out(x.groupBy("z").agg(F.avg("qty").alias("qty"), F.avg("price").alias("price")))


HOLE = "hh AS (SELECT *, CASE WHEN okey % 7 <> 0 THEN bal END AS b, CASE WHEN okey % 11 <> 0 THEN price END AS p FROM ov)"


def holed(spark, d):
    return order_units(spark, d).withColumns({"b": F.when(F.col("okey") % 7 != 0, F.col("bal")), "p": F.when(F.col("okey") % 11 != 0, F.col("price"))})


@query("f2_median_impute", W + V3 + ", " + HOLE + f", m AS (SELECT quantile_cont(b, 0.5) AS mb, quantile_cont(p, 0.5) AS mp FROM hh WHERE {hu('okey', 'train')} < 0.7e0) SELECT segment, {r('avg(coalesce(b, mb))', 'b')}, {r('avg(coalesce(p, mp))', 'p')}, {r('avg(CAST(b IS NULL AS DOUBLE))', 'm_b')} FROM hh, m GROUP BY segment")
def _(spark, d):
    h = holed(spark, d)
    med = ft.fit_medians(h.filter(unit_interval("okey", "train") < 0.7), ["b", "p"])
    x = ft.impute(h, med, "m_")
    return out(x.groupBy("segment").agg(F.avg("b").alias("b"), F.avg("p").alias("p"), F.avg("m_b").alias("m_b")))


@query("f3_one_hot", W + V3 + ' SELECT segment, ' + ", ".join(f"CAST(sum(CAST(priority = '{p}' AS INT)) AS DOUBLE) AS \"{n}\"" for p, n in (
    ("2-HIGH", "priority_2-HIGH"), ("3-MEDIUM", "priority_3-MEDIUM"), ("4-NOT SPECIFIED", "priority_4-NOT_SPECIFIED"), ("5-LOW", "priority_5-LOW"))) + " FROM ov GROUP BY segment")
def _(spark, d):
    x = ft.one_hot(order_units(spark, d).select("segment", "priority"), "priority")
    cols = [c for c in x.columns if c.startswith("priority_")]
    return out(x.groupBy("segment").agg(*[F.sum(f"`{c}`").alias(c) for c in cols]))


@query("f4_log_money", W + V3 + f" SELECT segment, {r('avg(ln(1e0+greatest(bal, 0e0)))', 'log_bal')} FROM ov GROUP BY segment")
def _(spark, d):
    return out(order_units(spark, d).groupBy("segment").agg(F.avg(ft.log_money("bal")).alias("log_bal")))


@query("f5_ordinal_map", W + V3 + " SELECT priority, max(CASE priority WHEN '1-URGENT' THEN 0e0 WHEN '2-HIGH' THEN 1e0 WHEN '3-MEDIUM' THEN 2e0 WHEN '4-NOT SPECIFIED' THEN 3e0 END) AS level, max(CAST(priority = '5-LOW' AS DOUBLE)) AS unknown, count(*) AS n FROM ov GROUP BY priority")
def _(spark, d):
    v, miss = ft.ordinal("priority", {"1-URGENT": 0.0, "2-HIGH": 1.0, "3-MEDIUM": 2.0, "4-NOT SPECIFIED": 3.0})
    x = order_units(spark, d).select("priority", v.alias("level"), miss.alias("unknown"))
    return out(x.groupBy("priority").agg(F.max("level").alias("level"), F.max("unknown").alias("unknown"), F.count(F.lit(1)).alias("n")))


@query("f6_label_digits", """SELECT p_brand AS brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS digits, CAST(strpos('ABCDEFG', upper(substr(p_brand, 1, 1))) - 1 AS BIGINT) AS letter,
  CAST((strpos('ABCDEFG', upper(substr(p_brand, 1, 1))) - 1) * 5 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS BIGINT) AS grade, count(*) AS n FROM part GROUP BY p_brand""")
def _(spark, d):
    letter, number, grade = ft.letter_grade("p_brand")
    x = table(spark, d, "part").select(F.col("p_brand").alias("brand"), ft.digits("p_brand").alias("digits"), letter.alias("letter"), grade.alias("grade"))
    return out(x.groupBy("brand", "digits", "letter", "grade").agg(F.count(F.lit(1)).alias("n")))


@query("f7_demographics", "SELECT o_orderkey AS okey, CAST(20 + c_custkey % 60 + year(o_orderdate) - 1995 AS BIGINT) AS age_at_record, CASE c_custkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 END AS sex_male FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 9) ON o_custkey = c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 10 <> 9").select(
        F.col("c_custkey").alias("subject"), (20 + F.col("c_custkey") % 60).alias("anchor_age"), F.lit(1995).alias("anchor_year"),
        F.when(F.col("c_custkey") % 3 == 0, " m").when(F.col("c_custkey") % 3 == 1, "F").otherwise("x").alias("gender"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("subject"), "o_orderdate")
    return out(ft.demographics(o, c, subject="subject", ts="o_orderdate").select("okey", "age_at_record", "sex_male"))


ITEM_RULES = {"ring": (r"ring$", "economy"), "red": (r"^red", None), "widget": (r"(^|[^a-z])widget([^a-z]|$)", "standard")}


@query("f8_resolve_items", "SELECT analyte, p_partkey FROM (SELECT 'ring' AS analyte, p_partkey FROM part WHERE regexp_matches(lower(p_name), 'ring$') AND lower(p_type) = 'economy' UNION ALL SELECT 'red', p_partkey FROM part WHERE regexp_matches(lower(p_name), '^red') "
       "UNION ALL SELECT 'widget', p_partkey FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z])widget([^a-z]|$)') AND lower(p_type) = 'standard')")
def _(spark, d):
    return out(ft.resolve_items(table(spark, d, "part"), ITEM_RULES, item="p_partkey", label="p_name", fluid="p_type", strict=False))


def last_value_sql(k, h):
    return f"{k[0]}x AS (SELECT l.event_id, CASE WHEN l.tat - c.tat <= {h * HOUR} THEN c.value END AS v FROM l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = '{k}') c ON l.subject = c.subject AND l.tat >= c.tat)"


LABS = W + EV + ", " + LV + ", " + last_value_sql("click", 24) + ", " + last_value_sql("error", 24)


def lab_block(spark, d):
    return ft.latest_values(events(spark, d, "view"), events(spark, d), by="subject", time="at", event_time="at", kind="event_type",
                            value="value", kinds=["click", "error"], hours=24)


@query("f9_latest_values", LABS + f" SELECT event_id, {r('cx.v', 'lab_click')}, CAST(cx.v IS NULL AS DOUBLE) AS lab_click_missing, {r('ex.v', 'lab_error')}, CAST(ex.v IS NULL AS DOUBLE) AS lab_error_missing FROM cx JOIN ex USING (event_id)")
def _(spark, d):
    return out(lab_block(spark, d).select("event_id", "lab_click", "lab_click_missing", "lab_error", "lab_error_missing"))


SETTING = W + EV + ", " + SPANS + ", " + LV + f""", ed AS (SELECT subject, start, CASE WHEN k % 9 <> 0 THEN stop END AS stop FROM sp), st AS (SELECT subject, tat AS start, tat + k * {HOUR} AS stop FROM ev WHERE event_type = 'error'),
  a AS (SELECT l.event_id, l.subject, l.tat, ed.start AS es, ed.stop AS ee FROM l ASOF LEFT JOIN ed ON l.subject = ed.subject AND l.tat >= ed.start), b AS (SELECT a.*, st.start AS ss, st.stop AS se FROM a ASOF LEFT JOIN st ON a.subject = st.subject AND a.tat >= st.start),
  c AS (SELECT event_id, es IS NOT NULL AND (ee IS NULL OR tat <= ee) AS ed, ss IS NOT NULL AND (se IS NULL OR tat <= se) AS inn FROM b)"""


@query("f10_care_setting", SETTING + " SELECT event_id, CAST(ed AS DOUBLE) AS setting_ed, CAST(inn AND NOT ed AS DOUBLE) AS setting_inpatient, CAST(NOT ed AND NOT inn AS DOUBLE) AS setting_outpatient FROM c")
def _(spark, d):
    ed = signup_spans(spark, d).select("subject", "start", F.when(F.col("k") % 9 != 0, F.col("stop")).alias("stop"))
    st = events(spark, d, "error").select("subject", F.col("at").alias("start"), (F.col("at") + F.col("k") * HOUR).alias("stop"))
    x = ft.care_setting(events(spark, d, "view"), ed, st, by="subject", time="at")
    return out(x.select("event_id", "setting_ed", "setting_inpatient", "setting_outpatient"))


@query("f11_interval_features", """WITH m AS (SELECT z5 AS z, rr, qs - po AS pr, qe - qs AS qrs, te - qs AS qt FROM (SELECT l_suppkey % 5 AS z5, l_extendedprice / 50 AS rr, l_quantity * 2 AS po, l_quantity * 6 + 20 AS qs, l_quantity * 8 + 30 AS qe, l_quantity * 14 + 100 AS te FROM lineitem)),
  q AS (SELECT z, CASE WHEN rr BETWEEN 200 AND 3000 THEN rr END AS rr, CASE WHEN pr BETWEEN 40 AND 500 THEN pr END AS pr, CASE WHEN qrs BETWEEN 20 AND 300 THEN qrs END AS qrs, CASE WHEN qt BETWEEN 100 AND 800 THEN qt END AS qt FROM m), c AS (SELECT *, qt / sqrt(rr / 1000) AS qtc FROM q)
  SELECT z, """ + ", ".join([r("avg(rr)", "ecg_rr"), r("avg(pr)", "ecg_pr"), r("avg(qrs)", "ecg_qrs"), r("avg(qt)", "ecg_qt"), r("avg(CASE WHEN qtc BETWEEN 100 AND 1000 THEN qtc END)", "ecg_qtc")]) + " FROM c GROUP BY z")
def _(spark, d):
    q = F.col("l_quantity")
    m = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("z"), (F.col("l_extendedprice") / 50).alias("rr_interval"), (q * 2).alias("p_onset"),
        (q * 6 + 20).alias("qrs_onset"), (q * 8 + 30).alias("qrs_end"), (q * 14 + 100).alias("t_end"),
        *[F.lit(0.0).alias(c) for c in ("p_axis", "qrs_axis", "t_axis")])
    x = ft.interval_features(m)
    cols = ["ecg_rr", "ecg_pr", "ecg_qrs", "ecg_qt", "ecg_qtc"]
    return out(x.groupBy("z").agg(*[F.avg(c).alias(c) for c in cols]))


ASSEMBLE = LABS + ", bl AS (SELECT event_id, cx.v AS lc, CAST(cx.v IS NULL AS DOUBLE) AS lcm, ex.v AS le, CAST(ex.v IS NULL AS DOUBLE) AS lem FROM cx JOIN ex USING (event_id)), md AS (SELECT quantile_cont(lc, 0.5) AS mc, quantile_cont(le, 0.5) AS me FROM bl)"


@query("f12_assemble", ASSEMBLE + f" SELECT l.event_id, {r('coalesce(lc, mc)', 'lab_click')}, lcm AS lab_click_missing, {r('coalesce(le, me)', 'lab_error')}, lem AS lab_error_missing, {r('l.value', 'own_value')} FROM l JOIN bl USING (event_id), md")
def _(spark, d):
    views = events(spark, d, "view").select("event_id", "value")
    blocks = {"labs": lab_block(spark, d).select("event_id", "lab_click", "lab_click_missing", "lab_error", "lab_error_missing"),
              "own": views.select("event_id", F.col("value").alias("own_value"))}
    return out(ft.assemble(views.select("event_id"), blocks, "event_id"))


@query("f14_median_split", W + V1 + f", m AS (SELECT quantile_cont(price, 0.5) AS md FROM u WHERE t = 1) SELECT z, {r('avg(CASE WHEN t = 1 THEN CAST(price > md AS DOUBLE) END)', 'share')}, count(*) FILTER (WHERE t = 0) AS n_censored FROM u, m GROUP BY z")
def _(spark, d):
    x = ft.median_split(lineitem_units(spark, d).select("z", "price", "t"), "price", "t")
    return out(x.groupBy("z").agg(F.avg("y").alias("share"), F.count(F.when(F.col("y").isNull(), 1)).alias("n_censored")))


@query("f15_keyword_flags", "SELECT doc_id, CAST(contains(lower(text), 'the') AS BIGINT) AS has_the, CAST(regexp_matches(lower(text), '(no|not|without) ') AS BIGINT) AS has_cue, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(lower(text), 'the|les|und')")
def _(spark, d):
    t = F.lower("text")
    x = table(spark, d, "documents").filter(t.rlike("the|les|und"))
    return out(x.select("doc_id", t.contains("the").alias("has_the"), t.rlike("(no|not|without) ").alias("has_cue"), F.length("text").cast("bigint").alias("n")))


@query("f16_block_profile", W + V3 + ", " + HOLE + " SELECT (SELECT count(*) FROM hh) AS n, x.c AS \"column\", x.m AS missing FROM (SELECT 'b' AS c, round(avg(CAST(b IS NULL AS DOUBLE)), 6) AS m FROM hh UNION ALL SELECT 'p', round(avg(CAST(p IS NULL AS DOUBLE)), 6) FROM hh UNION ALL SELECT 'price', 0e0) x")
def _(spark, d):
    return out(ft.block_profile(holed(spark, d).select("okey", "b", "p", "price"), "okey"))


@query("f17_vector_columns", "SELECT vec_id, " + ", ".join(r(f"embedding[{i + 1}]", f"emb_{i}") for i in range(0, 64, 9)) + " FROM embeddings")
def _(spark, d):
    x = ft.vector_columns(table(spark, d, "embeddings"), "embedding", 64)
    return out(x.select("vec_id", *[f"emb_{i}" for i in range(0, 64, 9)]))


DERIVE = W + V3 + ", " + HOLE + """, m AS (SELECT quantile_cont(b, 0.5) AS mb, quantile_cont(p, 0.5) AS mp FROM hh), f AS (SELECT hh.*, coalesce(b, mb) AS fb, coalesce(p, mp) AS fp FROM hh, m),
  st AS (SELECT avg(fb) AS ab, stddev_pop(fb) AS sb, avg(fp) AS ap, stddev_pop(fp) AS spp FROM f)"""


def derived(spark, d):
    return co.derive_units(holed(spark, d).drop("z").withColumn("seg", F.col("segment")), centre="seg", decision="t", outcome="y",
                           covariates={"b": F.col("b"), "p": F.col("p"), "own": F.col("price") * 0 + F.col("okey")})


@query("f18_derive_units", DERIVE + f" SELECT segment, dense_rank() OVER (ORDER BY segment) - 1 AS z, count(*) AS n, {r('avg((fb-ab)/sb)', 'x_b')}, {r('avg((fp-ap)/spp)', 'x_p')}, {r('avg(CAST(b IS NULL AS DOUBLE))', 'm_b')}, {r('avg(CASE WHEN t = 1 THEN y END)', 'y_obs')} FROM f, st GROUP BY segment")
def _(spark, d):
    x, _ = derived(spark, d)
    return out(x.groupBy("segment", "z").agg(F.count(F.lit(1)).alias("n"), F.avg("x_b").alias("x_b"), F.avg("x_p").alias("x_p"),
                                             F.avg("m_b").alias("m_b"), F.avg("y_obs").alias("y_obs")))


@query("f18_standardisation_record", DERIVE + " SELECT 'x_b' AS feature, " + ", ".join([r("ab", "mean"), r("sb", "std"), r("mb", "impute_median")]) + ", (SELECT count(*) FROM hh WHERE b IS NULL) AS n_missing FROM st, m UNION ALL SELECT 'x_p', "
       + ", ".join([r("ap", "mean"), r("spp", "std"), r("mp", "impute_median")]) + ", (SELECT count(*) FROM hh WHERE p IS NULL) FROM st, m")
def _(spark, d):
    _, record = derived(spark, d)
    return out(record.filter("feature IN ('x_b', 'x_p')"))


@query("f19_block_bundle", ASSEMBLE + f" SELECT count(*) AS n, {r('avg(coalesce(lc, mc))', 'lab_click')}, {r('avg(l.value)', 'own_value')} FROM l JOIN bl USING (event_id), md")
def _(spark, d):
    builders = {"labs": (["views", "all"], lambda v, a: ft.latest_values(v, a, by="subject", time="at", event_time="at", kind="event_type", value="value",
                                                                        kinds=["click", "error"], hours=24).select("event_id", "lab_click", "lab_error")),
                "own": (["views"], lambda v: v.select("event_id", F.col("value").alias("own_value"))),
                "absent": (["nothing"], lambda x: x)}
    views = events(spark, d, "view")
    blocks = ft.available_blocks(builders, {"views": views, "all": events(spark, d)})
    x = ft.assemble(views.select("event_id"), blocks, "event_id")
    return out(x.agg(F.count(F.lit(1)).alias("n"), F.avg("lab_click").alias("lab_click"), F.avg("own_value").alias("own_value")))


# --- cohorts ----------------------------------------------------------------------------

CUST = """li AS (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY 1), cu AS (SELECT o_orderkey AS okey, date_diff('day', o_orderdate, ship) / 10e0 AS custody, CAST(o_totalprice > 250000 AS DOUBLE) AS rec,
  CAST(o_orderkey % 3 = 0 AS INT) AS event, o_custkey % 100 AS start, o_custkey % 100 + o_orderkey % 900 AS endd, o_orderpriority AS degree, o_totalprice AS priors FROM orders JOIN li ON o_orderkey = l_orderkey),
  cb AS (SELECT *, CAST(custody <= 2 AS INT) AS t FROM cu WHERE custody <= 180 AND degree <> '5-LOW')"""


def custody_table(spark, d):
    """Orders as custody spells: shipped-minus-ordered tenth-days, an event and a time at risk."""
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    o = table(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    jail = F.timestamp_micros(tm.micros("o_orderdate"))
    days = F.date_diff("ship", "o_orderdate") / 10.0
    return o.select(
        F.col("o_orderkey").alias("okey"), jail.alias("c_jail_in"), F.timestamp_micros((tm.micros("o_orderdate") + (days * DAY)).cast("bigint")).alias("c_jail_out"),
        (F.col("o_totalprice") > 250000).cast("double").alias("two_year_recid"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("event"),
        (F.col("o_custkey") % 100).alias("start"), (F.col("o_custkey") % 100 + F.col("o_orderkey") % 900).alias("end"),
        F.lit(0).alias("days_b_screening_arrest"), F.lit(1).alias("is_recid"), F.when(F.col("o_orderpriority") == "5-LOW", "O").otherwise(F.col("o_orderpriority")).alias("c_charge_degree"),
        F.lit("High").alias("score_text"), F.col("o_totalprice").alias("priors"))


COURT = dict(numeric=["priors"], categorical=["c_charge_degree"])


@query("c1_court_cohort", W + CUST + """, k AS (SELECT *, CAST(event = 1 AND endd - start <= 540 AS DOUBLE) AS y FROM cb WHERE endd - start >= 540 OR event = 1), s AS (SELECT avg(priors) AS m, stddev_pop(priors) AS sd FROM k)
  SELECT degree, CAST(t AS BIGINT) AS t, count(*) AS n, round(avg(y), 6) + 0e0 AS rate, round(avg((priors - m) / sd), 6) + 0e0 AS x_priors FROM k, s GROUP BY degree, t""")
def _(spark, d):
    c = co.court_cohort(custody_table(spark, d), outcome="exposure_adjusted", window=540, **COURT)
    return out(c.groupBy(F.col("c_charge_degree").alias("degree"), "t").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg("x_priors").alias("x_priors")))


@query("c2_time_at_risk", W + CUST + """, g AS (SELECT cb.*, w FROM cb, (VALUES (0), (365), (540), (730)) v(w)), k AS (SELECT *, w = 0 OR endd - start >= w OR event = 1 AS kept, CASE WHEN w = 0 THEN rec ELSE CAST(event = 1 AND endd - start <= w AS DOUBLE) END AS y FROM g),
  o AS (SELECT w, avg(CASE WHEN t = 0 AND kept THEN y END) AS p0, avg(CASE WHEN t = 1 AND kept THEN y END) AS p1, avg(CAST(kept AS DOUBLE)) AS kept, avg(CASE WHEN t = 1 THEN CAST(kept AS DOUBLE) END) AS k1, avg(CASE WHEN t = 0 THEN CAST(kept AS DOUBLE) END) AS k0, count(*) FILTER (WHERE kept) AS n FROM k GROUP BY w)
  SELECT CAST(w AS BIGINT) AS "window", """ + ", ".join([r("kept"), r("k1", "kept_selected"), r("k0", "kept_censored"), "n AS n_kept", r("(p0/(1-p0))/(p1/(1-p1))", "odds_ratio")]) + " FROM o")
def _(spark, d):
    base = co.court_base(custody_table(spark, d)).withColumn("y", F.col("two_year_recid"))
    return out(co.time_at_risk_audit(base, (365, 540, 730)))


@query("c2_custody_quantiles", W + CUST + f" SELECT CAST(t AS BIGINT) AS t, {r('quantile_cont(custody, 0.5)', 'median')}, {r('quantile_cont(custody, 0.9)', 'q90')}, count(*) AS n FROM cb GROUP BY t")
def _(spark, d):
    return out(co.custody_quantiles(co.court_base(custody_table(spark, d))))


@query("c3_card_cohort", W + V3 + f""", m AS (SELECT quantile_cont(price, 0.5) AS md FROM ov WHERE t = 1), s AS (SELECT avg(bal) AS mb, stddev_pop(bal) AS sb, avg(CAST(segment = 'MACHINERY' AS DOUBLE)) AS mm, stddev_pop(CAST(segment = 'MACHINERY' AS DOUBLE)) AS sm FROM ov)
  SELECT z, CAST(t AS BIGINT) AS t, count(*) AS n, {r('avg(CASE WHEN t = 1 THEN CAST(price > md AS DOUBLE) END)', 'rate')}, {r('avg((bal-mb)/sb)', 'x_bal')}, {r("avg((CAST(segment = 'MACHINERY' AS DOUBLE)-mm)/sm)", 'x_segment_machinery')} FROM ov, m, s GROUP BY z, t""")
def _(spark, d):
    o = order_units(spark, d).drop("y", "y_obs")
    c = co.card_cohort(o, decision=F.col("t") == 1, share="price", numeric=["bal"], categorical=["segment"])
    return out(c.groupBy("z", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("y_obs").alias("rate"), F.avg("x_bal").alias("x_bal"), F.avg("x_segment_MACHINERY").alias("x_segment_machinery")))


SCALE = {"1-URGENT": 0.0, "2-HIGH": 1.0, "3-MEDIUM": 2.0, "4-NOT SPECIFIED": 3.0}


@query("c4_loan_features", W + V3 + ", pt AS (SELECT p_partkey, p_brand, p_size FROM part), lo AS (SELECT ov.*, p_brand, CAST(p_size AS DOUBLE) AS sz, CASE priority WHEN '1-URGENT' THEN 0e0 WHEN '2-HIGH' THEN 1e0 WHEN '3-MEDIUM' THEN 2e0 WHEN '4-NOT SPECIFIED' THEN 3e0 END AS emp, ln(1e0+greatest(bal,0e0)) AS lb FROM ov JOIN pt ON okey % (SELECT count(*) FROM part) = p_partkey), "
       "m AS (SELECT quantile_cont(emp, 0.5) AS me FROM lo), f AS (SELECT lo.*, coalesce(emp, me) AS fe FROM lo, m), st AS (SELECT avg(lb) AS a1, stddev_pop(lb) AS s1, avg(fe) AS a2, stddev_pop(fe) AS s2 FROM f) "
       f"SELECT segment, count(*) AS n, {r('avg((lb-a1)/s1)', 'x_bal')}, {r('avg((fe-a2)/s2)', 'x_employment')}, {r('avg(sz + 0.5e0*((strpos(' + chr(39) + 'ABCDEFG' + chr(39) + ', upper(substr(p_brand, 1, 1)))-1)*5 + CAST(regexp_extract(p_brand, ' + chr(39) + '([0-9]+)' + chr(39) + ', 1) AS INT)))', 's')} FROM f, st GROUP BY segment")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("rate"))
    n = part.count()
    o = order_units(spark, d).join(part, F.col("okey") % n == F.col("p_partkey"))
    x = co.loan_features(o, numeric=["bal", "price"], money=["bal"], term="p_brand", employment="priority", scale=SCALE,
                         verification="segment", rate="rate", grade="p_brand")
    return out(x.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("x_bal").alias("x_bal"), F.avg("x_employment").alias("x_employment"), F.avg("s").alias("s")))


@query("c5_emergency_cohort", W + EV + f""", st AS (SELECT event_id AS stay, subject, tat AS arrival, CASE k % 4 WHEN 0 THEN 'Chest pain' WHEN 1 THEN 'SOB' WHEN 2 THEN 'rash' ELSE 'fall, arm pain' END AS cc, k AS age, CASE WHEN k % 5 <> 0 THEN value END AS hr FROM ev WHERE event_type = 'view' AND k >= 18 AND k % 4 IN (0, 1, 3)),
  c AS (SELECT * FROM ev WHERE event_type = 'click'), tt AS (SELECT st.stay, max(CASE WHEN c.tat - arrival BETWEEN {-HOUR // 2} AND {6 * HOUR} THEN 1 ELSE 0 END) AS t FROM st LEFT JOIN c USING (subject) GROUP BY 1),
  m AS (SELECT quantile_cont(hr, 0.5) AS mh FROM st), dx AS (SELECT event_id AS stay, CAST(k % 3 = 0 AS DOUBLE) AS hit FROM ev WHERE event_type = 'view')
  SELECT stay, CAST(t AS BIGINT) AS t, CASE WHEN t = 1 THEN hit END AS y_obs, {r('coalesce(hr, mh)', 'hr')}, CAST(contains(lower(cc), 'chest pain') AS DOUBLE) AS cc_chest_pain FROM st JOIN tt USING (stay) JOIN dx USING (stay), m""")
def _(spark, d):
    k = F.col("k")
    v = events(spark, d, "view")
    stays = v.select(F.col("event_id").alias("stay"), "subject", F.col("at").alias("arrival"),
                     F.when(k % 4 == 0, "Chest pain").when(k % 4 == 1, "SOB").when(k % 4 == 2, "rash").otherwise("fall, arm pain").alias("complaint"),
                     k.alias("age"), F.when(k % 5 != 0, F.col("value")).alias("hr"))
    dx = v.select(F.col("event_id").alias("stay"), F.when(k % 3 == 0, "I21.4").otherwise("R07.9").alias("code"))
    c = co.emergency_cohort(stays, events(spark, d, "click"), dx, subject="subject", stay="stay", arrival="arrival", complaint="complaint",
                            words=["chest pain", "sob", "arm pain"], age="age", min_age=18, window_hours=6, test_time="at", code="code",
                            prefixes=("I21", "I22", "I200"), numeric=["hr"])
    return out(c.select("stay", "t", "y_obs", "hr", "cc_chest_pain"))


def linked(spark, d):
    studies = events(spark, d, "purchase").select("subject", F.col("at").alias("sat"), F.col("event_id").alias("sid"))
    u, v, a = decision_makers(spark, d)
    return co.linked_cohort(events(spark, d, "view").select("event_id", "subject", "at"), studies, by="subject", ident="event_id", time="at", study_time="sat", study_id="sid",
                            window=DAY, gap=DAY, units=u, services=v, stays=a, pad=-2 * DAY)


LINKED = (NEAR.replace(W, "WITH RECURSIVE ", 1) + f", cw AS (SELECT min(tat) + {2 * DAY} AS a, max(tat) - {2 * DAY} AS b FROM rr), cvd AS (SELECT nr.* FROM nr, cw WHERE tat BETWEEN a AND b), "
          + greedy_sql("cvd", DAY) + ", " + DM + ", " + dm_sql("gk"))


@query("c6_linked_cohort", LINKED + " SELECT event_id, t, nearest_id, z, z_source, CASE WHEN t = 1 THEN tat + gap END AS study_time FROM dm")
def _(spark, d):
    return out(linked(spark, d)[0].select("event_id", "t", "nearest_id", "z", "z_source", "study_time"))


@query("c6_linked_attrition", LINKED + """, s AS (SELECT 0 AS step, 'records' AS rule, count(*) AS n, count(DISTINCT subject) AS m FROM nr UNION ALL SELECT 1, 'coverage', count(*), count(DISTINCT subject) FROM cvd UNION ALL SELECT 2, 'min_gap', count(*), count(DISTINCT subject) FROM gk
  UNION ALL SELECT 3, 'selected', count(*), count(DISTINCT subject) FROM gk WHERE t = 1) SELECT CAST(step AS BIGINT) AS step, rule, n AS n_after, coalesce(lag(n) OVER (ORDER BY step), n) - n AS n_dropped, m AS n_subjects FROM s""")
def _(spark, d):
    return out(linked(spark, d)[1].select("step", "rule", "n_after", "n_dropped", "n_subjects"))


SCREEN_RULES = {
    "sex": lambda: ~F.col("segment").isNotNull(), "price_range": lambda: vd.in_range("price", 0, 1e9), "date_format": lambda: vd.bad_date_format("exam_date"),
}


def prepared(spark, d):
    return co.screening_prepare(exams(spark, d).drop("z").withColumn("centre", F.col("segment")), {k: v() for k, v in SCREEN_RULES.items()}, ident="okey",
                                subject="ckey", date="exam_date", centre="centre", decision="t", outcome="y", followup="followup", window=365,
                                covariates={"bal": F.col("bal")}, least=400)


PREP = W + EXAM + """, f AS (SELECT arg_min(okey, (odate, okey)) AS okey FROM ex GROUP BY ckey, year(odate)), a AS (SELECT ex.* FROM ex JOIN f USING (okey)), b AS (SELECT * FROM a WHERE NOT (y <> 1 AND followup < 365)), sx AS (SELECT avg(bal) AS m, stddev_pop(bal) AS sd FROM b)"""


@query("c8_screening_units", PREP + f" SELECT okey, dense_rank() OVER (ORDER BY segment) - 1 AS z, CAST(year(odate) AS BIGINT) AS exam_year, CAST(t AS BIGINT) AS t, y_obs, {r('(bal-m)/sd', 'x_bal')} FROM b, sx")
def _(spark, d):
    return out(prepared(spark, d)[0].select("okey", "z", "exam_year", "t", "y_obs", "x_bal"))


@query("c8_screening_counts")
def _(spark, d):
    return out(prepared(spark, d)[2].withColumn("n", F.col("n").cast("bigint")))


# --- contract, splits, guards ---------------------------------------------------------------

@query("p1_invariants", W + V1 + """ SELECT 'as_read' AS source, CAST(0 AS BIGINT) AS bad_t, CAST(0 AS BIGINT) AS selected_without_y, CAST(0 AS BIGINT) AS censored_with_y
  UNION ALL SELECT 'full_labels', CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FILTER (WHERE t = 0) FROM u""")
def _(spark, d):
    u = lineitem_units(spark, d)
    a = vd.selective_violations(u).withColumn("source", F.lit("as_read"))
    b = vd.selective_violations(u, y_obs="y").withColumn("source", F.lit("full_labels"))
    return out(a.unionByName(b).select("source", "bad_t", "selected_without_y", "censored_with_y"))


@query("p2_describe", W + V1 + f""", x AS (SELECT avg(CASE WHEN t=0 THEN y END) AS p0, avg(CASE WHEN t=1 THEN y END) AS p1 FROM u) SELECT (SELECT count(*) FROM u) AS n, CAST(3 AS BIGINT) AS d, (SELECT {r('avg(t)', 'v')} FROM u) AS selection_rate,
  {r('p1', 'observed_prevalence')}, (SELECT {r('avg(y)', 'v')} FROM u) AS true_prevalence, {r('p0', 'censored_prevalence')}, {r('(p0/(1-p0))/(p1/(1-p1))', 'odds_ratio')}, (SELECT count(DISTINCT z) FROM u) AS n_decision_makers FROM x""")
def _(spark, d):
    return out(vd.describe(lineitem_units(spark, d), z="z", d=3))


@query("p3_split", W + V1 + f""", x AS (SELECT CASE WHEN {hu('uid', 's0')} < 0.35e0 THEN 'test' ELSE 'train' END AS side, CASE WHEN {hu('uid', 's1')} < 0.5e0 THEN 'train' WHEN {hu('uid', 's1')} < 0.75e0 THEN 'calibration' ELSE 'test' END AS part, y FROM u)
  SELECT side, part, count(*) AS n, round(avg(y), 6) + 0e0 AS rate FROM x GROUP BY ALL""")
def _(spark, d):
    u = lineitem_units(spark, d).select(vd.split("uid", 0.35, "s0").alias("side"), vd.three_way("uid", "s1").alias("part"), "y")
    return out(u.groupBy("side", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")))


@query("p4_stratified_folds", W + V3 + f", f AS (SELECT segment, t, okey, (row_number() OVER (PARTITION BY segment, t ORDER BY {h32('okey', 'fold')}, okey) - 1) % 5 AS fold FROM ov) SELECT segment, CAST(t AS BIGINT) AS t, fold, count(*) AS n, CAST(sum(okey) AS BIGINT) AS keys FROM f GROUP BY ALL")
def _(spark, d):
    f = vd.stratified_folds(order_units(spark, d).select("segment", "t", "okey"), ["segment", "t"], "okey", 5, "fold")
    return out(f.groupBy("segment", "t", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("okey").alias("keys")))


@query("p5_subject_split", W + V3 + f" SELECT CASE WHEN {hu('ckey', 'subject/0/0')} < 0.3e0 THEN 'test' ELSE 'train' END AS side, count(*) AS n, count(DISTINCT ckey) AS subjects FROM ov GROUP BY 1")
def _(spark, d):
    sided, _ = vd.subject_split(order_units(spark, d).select("ckey", "t", "y_obs"), "ckey", y="y_obs")
    return out(sided.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ckey").alias("subjects")))


RULE_SQL = {"balance_range": "bal < -500 OR bal > 9000", "date_format": "okey % 97 = 0", "segment_enum": "segment NOT IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD', 'AUTOMOBILE')", "outcome_needs_followup": "y = 1 AND followup < 20"}


@query("p6_schema_rules", W + EXAM + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) AS n, array_to_string(list_sort(list(okey))[1:5], ',') AS first_ids FROM ex WHERE {c} HAVING count(*) > 0" for n, c in RULE_SQL.items()))
def _(spark, d):
    e = exams(spark, d).withColumn("exam_date", F.when(F.col("okey") % 97 == 0, F.lit("2019/01/01")).otherwise(F.col("exam_date")))
    rules = {"balance_range": vd.in_range("bal", -500, 9000), "date_format": vd.bad_date_format("exam_date"), "calendar": vd.bad_calendar_date("exam_date"),
             "segment_enum": ~F.col("segment").isin("MACHINERY", "BUILDING", "HOUSEHOLD", "AUTOMOBILE"),
             "outcome_needs_followup": (F.col("y") == 1) & (F.col("followup") < 20)}
    return out(vd.violations(e, rules, "okey").withColumn("first_ids", F.array_join(F.col("first_ids").cast("array<string>"), ",")))


def raw_exam_columns():
    """Orders as a raw screening table of text columns, faults included: column -> expression that both engines read."""
    cols = {"subject_id": "CASE WHEN okey % 211 = 0 THEN ' ' ELSE CAST(ckey AS STRING) END",
            "exam_date": "CASE WHEN okey % 97 = 0 THEN '2019/01/01' WHEN okey % 89 = 0 THEN '2019-02-30' ELSE '2019-03-04' END",
            "centre_id": "segment", "age": "CASE WHEN okey % 83 = 0 THEN '41.5' ELSE CAST(okey % 100 + 15 AS STRING) END",
            "sex": "CASE WHEN okey % 79 = 0 THEN 'X' WHEN okey % 2 = 0 THEN 'F' ELSE 'M' END",
            "followup_test_ordered": "CASE WHEN okey % 3 = 0 THEN '1' ELSE '0' END",
            "outcome": "CASE WHEN okey % 59 = 0 THEN '' WHEN okey % 5 = 0 THEN '1' ELSE '0' END",
            "followup_days": "CAST(okey % 400 AS STRING)"}
    cols |= {n: f"CAST({int(lo)} + okey % {int((hi - lo) * 1.02) + 2} AS STRING)" for n, (_, lo, hi) in typed.SCREENING_NUMBERS.items()}
    cols["bmi"] = f"CASE WHEN okey % 73 = 0 THEN 'n/a' WHEN okey % 71 = 0 THEN '' ELSE {cols['bmi']} END"
    cols |= {n: f"CAST(okey % {k + (n == 'exercise_freq')} AS STRING)" for n, k in typed.SCREENING_LEVELS.items()}
    cols |= {n: "CAST(okey % 2 AS STRING)" for n in typed.SCREENING_FLAGS}
    return cols | {"fh_cvd": "CASE WHEN okey % 61 = 0 THEN 'yes' ELSE '1' END"}


def contract_sql():
    """Rule -> condition over the raw text, stated rule by rule."""
    num = lambda c: f"TRY_CAST({c} AS DOUBLE)"
    bad = {"subject_id must be a non-empty string": "trim(subject_id) = ''", "centre_id must be a non-empty string": "trim(centre_id) = ''",
           "exam_date must be formatted YYYY-MM-DD": "NOT regexp_full_match(exam_date, '\\d{4}-\\d{2}-\\d{2}')",
           "exam_date is not a valid calendar date": "regexp_full_match(exam_date, '\\d{4}-\\d{2}-\\d{2}') AND TRY_CAST(exam_date AS DATE) IS NULL",
           "age must be an integer in [19, 110] (no missing)": f"{num('age')} IS NULL OR {num('age')} <> floor({num('age')}) OR {num('age')} NOT BETWEEN 19 AND 110",
           "sex must be one of ['F', 'M'] (no missing)": "sex NOT IN ('F', 'M')",
           "followup_days must be an integer in [0, None] (no missing)": f"{num('followup_days')} < 0",
           "outcome must be recorded wherever followup_test_ordered == 1": "followup_test_ordered = '1' AND outcome = ''",
           "outcome == 1 requires followup_days <= 365": f"outcome = '1' AND {num('followup_days')} > 365"}
    for n, (u, lo, hi) in typed.SCREENING_NUMBERS.items():
        bad[f"{n} must be numeric"] = f"{n} <> '' AND {num(n)} IS NULL"
        bad[f"{n} outside [{lo}, {hi}] {u}"] = f"{num(n)} < {lo} OR {num(n)} > {hi}"
    for n, k in typed.SCREENING_LEVELS.items():
        bad[f"{n} must be one of {list(range(k))}"] = f"{num(n)} >= {k}"
    for n in typed.SCREENING_FLAGS:
        bad[f"{n} must be one of [0, 1]"] = f"{n} NOT IN ('0', '1')"
    return bad


@query("p6_screening_contract", W + V3 + ", raw AS (SELECT okey, " + ", ".join(f"{e} AS {n}" for n, e in raw_exam_columns().items()) + " FROM ov) " + " UNION ALL ".join(
    "SELECT '" + n.replace("'", "''") + f"' AS rule, count(*) AS n, array_to_string(list_sort(list(okey))[1:5], ',') AS first_ids FROM raw WHERE {c} HAVING count(*) > 0" for n, c in contract_sql().items()))
def _(spark, d):
    raw = order_units(spark, d).select("okey", *[F.expr(e).alias(n) for n, e in raw_exam_columns().items()])
    found = typed.check(raw, typed.screening(), "okey")
    return out(found.withColumn("first_ids", F.array_join(F.col("first_ids").cast("array<string>"), ",")))


@query("p7_forbidden_columns", W + V1 + " SELECT z, round(avg(qty), 6) + 0e0 AS qty, round(avg(tax), 6) + 0e0 AS tax FROM u GROUP BY z")
def _(spark, d):
    u = lineitem_units(spark, d)
    allowed = [c for c in u.columns if vd.forbidden_pattern(c) is None]
    vd.refuse_forbidden(allowed)
    return out(u.groupBy("z").agg(*[F.avg(c).alias(c) for c in ("qty", "tax") if c in allowed]))


@query("p8_hidden_signal", W + V1 + """, g AS (SELECT qty, disc, tax, price FROM u), rk AS (SELECT *, (rank() OVER (ORDER BY price) + (SELECT 0)) AS r0 FROM g),
  m AS (SELECT price, qty, disc, tax, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2e0 AS rp, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2e0 AS rq,
    rank() OVER (ORDER BY disc) + (count(*) OVER (PARTITION BY disc) - 1) / 2e0 AS rd, rank() OVER (ORDER BY tax) + (count(*) OVER (PARTITION BY tax) - 1) / 2e0 AS rt FROM g)
  SELECT 'qty' AS feature, round(corr(qty, price), 6) AS pearson, round(corr(rq, rp), 6) AS spearman FROM m UNION ALL SELECT 'disc', round(corr(disc, price), 6), round(corr(rd, rp), 6) FROM m UNION ALL SELECT 'tax', round(corr(tax, price), 6), round(corr(rt, rp), 6) FROM m""")
def _(spark, d):
    return out(vd.correlations(lineitem_units(spark, d).select("qty", "disc", "tax", "price"), ["qty", "disc", "tax"], "price"))


@query("p9_aggregate_guard", W + V3 + " SELECT segment, count(*) AS n, round(avg(y), 6) + 0e0 AS rate FROM ov GROUP BY segment")
def _(spark, d):
    agg = order_units(spark, d).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return out(vd.refuse_unit_level(agg, ["okey", "ckey", "subject_id"]))


# --- disclosure --------------------------------------------------------------------------------

@query("k1_count_cell", W + V3 + " SELECT z, priority, CASE WHEN n >= 120 THEN n END AS n, CAST(n < 120 AS BIGINT) AS suppressed FROM (SELECT z, priority, count(*) AS n FROM ov GROUP BY ALL)")
def _(spark, d):
    c = dc.unit_counts(order_units(spark, d), ["z", "priority"])
    return out(c.select("z", "priority", dc.count_cell("n", 120).alias("c")).select("z", "priority", "c.n", "c.suppressed"))


@query("k2_partition", W + V3 + """, c AS (SELECT CAST(z AS VARCHAR) AS z, count(*) AS n FROM ov GROUP BY 1), f AS (SELECT *, n < 520 AS hid, count(*) FILTER (WHERE n < 520) OVER () AS k FROM c),
  g AS (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY n, z) AS rn FROM f) SELECT z, CASE WHEN NOT hid AND NOT (k = 1 AND rn = 1) THEN n END AS n, CAST(hid OR (k = 1 AND rn = 1) AS BIGINT) AS suppressed FROM g""")
def _(spark, d):
    c = dc.unit_counts(order_units(spark, d).withColumn("z", F.col("z").cast("string")), ["z"])
    return out(dc.suppress_partition(c, "z", "n", least=520).select("z", "n", "suppressed"))


@query("k3_two_way")
def _(spark, d):
    c = dc.unit_counts(order_units(spark, d), ["segment", "z", "t"])
    x = dc.suppress_table(c, "z", "t", "n", table="segment", least=45)
    return out(x.select(F.col("tab").alias("segment"), F.col("row").alias("z"), F.col("col").alias("t"), "n", "suppressed", "reason"))


@query("k4_rate_cell", W + V3 + ", c AS (SELECT z, segment, CAST(sum(y) AS BIGINT) AS k, count(*) AS n FROM ov GROUP BY ALL), f AS (SELECT *, n >= 60 AND (k = 0 OR k >= 60) AND (n - k = 0 OR n - k >= 60) AS ok FROM c) "
       "SELECT z, segment, CASE WHEN ok THEN round(k / n, 6) + 0e0 END AS value, CASE WHEN ok THEN n END AS n, CAST(NOT ok AS BIGINT) AS suppressed FROM f")
def _(spark, d):
    c = order_units(spark, d).groupBy("z", "segment").agg(F.sum("y").cast("bigint").alias("k"), F.count(F.lit(1)).alias("n"))
    return out(c.select("z", "segment", dc.rate_cell("k", "n", 60).alias("c")).select("z", "segment", "c.value", "c.n", "c.suppressed"))


@query("k5_cohort_counts", W + EXAM + """ SELECT 'centre' AS "table", segment AS level, count(*) AS n FROM ex GROUP BY segment UNION ALL SELECT 'year', CAST(year(odate) AS VARCHAR), count(*) FROM ex GROUP BY 2
  UNION ALL SELECT 'decision', CAST(t AS VARCHAR), count(*) FROM ex GROUP BY 2""")
def _(spark, d):
    e = exams(spark, d).withColumn("exam_year", F.year("odate"))
    c = co.screening_counts(0, e, e, centre="segment", least=1)
    return out(c.filter(F.col("table").isin("centre", "year", "decision")).select("table", "level", "n"))


K5_PART = lambda name, level: f"SELECT '{name}' AS \"table\", CAST({level} AS VARCHAR) AS level, count(*) AS n FROM ex GROUP BY 2"


@query("k5_suppressed_counts", W + EXAM + ", al AS (" + " UNION ALL ".join(K5_PART(*p) for p in (("centre", "segment"), ("year", "year(odate)"), ("decision", "t"))) + """),
  hd AS (SELECT *, n < (SELECT count(*) // 8 FROM ex) AS hid FROM al), hk AS (SELECT *, count(*) FILTER (WHERE hid) OVER (PARTITION BY "table") AS k, row_number() OVER (PARTITION BY "table", hid ORDER BY n, level) AS rn FROM hd)
  SELECT "table", level, CASE WHEN NOT hid AND NOT (k = 1 AND rn = 1) THEN n END AS n, CAST(hid OR (k = 1 AND rn = 1) AS BIGINT) AS suppressed FROM hk""")
def _(spark, d):
    e = exams(spark, d).withColumn("exam_year", F.year("odate"))
    c = co.screening_counts(0, e, e, centre="segment", least=e.count() // 8)
    return out(c.filter(F.col("table").isin("centre", "year", "decision")).select("table", "level", "n", "suppressed"))


# --- summaries over runs ---------------------------------------------------------------------------

SEEDS = ", ".join(f"({i})" for i in range(5))
DRAW = "(CAST('0x' || substr(md5(CAST(okey AS VARCHAR) || '|' || 'seed/' || seed), 1, 8) AS BIGINT) / 4294967296e0)"
RUNS = W + V3 + f", dr AS (SELECT ov.*, seed, len(list_filter([{', '.join(f'{c!r}e0' for c in poisson_steps())}], lambda c: c <= {DRAW})) AS bw FROM ov, (VALUES {SEEDS}) t(seed)), rn AS (SELECT seed, segment, sum(bw*y)/sum(bw) AS v, sum(bw*price)/sum(bw) AS pr FROM dr GROUP BY ALL)"


def runs(spark, d):
    """Five bootstrap runs over all orders: every order has a Poisson(1) weight of its own in each."""
    o = order_units(spark, d).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    o = o.withColumn("bw", poisson1("okey", F.concat(F.lit("seed/"), F.col("seed").cast("string"))))
    mean = lambda c: F.sum(F.col("bw") * F.col(c)) / F.sum("bw")
    return o.groupBy("seed", "segment").agg(mean("y").alias("v"), mean("price").alias("pr"))


@query("e1_seed_interval", RUNS + f" SELECT segment, {r('avg(v)', 'mean')}, count(*) AS n, {r('2.7764451051977987e0*stddev_samp(v)/sqrt(count(*))', 'ci95')} FROM rn GROUP BY segment")
def _(spark, d):
    return out(ev.seed_interval(runs(spark, d), "v", keys=["segment"]).select("segment", "mean", "n", "ci95"))


CAL = W + V1N + ", cb AS (SELECT CAST(least(floor(p1*10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p1) AS mp, avg(y) AS sh FROM nu GROUP BY 1)"


@query("e2_calibration", CAL + f" SELECT bin, n, {r('mp', 'mean_p')}, {r('sh', 'share')}, {r('abs(mp-sh)', 'gap')} FROM cb")
def _(spark, d):
    return out(ev.calibration(lineitem_nuisance(spark, d), "p1", "y"))


@query("e2_calibration_error", CAL + f" SELECT {r('sum(n*abs(mp-sh))/sum(n)', 'ece')} FROM cb")
def _(spark, d):
    return out(ev.expected_calibration_error(ev.calibration(lineitem_nuisance(spark, d), "p1", "y")))


MIX = ("h0", "(h + 2654435769*(p + 1)) % 4294967296"), ("h1", "CAST(CAST(xor(h0, h0 >> 16) AS HUGEINT)*2246822507 % 4294967296 AS BIGINT)"), ("h2", "CAST(CAST(xor(h1, h1 >> 13) AS HUGEINT)*3266489909 % 4294967296 AS BIGINT)"), ("u", "xor(h2, h2 >> 16)/4294967296e0")
BOOT = (W + V3 + f", pw AS (SELECT y, CAST('0x' || substr(md5(CAST(okey AS VARCHAR) || '|replicates'), 1, 8) AS BIGINT) AS h, p, {', '.join(f'{e} AS {n}' for n, e in MIX)} FROM ov, range(120) t(p)), "
        f"wt AS (SELECT p, y, len(list_filter([{', '.join(f'{c!r}e0' for c in poisson_steps())}], lambda c: c <= u)) AS bw FROM pw), "
        "rp AS (SELECT CAST(p // 40 AS BIGINT) AS seed, sum(bw*y)/sum(bw) AS v FROM wt GROUP BY p), bo AS (SELECT seed, v FROM rp UNION ALL SELECT NULL, v FROM rp)")


@query("e3_bootstrap", BOOT + f" SELECT seed, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.025)', 'lo')}, {r('quantile_cont(v, 0.975)', 'hi')}, count(*) AS n_boot FROM bo GROUP BY seed")
def _(spark, d):
    sums = ev.replicate_sums(order_units(spark, d), "okey", {"y": "y"}, seeds=3, replicates=40)
    return out(ev.bootstrap_summary(sums.withColumn("rate", F.col("y") / F.col("bw")), "rate"))


@query("e4_loglog_fit", W + V3 + ", c AS (SELECT segment, ckey, count(*) AS n, sum(price) AS total FROM ov GROUP BY ALL) SELECT segment, " + ", ".join([r("regr_slope(ln(total), ln(n))", "slope"), r("regr_intercept(ln(total), ln(n))", "intercept"), r("regr_r2(ln(total), ln(n))", "r2")]) + " FROM c GROUP BY segment")
def _(spark, d):
    c = order_units(spark, d).groupBy("segment", "ckey").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return out(ev.loglog_fit(c, "n", "total", keys=["segment"]))


@query("e5_method_summary", RUNS + f", m AS (SELECT segment, regexp_replace(segment || '(seed=' || seed || ')', '\\(.*\\)', '') AS family, v FROM rn) SELECT family, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, count(*) AS n FROM m GROUP BY family")
def _(spark, d):
    return out(ev.method_summary(runs(spark, d).withColumn("method", F.concat("segment", F.lit("(seed="), F.col("seed"), F.lit(")"))), "method", "v"))


@query("e6_coverage_by_gamma", W + V1N + ", " + grid_sql([1.0, 2.0, 4.0], "nu") + ", " + box_sql("gamma", "gg") + ", " + sharp_sql("bx", "qty", "gamma, z") + ", tr AS (SELECT z, (sum(y*phi)-0.5e0*power(sum(y),2))/(sum(y)*(1e0-sum(y))) AS au FROM (SELECT z, sy/sum(w) OVER (PARTITION BY z) AS y, "
       "(sum(w) OVER (PARTITION BY z ORDER BY qty)-0.5e0*w)/sum(w) OVER (PARTITION BY z) AS phi FROM (SELECT z, qty, count(*) AS w, sum(y) AS sy FROM u GROUP BY ALL)) GROUP BY z) "
       f"SELECT gamma, {r('avg(CAST(au >= lower-1e-9 AND au <= upper+1e-9 AS DOUBLE))', 'coverage')}, {r('avg(upper-lower)', 'width')}, count(*) AS n FROM shp JOIN tr USING (z) GROUP BY gamma")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty", "z").withColumn("s", F.col("qty"))
    iv = gm.sweep(u, [1.0, 2.0, 4.0], weight="w", keys=["z"])
    truth = rk.auc(lineitem_units(spark, d).select("z", "qty", "y"), "qty", {"truth": "y"}, keys=["z"])
    return out(ev.coverage_by(iv.join(truth, "z"), "truth", ["gamma"]))


@query("e7_cross_tab", W + V3 + " SELECT segment, count(*) FILTER (WHERE t = 0) AS t0, count(*) FILTER (WHERE t = 1) AS t1 FROM ov GROUP BY segment")
def _(spark, d):
    x = order_units(spark, d).groupBy("segment").pivot("t", [0, 1]).count().na.fill(0)
    return out(x.select("segment", F.col("0").alias("t0"), F.col("1").alias("t1")))


@query("e8_seed_aggregation", RUNS + " " + " UNION ALL ".join(f"SELECT '{c}' AS metric, segment, {r(f'avg({c})', 'mean')}, {r(f'2.7764451051977987e0*stddev_samp({c})/sqrt(count(*))', 'ci95')}, count(*) AS n FROM rn GROUP BY segment" for c in ("v", "pr")))
def _(spark, d):
    long = runs(spark, d).select("segment", "seed", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("v", "pr")])))
    return out(ev.seed_interval(long, "value", keys=["metric", "segment"]).select("metric", "segment", "mean", "ci95", "n"))


# --- sources and sinks --------------------------------------------------------------------------------

@query("s1_contract_read", "SELECT o_orderstatus AS status, count(*) AS n, min(strftime(o_orderdate, '%Y-%m-%d')) AS first FROM orders GROUP BY 1")
def _(spark, d):
    o = reader.load(spark, f"{d}/orders.parquet", "orders", ("o_orderkey", "o_orderstatus", "o_orderdate"), columns=("o_orderstatus", "o_orderdate"), datetimes=("o_orderdate",))
    return out(o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first")))


@query("s2_layouts", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    path = reader.find(spark, [f"{d}/v1/orders.parquet", f"{d}/orders.parquet"], "orders")
    return out(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")))


@query("s3_optional_sources", "SELECT count(*) AS n FROM labels")
def _(spark, d):
    found = reader.find_any(spark, {"labels": [f"{d}/labels.parquet"], "more": [f"{d}/more_labels.parquet"]})
    return out(spark.read.parquet(found["labels"]).agg(F.count(F.lit(1)).alias("n")))


@query("s4_provenance", " UNION ALL ".join(f"SELECT '{t}' AS name, 'synthetic' AS source, count(*) AS n_rows, CAST({c} AS BIGINT) AS n_columns FROM {t}" for t, c in (("orders", 6), ("customer", 5), ("labels", 3))))
def _(spark, d):
    rows = [reader.provenance(table(spark, d, t), t, "synthetic") for t in ("orders", "customer", "labels")]
    return out(rows[0].union(rows[1]).union(rows[2]).select("name", "source", "n_rows", "n_columns"))


@query("s5_filtered_read", "SELECT event_type, count(*) AS n, round(sum(value), 4) + 0e0 AS total FROM events WHERE event_type IN ('click', 'error') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    cohort = e.filter("event_type = 'purchase' AND value > 100")
    x = reader.load_filtered(e.select("user_id", "event_type", "value"), cohort, "user_id", column="event_type", values=["click", "error"])
    return out(x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("s6_prepared_round_trip", W + V3 + " SELECT segment, count(*) AS n, round(sum(bal), 2) + 0e0 AS bal FROM ov GROUP BY segment")
def _(spark, d):
    path = f"{shared_folder(spark)}/prepared-{uuid.uuid4().hex}"
    sinks.write_prepared(order_units(spark, d).select("segment", "bal"), path, {"data_source": "synthetic", "rows": "orders"})
    units, _ = sinks.read_prepared(spark, path)
    return out(units.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bal"), 2).alias("bal")))


@query("s7_result_sink", W + V3 + " SELECT segment, count(*) AS n, 'synthetic' AS data_source FROM ov GROUP BY segment")
def _(spark, d):
    path = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    sinks.write_result(dc.unit_counts(order_units(spark, d), ["segment"]), path, "synthetic")
    return out(spark.read.schema("segment string, n bigint, data_source string").json(path))


@query("s8_interval_json", W + V1N + ", " + grid_sql([1.0, 2.0, 3.0], "nu") + ", " + box_sql("gamma", "gg") + ", " + sharp_sql("bx", "qty", "gamma") + f" SELECT gamma, {r('lower')}, {r('upper')} FROM shp")
def _(spark, d):
    t = gm.sweep(packed_lineitem(spark, d, "qty").withColumn("s", F.col("qty")), [1.0, 2.0, 3.0], weight="w")
    entry = F.struct(F.col("lower").alias("auroc_lo"), F.col("upper").alias("auroc_hi"))
    path = f"{shared_folder(spark)}/interval-{uuid.uuid4().hex}"
    t.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("gamma").cast("string"), entry))).alias("by_gamma"))).alias("value")).write.text(path)
    return out(reader.read_intervals(spark, path).select("gamma", "lower", "upper"))


@query("s9_measurement_discovery", "SELECT count(*) AS n, round(avg(l_quantity), 6) + 0e0 AS ivsd, round(avg(l_extendedprice), 6) + 0e0 AS lvef FROM lineitem")
def _(spark, d):
    aliases = {**contracts.MEASUREMENT_ALIASES, "ivsd": ("septum", "l_quantity"), "lvef": ("ef", "l_extendedprice")}
    path = f"{d}/lineitem.parquet"
    found = reader.measurement_tables(spark, [f"{d}/absent.csv", path], aliases=aliases, telling=contracts.TELLING_MEASUREMENTS)
    hit = found[path]
    x = spark.read.parquet(path).select(*[F.col(c).alias(m) for m, c in hit.items()])
    return out(x.agg(F.count(F.lit(1)).alias("n"), F.avg("ivsd").alias("ivsd"), F.avg("lvef").alias("lvef")))


@query("s11_review_csv", "SELECT CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'NA' ELSE CAST(n_chars AS VARCHAR) END AS cell, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    k = F.col("doc_id") % 3
    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(k == 0, "").when(k == 1, "NA").otherwise(F.col("n_chars").cast("string")).alias("cell"))
    path = f"{shared_folder(spark)}/review-{uuid.uuid4().hex}"
    c.write.option("header", True).csv(path)
    return out(reader.read_review(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
