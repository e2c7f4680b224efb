"""Nuisances, intervals, sensitivity analyses and learners."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from halfseen.catalog.base import (
    CELLS, V1, V1N, V2, V2N, V3, box_sql, cell_sql, document_nuisance, document_units, g_sql, grid_sql, h32, hu,
    lineitem_boxes, lineitem_nuisance, lineitem_units, order_units, out, packed_boxes, packed_lineitem, query, r,
    rates_sql, sharp_sql, table,
)
from halfseen.catalog.rank_queries import BAYES, ENT, EXPIT, LOGIT, WORST, cell_boxes, cells
from halfseen.catalog.table_queries import Z5
from halfseen.functions import quantiles as qt
from halfseen.functions import scalar as s
from halfseen.functions.hashing import bucket, unit_interval
from halfseen.operators import comparison as cm
from halfseen.operators import evaluation as ev
from halfseen.operators import features as ft
from halfseen.operators import gamma as gm
from halfseen.operators import intervals as iv
from halfseen.operators import learners as ln
from halfseen.operators import nuisance as nu
from halfseen.operators import objectives as ob
from halfseen.operators import ranking as rk
from halfseen.operators import temporal as tm
from halfseen.operators import validate as vd
from halfseen.operators.lineage import cut

W = "WITH "

# --- cell nuisances ------------------------------------------------------------------------


@query("m5_cell_nuisance", W + V1 + ", " + cell_sql() + f" SELECT c1, c2, c3, n, nt, ny, round(e, 9) + 0e0 AS e, round(p1, 9) + 0e0 AS p1 FROM cell")
def _(spark, d):
    return cells(spark, d).select(*CELLS, "n", "nt", "ny", s.r6("e", 9).alias("e"), s.r6("p1", 9).alias("p1"))


@query("m5_out_of_fold", W + V1 + f", f AS (SELECT *, {h32('uid', 'fold')} % 5 AS fold FROM u), c AS (SELECT c1, c2, c3, fold, count(*) AS n, sum(t) AS nt, sum(CASE WHEN t = 1 AND y_obs = 1 THEN 1 ELSE 0 END) AS ny FROM f GROUP BY ALL), "
       "o AS (SELECT c1, c2, c3, fold, n AS k, sum(n) OVER w - n AS n, sum(nt) OVER w - nt AS nt, sum(ny) OVER w - ny AS ny FROM c WINDOW w AS (PARTITION BY c1, c2, c3)) "
       f"SELECT fold, {r('sum(k*e)/sum(k)', 'e')}, {r('sum(k*p1)/sum(k)', 'p1')}, CAST(sum(k) AS BIGINT) AS n FROM (SELECT fold, k, {rates_sql()} FROM o) GROUP BY fold")
def _(spark, d):
    u = lineitem_units(spark, d).withColumn("fold", bucket("uid", "fold", 5))
    x = nu.out_of_fold(u, CELLS, "fold", "t", "y_obs")
    return out(x.groupBy("fold").agg(F.avg("e").alias("e"), F.avg("p1").alias("p1"), F.count(F.lit(1)).alias("n")))


@query("m5_documents", W + V2N + f" SELECT doc_id, {r('e')}, {r('p1')} FROM dn")
def _(spark, d):
    return out(document_nuisance(spark, d).select("doc_id", "e", "p1"))


@query("m6_nuisance_with_z", W + V1 + ", " + Z5 + f" SELECT z, {r('sum(n*e)/sum(n)', 'e')}, {r('sum(n*p1)/sum(n)', 'p1')}, count(*) AS cells FROM z5 GROUP BY z")
def _(spark, d):
    g = nu.by_decision_maker(lineitem_units(spark, d), CELLS, "z", "t", "y_obs")
    return out(g.groupBy("z").agg((F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("e"), (F.sum(F.col("n") * F.col("p1")) / F.sum("n")).alias("p1"), F.count(F.lit(1)).alias("cells")))


ZMARG = Z5 + ", sh AS (SELECT z, count(*) / sum(count(*)) OVER () AS pi FROM u GROUP BY z)"


@query("m7_predict_by_z", W + V1 + ", " + Z5 + f", a AS (SELECT c1, c2, c3, max(e) AS emax, min(e) AS emin, max(p1) AS pmax, min(p1) AS pmin, count(*) AS zs FROM z5 GROUP BY ALL) SELECT c1, c2, c3, zs, {r('emax')}, {r('emin')}, {r('pmax')}, {r('pmin')} FROM a")
def _(spark, d):
    a = z_cells(spark, d)
    get = lambda f, n: f(F.transform("zs", lambda z: z[n]))
    return out(a.select(*CELLS, F.size("zs").alias("zs"), get(F.array_max, "e").alias("emax"), get(F.array_min, "e").alias("emin"),
                        get(F.array_max, "p1").alias("pmax"), get(F.array_min, "p1").alias("pmin")))


@query("m7_full_grid", W + V1 + ", " + Z5 + ", " + cell_sql() + f""" SELECT c1, c2, c3, z, coalesce(z5.n, 0) + 0e0 AS n, {r('coalesce(z5.e, k.ke)', 'e')}, {r('coalesce(z5.p1, k.kp)', 'p1')}
  FROM (SELECT c1, c2, c3, e AS ke, p1 AS kp FROM cell) k CROSS JOIN (SELECT DISTINCT z FROM u) LEFT JOIN z5 USING (c1, c2, c3, z)""")
def _(spark, d):
    g = nu.full_grid(lineitem_units(spark, d), CELLS, "z", "t", "y_obs")
    return out(g.select(*CELLS, "z", F.col("n").cast("double").alias("n"), "e", "p1"))


@query("m8_marginalise_z", W + V1 + ", " + ZMARG + f", g AS (SELECT c1, c2, c3, sum(pi) AS w, sum(pi*e) AS se, sum(pi*e*p1) AS sp FROM z5 JOIN sh USING (z) GROUP BY ALL) SELECT c1, c2, c3, {r('se/w', 'e')}, {r('sp/se', 'p1')} FROM g")
def _(spark, d):
    u = lineitem_units(spark, d)
    share = u.groupBy("z").agg(F.count(F.lit(1)).alias("k"))
    total = u.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = share.select("z", (F.col("k") / total).alias("pi"))
    return out(nu.marginalise(nu.by_decision_maker(u, CELLS, "z", "t", "y_obs"), CELLS, share, "z").select(*CELLS, "e", "p1"))


@query("m10_ipw_weights", W + V1N + f" SELECT z, {r('sum(1e0/greatest(e, 0.02e0))', 'weight')}, {r('sum(y_obs/greatest(e, 0.02e0))/sum(1e0/greatest(e, 0.02e0))', 'rate')} FROM nu WHERE t = 1 GROUP BY z")
def _(spark, d):
    x = lineitem_nuisance(spark, d).filter("t = 1").withColumn("w", nu.ipw_weight("e"))
    return out(x.groupBy("z").agg(F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("y_obs")) / F.sum("w")).alias("rate")))


@query("m11_aipw_target", W + V1N + f" SELECT z, {r('avg(p1+t*(coalesce(y_obs,0e0)-p1)/greatest(e, 0.02e0))', 'target')} FROM nu GROUP BY z")
def _(spark, d):
    return out(lineitem_nuisance(spark, d).groupBy("z").agg(F.avg(nu.aipw_target("t", "y_obs", "e", "p1")).alias("target")))


@query("m12_imputation_target", W + V1N + f" SELECT z, {r('avg(CASE WHEN t = 1 THEN y_obs ELSE p1 END)', 'target')} FROM nu GROUP BY z")
def _(spark, d):
    return out(lineitem_nuisance(spark, d).groupBy("z").agg(F.avg(nu.imputation_target("t", "y_obs", "p1")).alias("target")))


@query("m13_manski", W + V1 + ", " + cell_sql() + f", b AS (SELECT c1, c2, c3, e*p1 AS lo, e*p1+1e0-e AS hi FROM cell) SELECT c1, c2, c3, {r('lo')}, {r('hi')}, {r(BAYES, 'score')} FROM b")
def _(spark, d):
    c = cell_boxes(spark, d, float("inf"))
    return out(c.select(*CELLS, "lo", "hi", s.bayes_score("lo", "hi").alias("score")))


@query("m14_plugin", W + V1N + ", " + grid_sql([1.0, 1.3, 2.0], "nu") + ", " + box_sql("gamma", "gg") + f", x AS (SELECT gamma, lo, hi, {BAYES} AS s FROM bx) SELECT gamma, {r('avg(s)', 'score')}, {r('avg(CAST(s = 0 AS DOUBLE))', 'abstention')}, {r('avg(' + WORST + ')', 'risk')} FROM x GROUP BY gamma")
def _(spark, d):
    u = packed_lineitem(spark, d).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in (1.0, 1.3, 2.0)])))
    lo, hi = s.box("p1", "e", F.col("gamma"))
    u = u.withColumns({"lo": lo, "hi": hi})
    u = u.withColumn("s", s.bayes_score("lo", "hi"))
    return out(u.groupBy("gamma").agg(ob.mean("s", "w").alias("score"), ob.mean((F.col("s") == 0).cast("double"), "w").alias("abstention"), ob.worst_case_risk(weight="w").alias("risk")))


@query("m20_prepare_fold", W + V1 + f", sp AS (SELECT *, {hu('uid', 'fold0')} < 0.35e0 AS te FROM u), tr AS (SELECT * FROM sp WHERE NOT te), " + cell_sql("tr", name="tc") + f" SELECT z, {r('avg(e)', 'e')}, {r('avg(p1)', 'p1')}, count(*) AS n FROM sp JOIN tc USING (c1, c2, c3) WHERE te GROUP BY z")
def _(spark, d):
    u = lineitem_units(spark, d).withColumn("side", vd.split("uid", 0.35, "fold0"))
    x = nu.with_nuisance(u.filter("side = 'test'"), CELLS, "t", "y_obs", fit=u.filter("side = 'train'"))
    return out(x.groupBy("z").agg(F.avg("e").alias("e"), F.avg("p1").alias("p1"), F.count(F.lit(1)).alias("n")))


# --- intervals ----------------------------------------------------------------------------------

def dr_sql(g):
    p, e = "least(greatest(p1,1e-6),1e0-1e-6)", "least(greatest(e,0.02e0),1e0)"
    plug = f"(t*coalesce(y_obs,0e0)+(1e0-t)*{g_sql(p, g)})"
    return plug, f"({plug}+(1e0-{e})*({g}/power(1e0+({g}-1e0)*{p},2))*t*(coalesce(y_obs,0e0)-{p})/{e})"


@query("i1_dr_functional", W + V1N + f" SELECT z, {r('avg(' + dr_sql('2e0')[1] + ')', 'estimate')}, {r('stddev_samp(' + dr_sql('2e0')[1] + ')/sqrt(count(*))', 'se')}, {r('avg(' + dr_sql('2e0')[0] + ')', 'plugin')} FROM nu GROUP BY z")
def _(spark, d):
    return out(iv.dr_functional(lineitem_nuisance(spark, d), 2.0, y="y_obs", keys=["z"]))


QZ = repr(qt.normal_ppf(1 - 0.05 / 4)) + "e0"
LO, HI = dr_sql("0.5e0"), dr_sql("2e0")


@query("i2_prevalence_bounds", W + V1N + f", x AS (SELECT avg({LO[1]}) AS a, stddev_samp({LO[1]})/sqrt(count(*)) AS sa, avg({LO[0]}) AS pa, avg({HI[1]}) AS b, stddev_samp({HI[1]})/sqrt(count(*)) AS sb, avg({HI[0]}) AS pb FROM nu) "
       f"SELECT {r('a', 'lo_estimate')}, {r('sa', 'lo_se')}, {r('pa', 'lo_plugin')}, {r('b', 'hi_estimate')}, {r('sb', 'hi_se')}, {r('pb', 'hi_plugin')}, {r(f'greatest(a-{QZ}*sa, 0e0)', 'outer_lo')}, {r(f'least(b+{QZ}*sb, 1e0)', 'outer_hi')} FROM x")
def _(spark, d):
    return out(iv.prevalence_bounds(lineitem_nuisance(spark, d), 2.0, y="y_obs"))


def rank_bin(v, n, src, ident="uid", name="bin", key="bins"):
    return f"CAST(least(floor((row_number() OVER (ORDER BY {v}, {hu(ident, key)}, {ident}) - 1) * {n} / (SELECT count(*) FROM {src})), {n - 1}) AS BIGINT) AS {name}"


CP_TAIL = lambda a, b, p: f"list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln({p})+(n-i)*ln(1e0-{p}))))"
CP_SQL = ("WITH RECURSIVE " + V1 + ", " + cell_sql() + f""", it AS (SELECT c1, c2, c3, CAST(nt AS BIGINT) AS k, CAST(n AS BIGINT) AS n, 0 AS i_, 0e0 AS l0, 1e0 AS l1, 0e0 AS h0, 1e0 AS h1 FROM cell
  UNION ALL SELECT c1, c2, c3, k, n, i_+1, CASE WHEN up < 0.025e0 THEN (l0+l1)/2 ELSE l0 END, CASE WHEN up < 0.025e0 THEN l1 ELSE (l0+l1)/2 END, CASE WHEN down > 0.025e0 THEN (h0+h1)/2 ELSE h0 END, CASE WHEN down > 0.025e0 THEN h1 ELSE (h0+h1)/2 END
  FROM (SELECT *, {CP_TAIL('k', 'n+1', '((l0+l1)/2)')} AS up, {CP_TAIL('0', 'k+1', '((h0+h1)/2)')} AS down FROM it WHERE i_ < 40)),
  cp AS (SELECT c1, c2, c3, k, n, CASE WHEN k = 0 THEN 0e0 ELSE l0 END AS lo, CASE WHEN k = n THEN 1e0 ELSE h1 END AS hi FROM it WHERE i_ = 40)
  SELECT c1, c2, c3, k, n, {r('lo', 'cp_lo')}, {r('hi', 'cp_hi')}, CAST(k/n BETWEEN lo AND hi AS BIGINT) AS covers_rate FROM cp""")


@query("i3_clopper_pearson", CP_SQL)
def _(spark, d):
    c = cells(spark, d).select(*CELLS, F.col("nt").cast("bigint").alias("k"), F.col("n").cast("bigint").alias("n"))
    x = iv.exact_binomial(c, "k", "n", 0.05)
    inside = s.contains(F.col("k") / F.col("n"), "cp_lo", "cp_hi").cast("int")
    return out(x.withColumn("covers_rate", inside))


@query("i4_equal_bins", W + V1 + ", b AS (SELECT price, " + rank_bin("price", 7, "u") + " FROM u) SELECT bin, count(*) AS n, round(min(price), 2) + 0e0 AS low, round(max(price), 2) + 0e0 AS high FROM b GROUP BY bin")
def _(spark, d):
    b = iv.equal_bins(lineitem_units(spark, d).select("uid", "price"), "price", 7, "uid")
    return out(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("price"), 2).alias("low"), F.round(F.max("price"), 2).alias("high")))


@query("i4_equal_bins_ties", W + V1 + ", b AS (SELECT qty, uid, " + rank_bin("qty", 8, "u") + f" FROM u) SELECT bin, count(*) AS n, {r('avg(qty)', 'mean_qty')}, CAST(sum({h32('uid', 'check')}) AS BIGINT) AS ids FROM b GROUP BY bin")
def _(spark, d):
    from halfseen.functions.hashing import hash32
    b = iv.equal_bins(lineitem_units(spark, d).select("uid", "qty"), "qty", 8, "uid")
    return out(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("mean_qty"), F.sum(hash32("uid", "check")).alias("ids")))


@query("i5_bin_counts", W + V1N + ", b AS (SELECT t, e, y_obs, p1, " + rank_bin("round(e, 10)", 10, "u") + f" FROM nu) SELECT bin, count(*) AS n, CAST(sum(t) AS BIGINT) AS k, CAST(sum(CASE WHEN t = 1 AND y_obs = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ky, {r('max(e)-min(e)', 'span')} FROM b GROUP BY bin")
def _(spark, d):
    u = lineitem_nuisance(spark, d).withColumn("er", F.round("e", 10))
    b = iv.equal_bins(u, "er", 10, "uid")
    return out(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("k"), F.count_if((F.col("t") == 1) & (F.col("y_obs") == 1)).alias("ky"), (F.max("e") - F.min("e")).alias("span")))


@query("i5_binned_nuisance")
def _(spark, d):
    o = order_nuisance(spark, d)
    x = iv.binned_nuisance(o, ident="okey", bins=10, y="y_obs", margin=True, calibration=unit_interval("okey", "cal") < 0.5)
    lo, hi = iv.inflate_box("e_lo", "eta_lo", "eta_hi", 2.0)
    x = x.withColumns({"lo": lo, "hi": hi})
    return out(x.groupBy("e_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("e_lo").alias("e_lo"), F.avg("e_hi").alias("e_hi"), F.avg("lo").alias("lo"), F.avg("hi").alias("hi")))


ORDER_CELLS = ["segment", "priority"]


def order_nuisance(spark, d):
    return nu.with_nuisance(order_units(spark, d), ORDER_CELLS, "t", "y_obs")


V3N = V3 + ", " + cell_sql("ov", "segment, priority", "oc") + ", no AS (SELECT ov.*, e, p1 FROM ov JOIN oc USING (segment, priority))"
INFL = ("el AS (SELECT *, greatest(e-0.05e0, 0e0) AS e_lo, ln(p1/(1e0-p1))-0.2e0 AS eta_lo, ln(p1/(1e0-p1))+0.2e0 AS eta_hi FROM cell), "
        f"ib AS (SELECT *, e_lo*{EXPIT('eta_lo')}+(1e0-e_lo)*{EXPIT('eta_lo-ln(2e0)')} AS lo2, e_lo*{EXPIT('eta_hi')}+(1e0-e_lo)*{EXPIT('eta_hi+ln(2e0)')} AS hi2 FROM el)")


@query("i6_inflate_box", W + V1 + ", " + cell_sql() + ", " + INFL + f" SELECT c1, c2, c3, {r('lo2', 'lo')}, {r('hi2', 'hi')}, {r('e_lo*' + EXPIT('eta_lo'), 'manski_lo')}, {r(EXPIT('eta_hi'), 'lower_hi')} FROM ib")
def _(spark, d):
    eta = s.logit("p1")
    c = cells(spark, d).withColumns({"e_lo": F.greatest(F.col("e") - 0.05, F.lit(0.0)), "eta_lo": eta - 0.2, "eta_hi": eta + 0.2})
    lo, hi = iv.inflate_box("e_lo", "eta_lo", "eta_hi", 2.0)
    m, _ = iv.inflate_box("e_lo", "eta_lo", "eta_hi", float("inf"))
    _, lh = iv.inflate_box("e_lo", "eta_lo", "eta_hi", 2.0, "censored-lower")
    return out(c.select(*CELLS, lo.alias("lo"), hi.alias("hi"), m.alias("manski_lo"), lh.alias("lower_hi")))


TRUTH = "tr AS (SELECT c1, c2, c3, (sum(y)+0.5e0)/(count(*)+1e0) AS p FROM u GROUP BY ALL)"


def truth_cells(spark, d):
    return lineitem_units(spark, d).groupBy(*CELLS).agg(((F.sum("y") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("p"))


V1B_ = V1 + ", " + cell_sql() + ", " + TRUTH + ", " + grid_sql([1.0, 1.2, 2.0], "cell") + ", " + box_sql("gamma", "gg")


@query("i7_coverage", W + V1B_ + f" SELECT gamma, {r('sum(n*CAST(p >= lo-1e-12 AND p <= hi+1e-12 AS INT))/sum(n)', 'coverage')}, {r('sum(n*(hi-lo))/sum(n)', 'width')} FROM bx JOIN tr USING (c1, c2, c3) GROUP BY gamma")
def _(spark, d):
    c = cells(spark, d).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in (1.0, 1.2, 2.0)])))
    lo, hi = s.box("p1", "e", F.col("gamma"))
    c = c.withColumns({"lo": lo, "hi": hi}).join(truth_cells(spark, d), CELLS)
    return out(c.groupBy("gamma").agg(ob.mean(s.contains("p", "lo", "hi", 1e-12).cast("double"), "n").alias("coverage"), ob.mean(F.col("hi") - F.col("lo"), "n").alias("width")))


@query("i8_bin_coverage", W + V1N + ", " + box_sql("2e0") + ", m AS (SELECT *, round((lo+hi)*0.5e0, 10) AS mid FROM bx), b AS (SELECT y, lo, hi, " + rank_bin("mid", 20, "u") + " FROM m), "
       "g AS (SELECT bin, count(*) AS n, avg(y) AS rate, avg(lo) AS ml, avg(hi) AS mh FROM b GROUP BY bin HAVING count(*) >= 150) "
       f"SELECT bin, n, {r('rate')}, {r('ml', 'mean_lo')}, {r('mh', 'mean_hi')}, CAST(rate+1.96e0*sqrt(rate*(1e0-rate)/n) >= ml AND rate-1.96e0*sqrt(rate*(1e0-rate)/n) <= mh AS BIGINT) AS covered FROM g")
def _(spark, d):
    b = lineitem_boxes(spark, d).select("uid", "y", "lo", "hi")
    return out(iv.bin_coverage(b, ident="uid", bins=20))


SWAP = V1 + ", " + cell_sql() + ", ora AS (SELECT c1, c2, c3, (sum(t)+0.5e0)/(count(*)+1e0) AS oe, (sum(y)+0.5e0)/(count(*)+1e0) AS op FROM u GROUP BY ALL), jj AS (SELECT * FROM cell JOIN ora USING (c1, c2, c3))"


@query("i9_swap_diagnostic", W + SWAP + f" SELECT {r('sum(n*CAST(op BETWEEN oe*p1+(1e0-oe)*' + g_sql('p1', '(1e0/1.2e0)') + '-1e-12 AND oe*p1+(1e0-oe)*' + g_sql('p1', '1.2e0') + '+1e-12 AS INT))/sum(n)', 'cover_oracle_e')}, "
       f"{r('sum(n*CAST(op BETWEEN e*op+(1e0-e)*' + g_sql('op', '(1e0/1.2e0)') + '-1e-12 AND e*op+(1e0-e)*' + g_sql('op', '1.2e0') + '+1e-12 AS INT))/sum(n)', 'cover_oracle_p')}, {r('sum(n*abs(e-oe))/sum(n)', 'mae_e')}, {r('sum(n*abs(p1-op))/sum(n)', 'mae_p')} FROM jj")
def _(spark, d):
    u = lineitem_units(spark, d).groupBy(*CELLS).agg(((F.sum("t") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("oe"), ((F.sum("y") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("op"))
    j = cells(spark, d).join(u, CELLS)
    a, b = s.box("p1", "oe", 1.2)
    c, e = s.box("op", "e", 1.2)
    cov = lambda lo, hi: ob.mean(((F.col("op") >= lo - 1e-12) & (F.col("op") <= hi + 1e-12)).cast("double"), "n")
    return out(j.agg(cov(a, b).alias("cover_oracle_e"), cov(c, e).alias("cover_oracle_p"), ob.mean(F.abs(F.col("e") - F.col("oe")), "n").alias("mae_e"), ob.mean(F.abs(F.col("p1") - F.col("op")), "n").alias("mae_p")))


# --- sensitivity ---------------------------------------------------------------------------------------

GMIN = W + V1 + ", " + Z5 + """, za AS (SELECT c1, c2, c3, list({'e': e, 'p': p1}) AS zs, sum(n) AS n FROM z5 GROUP BY c1, c2, c3),
  gm AS (SELECT c1, c2, c3, n, (list_reduce(list_prepend({'a': 1e0, 'b': 1e4}, list_transform(range(60), lambda q: {'a': 0e0, 'b': 0e0})),
    lambda acc, q: CASE WHEN list_max(list_transform(zs, lambda z: z.e*z.p+(1e0-z.e)*((1e0/sqrt(acc.a*acc.b))*z.p/(1e0+((1e0/sqrt(acc.a*acc.b))-1e0)*z.p))))
      <= list_min(list_transform(zs, lambda z: z.e*z.p+(1e0-z.e)*(sqrt(acc.a*acc.b)*z.p/(1e0+(sqrt(acc.a*acc.b)-1e0)*z.p)))) + 1e-12
      THEN {'a': acc.a, 'b': sqrt(acc.a*acc.b)} ELSE {'a': sqrt(acc.a*acc.b), 'b': acc.b} END)).b AS g FROM za)"""


def z_cells(spark, d):
    return nu.z_arrays(nu.by_decision_maker(lineitem_units(spark, d), CELLS, "z", "t", "y_obs"), CELLS, "z")


@query("g1_gamma_min", GMIN + f" SELECT c1, c2, c3, {r("CASE WHEN g >= 1e4 THEN 'inf'::DOUBLE ELSE g END", 'gamma_min')} FROM gm")
def _(spark, d):
    return out(z_cells(spark, d).select(*CELLS, gm.gamma_min("zs").alias("gamma_min")))


@query("g2_falsification_points", GMIN + f" SELECT {r('max(g)', 'gamma_min')}, {r('quantile_cont(g, 0.95)', 'gamma_min_q95')}, count(*) AS n_units FROM u JOIN gm USING (c1, c2, c3) WHERE g < 1e4")
def _(spark, d):
    return out(gm.gamma_summary(z_cells(spark, d).select("n", gm.gamma_min("zs").alias("gamma_min"))))


@query("g2_falsification")
def _(spark, d):
    c = z_cells(spark, d).select("n", gm.gamma_min("zs").alias("gamma_min"))
    x = gm.falsification(c)
    return out(x.withColumn("refutes_1", (F.lit(1.0) < F.col("gamma_min_boot_lo")).cast("int")))


@query("g7_odds_ratio", W + V3 + f""", c AS (SELECT segment, count(*) FILTER (WHERE t=0 AND y=0) AS n00, count(*) FILTER (WHERE t=0 AND y=1) AS n01, count(*) FILTER (WHERE t=1 AND y=0) AS n10, count(*) FILTER (WHERE t=1 AND y=1) AS n11 FROM ov GROUP BY segment), o AS (SELECT *, (n01/n00)/(n11/n10) AS o FROM c)
  SELECT segment, n00, n01, n10, n11, {r('o', 'odds_ratio')}, CASE WHEN o > 1 THEN 'censored-higher' WHEN o < 1 THEN 'censored-lower' END AS direction, {r('greatest(o, 1e0/o)', 'magnitude')} FROM o""")
def _(spark, d):
    return out(gm.odds_ratio(order_units(spark, d), keys=["segment"]))


@query("g7_odds_ratio_interval")
def _(spark, d):
    return out(ev.odds_ratio_interval(order_units(spark, d), "t", "y"))


@query("g8_gamma_min_by_centre", W + V2 + ", us AS (SELECT z FROM dv GROUP BY z HAVING count(*) >= 20 AND sum(t) >= 5 AND sum(1-t) >= 5 AND sum(CASE WHEN t=1 AND y_obs=1 THEN 1 ELSE 0 END) >= 5 AND sum(CASE WHEN t=1 AND y_obs=0 THEN 1 ELSE 0 END) >= 5) SELECT z, count(*) AS n, CAST(z IN (SELECT z FROM us) AS BIGINT) AS used FROM dv GROUP BY z")
def _(spark, d):
    c = gm.usable_centres(document_units(spark, d), "z", "t", "y_obs", folds=5, least=10)
    return out(c.select("z", "n", "used"))


LENIENT = W + V3 + f""", us AS (SELECT z FROM ov GROUP BY z HAVING count(*) >= 10 AND sum(t) >= 5 AND sum(1-t) >= 5 AND sum(CASE WHEN y_obs=1 THEN 1 ELSE 0 END) >= 5 AND sum(CASE WHEN y_obs=0 THEN 1 ELSE 0 END) >= 5),
  sd AS (SELECT ov.*, s AS seed, okey || '/' || s AS i FROM ov JOIN us USING (z), (VALUES {", ".join(f"({k})" for k in range(5))}) v(s)),
  fo AS (SELECT *, (row_number() OVER (PARTITION BY seed, z, t ORDER BY {h32('i', 'leniency/e')}, i) - 1) % 5 AS ef, (row_number() OVER (PARTITION BY seed, z, t, y_obs ORDER BY {h32('i', 'leniency/p')}, i) - 1) % 5 AS pf FROM sd),
  lo AS (SELECT seed, z, segment, f, avg(t) FILTER (WHERE ef <> f) AS e, avg(y_obs) FILTER (WHERE t = 1 AND pf <> f) AS p FROM fo, range(5) q(f) GROUP BY ALL),
  nz AS (SELECT seed, z, segment, greatest(least(avg(e), 0.999e0), 0.001e0) AS e, greatest(least(avg(p), 0.999e0), 0.001e0) AS p FROM lo GROUP BY ALL),
  za AS (SELECT seed, segment, list({{'e': e, 'p': p}}) AS zs, count(*) AS groups FROM nz GROUP BY ALL),""" + GMIN[GMIN.index("\n  gm AS"):].replace("SELECT c1, c2, c3, n,", "SELECT seed, segment, groups,") + """,
  gu AS (SELECT seed, groups, g FROM gm JOIN ov USING (segment) WHERE g < 1e4),
  gs AS (SELECT seed, max(g) AS gamma_min, quantile_cont(g, 0.95) AS gamma_min_q95, count(*) AS n_units, any_value(groups) AS n_groups FROM gu GROUP BY seed)"""


def lenient(spark, d):
    """Orders with indicator columns of their segment: a saturated model, so its fits are the cell means of the SQL."""
    o = order_units(spark, d)
    levels = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    o = o.withColumns({f"s{i}": (F.col("segment") == v).cast("double") for i, v in enumerate(levels)})
    return gm.leniency(o, [f"s{i}" for i in range(4)], z="z", t="t", y="y_obs", ident="okey", boot=False)[0]


@query("g8_leniency_gamma_min", LENIENT + f" SELECT CAST(seed AS BIGINT) AS seed, {r('gamma_min')}, {r('gamma_min_q95')}, n_units, n_groups FROM gs")
def _(spark, d):
    return out(lenient(spark, d).select("seed", "gamma_min", "gamma_min_q95", "n_units", "n_groups"))


@query("g8_leniency_interval", LENIENT + f" SELECT {r('avg(gamma_min)', 'mean')}, count(*) AS n, {r('2.7764451051977987e0*stddev_samp(gamma_min)/sqrt(count(*))', 'ci95')} FROM gs")
def _(spark, d):
    return out(ev.seed_interval(lenient(spark, d), "gamma_min").select("mean", "n", "ci95"))


@query("g8_leniency_cells")
def _(spark, d):
    u = document_units(spark, d)
    ok = gm.usable_centres(u, "z", "t", "y_obs", folds=5, least=10).filter("used = 1")
    grid = nu.by_decision_maker(u.join(ok.select("z"), "z", "left_semi"), ["lang"], "z", "t", "y_obs")
    arr = nu.z_arrays(grid, ["lang"], "z")
    return out(gm.gamma_summary(arr.select("n", gm.gamma_min("zs").alias("gamma_min"))))


@query("g9_population_comparison", W + V3 + f""", c AS (SELECT CASE WHEN z < 12 THEN 'a' ELSE 'b' END AS pop, count(*) FILTER (WHERE t=0 AND y=0) AS n00, count(*) FILTER (WHERE t=0 AND y=1) AS n01, count(*) FILTER (WHERE t=1 AND y=0) AS n10, count(*) FILTER (WHERE t=1 AND y=1) AS n11 FROM ov GROUP BY 1),
  o AS (SELECT max(CASE WHEN pop='a' THEN (n01/n00)/(n11/n10) END) AS a, max(CASE WHEN pop='b' THEN (n01/n00)/(n11/n10) END) AS b FROM c) SELECT {r('a-b', 'difference')}, {r('a/b', 'ratio')}, CAST(b BETWEEN a-0.1e0-1e-9 AND a+0.1e0+1e-9 AS BIGINT) AS ci_contains, CAST((a < 1) = (b < 1) AS BIGINT) AS same_direction FROM o""")
def _(spark, d):
    o = order_units(spark, d).withColumn("pop", F.when(F.col("z") < 12, "a").otherwise("b"))
    t = gm.odds_ratio(o, keys=["pop"])
    wide = t.agg(F.max(F.when(F.col("pop") == "a", F.col("odds_ratio"))).alias("a"), F.max(F.when(F.col("pop") == "b", F.col("odds_ratio"))).alias("b"))
    return out(gm.compare_populations(wide, "a", "b", F.col("a") - 0.1, F.col("a") + 0.1).select("difference", "ratio", "ci_contains", "same_direction"))


@query("g10_misspecification", W + V1B_ + """, o AS (SELECT *, CASE WHEN gamma/1.3e0 < 0.9e0 THEN 'below' WHEN gamma/1.3e0 <= 1.1e0 THEN 'near' ELSE 'above' END AS bucket FROM bx JOIN tr USING (c1, c2, c3))
  SELECT bucket, round(sum(n*CAST(p >= lo-1e-12 AND p <= hi+1e-12 AS INT))/sum(n), 6) + 0e0 AS coverage, round(sum(n*(hi-lo))/sum(n), 6) + 0e0 AS width FROM o GROUP BY bucket""")
def _(spark, d):
    c = cells(spark, d).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in (1.0, 1.2, 2.0)])))
    lo, hi = s.box("p1", "e", F.col("gamma"))
    c = c.withColumns({"lo": lo, "hi": hi}).join(truth_cells(spark, d), CELLS)
    return out(gm.misspecification(c, "gamma", 1.3, "p", weight="n"))


@query("g11_direction", W + V1N + f""", m AS (SELECT avg(CASE WHEN t=0 THEN y END) < avg(CASE WHEN t=1 THEN y END) AS low FROM u) SELECT c1, c2, c3, CASE WHEN low THEN 'censored-lower' ELSE 'censored-higher' END AS direction,
  {r('avg(CASE WHEN low THEN e*p1+(1e0-e)*' + g_sql('p1', '0.5e0') + ' ELSE p1 END)', 'lo')}, {r('avg(CASE WHEN low THEN p1 ELSE e*p1+(1e0-e)*' + g_sql('p1', '2e0') + ' END)', 'hi')} FROM nu, m GROUP BY c1, c2, c3, low""")
def _(spark, d):
    way = gm.infer_direction(lineitem_units(spark, d), "t", "y")
    lo, hi = s.box("p1", "e", 2.0, way)
    return out(cells(spark, d).select(*CELLS, F.lit(way).alias("direction"), lo.alias("lo"), hi.alias("hi")))


# --- learners ------------------------------------------------------------------------------------------------

ORDER_X = ["bal", "prio", "seg"]


def order_features(spark, d):
    """Orders with three standardised numeric features; fits read them many times, so the join is handed over once."""
    o = cut(order_units(spark, d))
    x = o.withColumns({"prio": F.substring("priority", 1, 1).cast("double"), "seg": F.length("segment").cast("double"), "bal": F.col("bal").cast("double")})
    return ft.standardise(x, ORDER_X)


def nuisance_summary(x):
    return out(x.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("e"), F.avg("p1").alias("p1"), F.min("e").alias("e_min"), F.max("e").alias("e_max")))


@query("m1_cross_fit")
def _(spark, d):
    return nuisance_summary(ln.CrossFit(ORDER_X, ident="okey").fit_predict(order_features(spark, d)))


@query("m2_predict_new")
def _(spark, d):
    o = order_features(spark, d).withColumn("side", vd.split("okey", 0.35, "m2"))
    cf = ln.CrossFit(ORDER_X, ident="okey")
    cf.fit_predict(o.filter("side = 'train'"))
    return nuisance_summary(cf.predict(o.filter("side = 'test'")))


@query("m3_base_learners")
def _(spark, d):
    o = order_features(spark, d)
    sel = o.filter("t = 1")
    for m in ("gbm", "logistic", "mlp"):
        o = ln.probability(ln.base_learner(m, ORDER_X, "y_obs").fit(sel), o, f"p_{m}")
    return out(o.groupBy("segment").agg(*[F.avg(f"p_{m}").alias(m) for m in ("gbm", "logistic", "mlp")]))


@query("m4_isotonic_calibration")
def _(spark, d):
    o = order_features(spark, d)
    predict = ln.fit_calibrated(o.filter("t = 1"), ORDER_X, "y_obs", "okey")
    return out(ev.calibration(predict(o, "p"), "p", "y"))


@query("m9_erm_and_oracle")
def _(spark, d):
    o = order_features(spark, d)
    x = ln.oracle(o, ORDER_X)(ln.erm(o, ORDER_X)(o, "erm"), "oracle")
    return out(x.groupBy("segment").agg(F.avg("erm").alias("erm"), F.avg("oracle").alias("oracle")))


@query("m10_ipw_learner")
def _(spark, d):
    o = nu.with_nuisance(order_features(spark, d), ORDER_CELLS, "t", "y_obs")
    return out(ln.ipw(o, ORDER_X)(o, "score").groupBy("segment").agg(F.avg("score").alias("score")))


@query("m11_aipw_learner")
def _(spark, d):
    o = nu.with_nuisance(order_features(spark, d), ORDER_CELLS, "t", "y_obs")
    return out(ln.aipw(o, ORDER_X)(o, "score").groupBy("segment").agg(F.avg("score").alias("score")))


@query("m12_imputation_learner")
def _(spark, d):
    o = nu.with_nuisance(order_features(spark, d), ORDER_CELLS, "t", "y_obs")
    return out(ln.imputation(o, ORDER_X)(o, "score").groupBy("segment").agg(F.avg("score").alias("score")))


V1X = ["xq", "xd", "xt"]


def cell_features(spark, d, gamma=2.0):
    """Packed line cells with standardised cell coordinates, the box and a weight."""
    lo, hi = s.box("p1", "e", gamma)
    c = cells(spark, d).withColumns({"lo": lo, "hi": hi, "w": F.col("n"), "xq": (F.col("c1") - 2.0) / 1.5, "xd": F.col("c2") - 1.0, "xt": F.col("c3") - 1.0})
    return c.withColumn("cid", F.concat_ws("-", *CELLS))


@query("m15_worst_case_linear", "SELECT CAST(1 AS BIGINT) AS no_worse, CAST(1 AS BIGINT) AS optimal")
def _(spark, d):
    """No direction of a fan around the solution lowers the objective: the rows are the optimality conditions."""
    c = cell_features(spark, d)
    beta, value, _ = ln.worst_case_linear(c, V1X, weight="w")
    fan = [beta + h * sign * e for h in (1e-2, 1e-3) for sign in (1, -1) for e in [*np.eye(4), np.ones(4) / 2]]
    risk = lambda b: ob.worst_case_risk(ln.linear(b, V1X), weight="w") + F.lit(1e-4 * float(b @ b))
    near = F.least(*[risk(b) for b in fan])
    zero = ob.worst_case_risk(F.lit(0.0), weight="w")
    return out(c.agg((F.lit(value) <= zero + 1e-12).cast("int").alias("no_worse"), (near >= value - 2e-7).cast("int").alias("optimal")))


@query("m16_midpoint_scorer")
def _(spark, d):
    beta = ln.midpoint_scorer(cell_features(spark, d), V1X, weight="w")
    c = cell_features(spark, d).withColumn("s", ln.linear([0.0, *beta], V1X))
    sh = rk.sharp_interval(c, "s", weight="w")
    return out(sh.select("lower", "upper", *[F.lit(float(b)).alias(n) for n, b in zip(V1X, beta)]))


@query("m17_worst_case_ranker", "SELECT CAST(1 AS BIGINT) AS start_is_weighted, CAST(1 AS BIGINT) AS never_worse")
def _(spark, d):
    """The start is the midpoint scorer's weighted worst case, and the result is not below it."""
    c = cell_features(spark, d)
    best, history = ln.worst_case_ranker(c, V1X, ident="cid", weight="w")
    worst = lambda b, n: rk.sharp_interval(c.withColumn("s", ln.linear([0.0, *b], V1X)), "s", weight="w").select(F.col("lower").alias(n))
    start, last = worst(ln.midpoint_scorer(c, V1X, weight="w"), "a"), worst(best, "b")
    both = start.withColumn("k", F.lit(1)).join(last.withColumn("k", F.lit(1)), "k")
    return out(both.select((F.abs(F.col("a") - history[0]) < 1e-9).cast("int").alias("start_is_weighted"),
                           ((F.col("b") >= F.col("a") - 1e-12) & (F.abs(F.col("b") - max(history)) < 1e-9)).cast("int").alias("never_worse")))


@query("l10_learner_table")
def _(spark, d):
    """Every learner, linear score and act on the held-out orders, with full defaults."""
    o = order_features(spark, d).withColumn("side", vd.split("okey", 0.35, "l10"))
    x = cm.compare(o, ORDER_X, ident="okey", side="side", y="y")
    return out(x.withColumn("gamma", F.when(F.col("gamma") < float("inf"), F.col("gamma"))))


@query("m19_bagged_ensemble")
def _(spark, d):
    o = ln.bagged_ensemble(order_features(spark, d), ORDER_X, ident="okey", members=3)
    return out(o.groupBy("segment").agg(F.avg(F.array_max("member_p") - F.array_min("member_p")).alias("spread"), F.avg(F.element_at("member_p", 1)).alias("first")))


F13_SQL = ("WITH " + V1 + """, m AS (SELECT avg(qty) AS mq, avg(disc) AS md, avg(tax) AS mt, avg(price) AS my, count(*)*var_pop(qty)+1e-3 AS a, count(*)*covar_pop(qty, disc) AS b, count(*)*covar_pop(qty, tax) AS c,
  count(*)*var_pop(disc)+1e-3 AS e, count(*)*covar_pop(disc, tax) AS f, count(*)*var_pop(tax)+1e-3 AS i, count(*)*covar_pop(qty, price) AS p, count(*)*covar_pop(disc, price) AS q, count(*)*covar_pop(tax, price) AS w FROM u),
  sv AS (SELECT *, a*(e*i-f*f)-b*(b*i-f*c)+c*(b*f-e*c) AS det FROM m), be AS (SELECT mq, md, mt, my, (p*(e*i-f*f)-b*(q*i-f*w)+c*(q*f-e*w))/det AS b1, (a*(q*i-f*w)-p*(b*i-f*c)+c*(b*w-q*c))/det AS b2, (a*(e*w-q*f)-b*(b*w-q*c)+p*(b*f-e*c))/det AS b3 FROM sv),
  rs AS (SELECT z, price-my-b1*(qty-mq)-b2*(disc-md)-b3*(tax-mt) AS x FROM u, be), zs AS (SELECT z, (x-avg(x) OVER ())/stddev_pop(x) OVER () AS x FROM rs) """
           f"SELECT z, {r('avg(x)', 'mean')}, {r('min(x)', 'low')}, {r('max(x)', 'high')} FROM zs GROUP BY z")


@query("f13_residual_by_level", F13_SQL)
def _(spark, d):
    u = lineitem_units(spark, d).select("z", "qty", "disc", "tax", "price")
    x = ln.residualise(u, ["qty", "disc", "tax"], "price")
    return out(x.groupBy("z").agg(F.avg("s_res").alias("mean"), F.min("s_res").alias("low"), F.max("s_res").alias("high")))


@query("f13_residualise")
def _(spark, d):
    u = lineitem_units(spark, d).select("z", "qty", "disc", "tax", "price")
    x = ln.residualise(u, ["qty", "disc", "tax"], "price")
    return out(x.agg(F.avg("s_res").alias("mean"), F.stddev_pop("s_res").alias("sd"), F.corr("s_res", "qty").alias("corr_qty"), F.corr("s_res", "disc").alias("corr_disc")))
