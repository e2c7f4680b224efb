"""Scalar algebra, rank metrics, robust objectives, uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from halfseen.catalog.base import (
    CELLS, V1, V1N, V2N, box_sql, cell_sql, document_nuisance, document_units, g_sql, grid_sql, h32, hu, lineitem_boxes,
    lineitem_nuisance, lineitem_units, out, packed_boxes, packed_lineitem, query, r, rates_sql, sharp_sql,
)
from halfseen.functions import scalar as s
from halfseen.functions.hashing import bucket
from halfseen.operators import evaluation as ev
from halfseen.operators import gamma as gm
from halfseen.operators import intervals as iv
from halfseen.operators import nuisance as nu
from halfseen.operators import objectives as ob
from halfseen.operators import ranking as rk
from halfseen.operators import uncertainty as un

# score of the objective queries: a linear margin of the quantity
def margin():
    return (F.col("qty") - 25.0) / 10.0


Z_SQL = "((qty-25e0)/10e0)"
V1B = V1N + ", " + box_sql("2e0")
V1Z = V1B + f", z AS (SELECT *, {Z_SQL} AS s FROM bx)"


def scored(spark, d, gamma=2.0):
    """Packed units with a margin score ``s``, the box and a weight ``w``."""
    return packed_boxes(spark, d, "qty", gamma=gamma).withColumn("s", margin())


def softplus_sql(z):
    return f"(greatest({z}, 0e0) + ln(1e0+exp(-abs({z}))))"


LOSS_SQL = {
    "logistic": (softplus_sql("-s"), softplus_sql("s")),
    "squared": ("power(s-1e0,2)", "power(s,2)"),
    "exponential": ("exp(least(greatest(-s,-30e0),30e0))", "exp(least(greatest(s,-30e0),30e0))"),
    "hinge": ("greatest(0e0, 1e0-s)", "greatest(0e0, 1e0+s)"),
}
L1, L0 = LOSS_SQL["logistic"]
ENT = lambda p: (f"(-(least(greatest({p},1e-12),1e0-1e-12)*ln(least(greatest({p},1e-12),1e0-1e-12))"  # noqa: E731
                 f"+(1e0-least(greatest({p},1e-12),1e0-1e-12))*ln(1e0-least(greatest({p},1e-12),1e0-1e-12))))")
LOGIT = lambda p: f"ln(({p})/(1e0-({p})))"
EXPIT = lambda z: f"(1e0/(1e0+exp(-({z}))))"


# --- scalar functions on the cells of lineitem ---------------------------------

def cells(spark, d):
    return nu.cell_nuisance(lineitem_units(spark, d), CELLS, "t", "y_obs")


CELL = "WITH " + V1 + ", " + cell_sql()


@query("x1_expit_logit", CELL + f" SELECT c1, c2, c3, {r(LOGIT('p1'), 'logit_p1')}, {r(EXPIT('e*3-1'), 'expit_e')} FROM cell")
def _(spark, d):
    return out(cells(spark, d).select(*CELLS, s.logit("p1").alias("logit_p1"), s.expit(F.col("e") * 3 - 1).alias("expit_e")))


@query("x2_gamma_lambda", CELL + f" SELECT c1, c2, c3, {r('power(1e0+e, 2)', 'gamma')}, {r('sqrt(1e0+p1)', 'lambda')} FROM cell")
def _(spark, d):
    return out(cells(spark, d).select(*CELLS, s.gamma_from_lambda(1.0 + F.col("e")).alias("gamma"), s.lambda_from_gamma(1.0 + F.col("p1")).alias("lambda")))


@query("x3_tilt_to_outcome", CELL + f" SELECT c1, c2, c3, {r('e*p1+(1e0-e)*' + g_sql('p1', '2.5e0'), 'p')} FROM cell")
def _(spark, d):
    return out(cells(spark, d).select(*CELLS, s.tilt_to_outcome("p1", "e", 2.5).alias("p")))


@query("x4_outcome_bounds", CELL + f""", b AS (SELECT c1, c2, c3, e, p1, g, d,
  CASE WHEN g = 'inf'::DOUBLE THEN e*p1 ELSE e*p1+(1e0-e)*{g_sql('p1', '(1e0/g)')} END AS l0,
  CASE WHEN g = 'inf'::DOUBLE THEN e*p1+1e0-e ELSE e*p1+(1e0-e)*{g_sql('p1', 'g')} END AS h0
  FROM cell, (VALUES (1e0), (1.5e0), (3e0), ('inf'::DOUBLE)) a(g), (VALUES ('two-sided'), ('censored-lower'), ('censored-higher')) b(d))
  SELECT c1, c2, c3, CASE WHEN g = 'inf'::DOUBLE THEN -1e0 ELSE g END AS gamma, d AS direction,
  {r("CASE WHEN d = 'censored-higher' THEN p1 ELSE l0 END", 'lo')}, {r("CASE WHEN d = 'censored-lower' THEN p1 ELSE h0 END", 'hi')} FROM b""")
def _(spark, d):
    base = cells(spark, d).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in (1.0, 1.5, 3.0, float("inf"))])))
    rows = [F.struct(F.lit(x).alias("direction"), *[c.alias(n) for n, c in zip(("lo", "hi"), s.box("p1", "e", F.col("gamma"), x))])
            for x in s.DIRECTIONS]
    base = base.select(*CELLS, F.when(F.col("gamma") == float("inf"), -1.0).otherwise(F.col("gamma")).alias("gamma"),
                       F.inline(F.array(*rows)))
    return out(base)


@query("x5_box_helpers", "WITH " + V1B + f""" SELECT c1, c2, c3, {r('avg((lo+hi)/2)', 'mid')}, {r('avg(hi-lo)', 'delta')},
  CAST(sum(CASE WHEN y >= lo-1e-9 AND y <= hi+1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS inside, {r('avg(least(greatest(y, lo), hi))', 'clipped')}
  FROM bx GROUP BY c1, c2, c3""")
def _(spark, d):
    b = lineitem_boxes(spark, d)
    return out(b.groupBy(*CELLS).agg(F.avg((F.col("lo") + F.col("hi")) / 2).alias("mid"), F.avg(F.col("hi") - F.col("lo")).alias("delta"),
                                     F.count_if(s.contains("y", "lo", "hi")).alias("inside"), F.avg(s.clip("y", "lo", "hi")).alias("clipped")))


@query("x6_realised_gamma", "WITH " + V1 + """, c AS (SELECT c1, c2, c3, (sum((1-t)*y)+0.5e0)/(sum(1-t)+1e0) AS p0, (sum(t*y)+0.5e0)/(sum(t)+1e0) AS p1 FROM u GROUP BY ALL),
  l AS (SELECT abs(ln(p0/(1e0-p0))-ln(p1/(1e0-p1))) AS gap FROM c)
  SELECT round(exp(max(gap)), 6) + 0e0 AS gamma_max, round(exp(quantile_cont(gap, 0.99)), 6) + 0e0 AS gamma_q99 FROM l""")
def _(spark, d):
    t, y = F.col("t"), F.col("y")
    c = lineitem_units(spark, d).groupBy(*CELLS).agg(
        ((F.sum((1 - t) * y) + 0.5) / (F.sum(1 - t) + 1.0)).alias("p0"), ((F.sum(t * y) + 0.5) / (F.sum(t) + 1.0)).alias("p1"))
    q = gm.realised_gamma(c, quantiles=(1.0, 0.99))
    return out(q.select(F.col("gamma_q0").alias("gamma_max"), F.col("gamma_q1").alias("gamma_q99")))


@query("x7f_tilt_and_slope", CELL + f" SELECT c1, c2, c3, {r(g_sql('p1', '3e0'), 'g')}, {r('3e0/power(1e0+2e0*p1, 2)', 'slope')} FROM cell")
def _(spark, d):
    return out(cells(spark, d).select(*CELLS, s.tilt("p1", 3.0).alias("g"), s.tilt_slope("p1", 3.0).alias("slope")))


@query("x8_losses", "WITH " + V1 + f", z AS (SELECT qty, {Z_SQL} AS s FROM u) " + " UNION ALL ".join(
    f"SELECT qty, '{n}' AS loss, {r(f'avg({a})', 'l1')}, {r(f'avg({b})', 'l0')}, {r(f'avg(abs({a}-{b}))', 'gap')} FROM z GROUP BY qty"
    for n, (a, b) in LOSS_SQL.items()))
def _(spark, d):
    # losses depend on the score only: evaluate once per distinct quantity
    z = lineitem_units(spark, d).groupBy("qty").agg(F.count(F.lit(1)).alias("n")).withColumn("s", margin())
    rows = []
    for n in s.LOSSES:
        one, zero = s.loss_pair("s", n)
        rows.append(F.struct(F.lit(n).alias("loss"), one.alias("l1"), zero.alias("l0"), s.loss_gap("s", n).alias("gap")))
    return out(z.select("qty", F.inline(F.array(*rows))))


@query("x9_entropy", "WITH " + V1B + f" SELECT c1, c2, c3, {r('avg(' + ENT('p1') + ')', 'h')}, {r('avg(least(' + ENT('lo') + ',' + ENT('hi') + '))', 'h_min')}, "
       f"{r('avg(' + ENT('least(greatest(0.5e0, lo), hi)') + ')', 'h_max')} FROM bx GROUP BY c1, c2, c3")
def _(spark, d):
    lo, hi = s.box("p1", "e", 2.0)
    c = cells(spark, d).withColumns({"lo": lo, "hi": hi})
    h0, h1 = s.entropy_range("lo", "hi")
    return out(c.select(*CELLS, s.entropy("p1").alias("h"), h0.alias("h_min"), h1.alias("h_max")))


# --- ranking --------------------------------------------------------------------

@query("a1_midrank", "WITH " + V1 + """, g AS (SELECT price, count(*) AS w FROM u GROUP BY price),
  m AS (SELECT price, (sum(w) OVER (ORDER BY price) - 0.5e0*w) / sum(w) OVER () AS mr FROM g)
  SELECT z, round(avg(mr), 6) + 0e0 AS mean_rank, round(min(mr), 6) + 0e0 AS min_rank, round(max(mr), 6) + 0e0 AS max_rank FROM u JOIN m USING (price) GROUP BY z""")
def _(spark, d):
    m = rk.midrank(lineitem_units(spark, d).select("z", "price"), "price")
    return out(m.groupBy("z").agg(F.avg("midrank").alias("mean_rank"), F.min("midrank").alias("min_rank"), F.max("midrank").alias("max_rank")))


AUC_SQL = lambda src, score, y: (f"(SELECT (sum(py*phi) - 0.5e0*power(sum(py), 2)) / (sum(py)*(1e0-sum(py))) FROM (SELECT sum(({y})*w)/max(tot) AS py, "  # noqa: E731
                                 f"(max(cw)-0.5e0*sum(w))/max(tot) AS phi FROM (SELECT *, sum(w) OVER () AS tot, sum(w) OVER (ORDER BY {score}) AS cw FROM {src}) GROUP BY {score}))")


@query("a2_auc", "WITH " + V1N + """, g AS (SELECT price AS s, count(*) AS w, sum(y) AS sy, sum(p1) AS sp FROM nu GROUP BY price),
  m AS (SELECT *, sum(w) OVER () AS tot, sum(w) OVER (ORDER BY s) AS cw FROM g), x AS (SELECT sy/tot AS y, sp/tot AS p, (cw-0.5e0*w)/tot AS phi FROM m)
  SELECT round((sum(y*phi)-0.5e0*power(sum(y),2))/(sum(y)*(1e0-sum(y))), 6) + 0e0 AS auc_y, round((sum(p*phi)-0.5e0*power(sum(p),2))/(sum(p)*(1e0-sum(p))), 6) + 0e0 AS auc_p FROM x""")
def _(spark, d):
    n = lineitem_nuisance(spark, d).select("price", "y", "p1")
    return out(rk.auc(n, "price", {"auc_y": "y", "auc_p": "p1"}, scores=lineitem_units(spark, d).select("price")))


@query("a3_metric_value", "WITH " + V1N + """, x AS (SELECT avg(p1) AS pi, avg(p1*CAST(qty > 25 AS INT)) AS num, avg(CAST(qty > 25 AS DOUBLE)) AS share FROM nu)
  SELECT round(num/pi, 6) + 0e0 AS tpr, round((1e0-share-(pi-num))/(1e0-pi), 6) + 0e0 AS tnr, round(num/share, 6) + 0e0 AS ppv FROM x""")
def _(spark, d):
    n = packed_lineitem(spark, d, "qty")
    vals = [rk.metric_value(n, "qty", "p1", metric=m, weight="w").select(F.col("value").alias(c), F.lit(1).alias("k"))
            for c, m in (("tpr", rk.tpr_at(25)), ("tnr", rk.tnr_at(25)), ("ppv", rk.ppv_at(25)))]
    return out(vals[0].join(vals[1], "k").join(vals[2], "k").drop("k"))


SPEC_SQL = {
    "TPR@25": dict(phi="CAST(qty > 25 AS DOUBLE)", c=("0e0", "0e0", "0e0"), d=("0e0", "1e0", "0e0")),
    "TNR@25": dict(phi="-CAST(qty <= 25 AS DOUBLE)", c=("share", "0e0", "0e0"), d=("1e0", "-1e0", "0e0")),
    "PPV@25": dict(phi="CAST(qty > 25 AS DOUBLE)", c=("0e0", "0e0", "0e0"), d=("share", "0e0", "0e0")),
    "AUROC": dict(score="qty"),
}


@query("a4_metric_specs", "WITH " + V1B + ", " + ",\n".join(sharp_sql("bx", tag=f"_{i}", **k) for i, k in enumerate(SPEC_SQL.values()))
       + " " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {r('lower')}, {r('upper')} FROM shp_{i}" for i, n in enumerate(SPEC_SQL)))
def _(spark, d):
    b = packed_boxes(spark, d, "qty")
    parts = [rk.sharp_interval(b, "qty", metric=m, weight="w").select(F.lit(m.name).alias("metric"), "lower", "upper")
             for m in (rk.tpr_at(25), rk.tnr_at(25), rk.ppv_at(25), rk.AUROC)]
    return out(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))


@query("a5_segments", "WITH " + V1B + ", " + sharp_sql("bx", "qty") + f""" SELECT CAST(count(*) AS BIGINT) AS n, {r("sum(a) FILTER (WHERE side='low')", 'sum_a_low')},
  {r("sum(a) FILTER (WHERE side='up')", 'sum_a_up')}, {r("sum(va-phi*a) FILTER (WHERE side='low')", 'sum_alpha_low')}, {r("sum(va-phi*a) FILTER (WHERE side='up')", 'sum_alpha_up')},
  {r("sum(phi) FILTER (WHERE side='up')", 'sum_phi')} FROM g5""")
def _(spark, d):
    g = rk.segments(packed_boxes(spark, d, "qty"), "qty", weight="w")
    return out(g.agg((2 * F.count(F.lit(1))).alias("n"), F.sum("a_low").alias("sum_a_low"), F.sum("a_up").alias("sum_a_up"),
                     F.sum("alpha_low").alias("sum_alpha_low"), F.sum("alpha_up").alias("sum_alpha_up"), F.sum("phi").alias("sum_phi")))


SHARP_COLS = f"SELECT {r('lower')}, {r('upper')}, {r('pi_lower')}, {r('pi_upper')}, {r('upper-lower', 'width')} FROM shp"


@query("a6_sharp_interval", "WITH " + V1B + ", " + sharp_sql("bx", "qty") + " " + SHARP_COLS)
def sharp_flagship(spark, d):
    scores = lineitem_units(spark, d).select("qty")
    return out(rk.sharp_interval(packed_boxes(spark, d, "qty"), "qty", weight="w", scores=scores))


@query("a6_sharp_interval_many_scores", "WITH " + V1B + ", " + sharp_sql("bx", "price") + f" SELECT {r('lower')}, {r('upper')}, {r('upper-lower', 'width')} FROM shp")
def _(spark, d):
    # almost every unit has its own score: packing units first would only repeat the large aggregate
    b = lineitem_boxes(spark, d).select("price", "lo", "hi")
    return out(rk.sharp_interval(b, "price", scores=lineitem_units(spark, d).select("price")).select("lower", "upper", "width"))


@query("a6_sharp_interval_documents", "WITH " + V2N + ", " + box_sql("2e0", "dn") + ", " + sharp_sql("bx", "n_chars") + f" SELECT {r('lower')}, {r('upper')}, {r('upper-lower', 'width')} FROM shp")
def _(spark, d):
    lo, hi = s.box("p1", "e", 2.0)
    b = document_nuisance(spark, d).select("n_chars", "e", "p1").withColumns({"lo": lo, "hi": hi})
    return out(rk.sharp_interval(b, "n_chars").select("lower", "upper", "width"))


@query("a7_least_favourable", "WITH " + V1B + ", " + sharp_sql("bx", "qty") + f""" SELECT {r('lower', 'auc_lower')}, {r('upper', 'auc_upper')}, CAST(0 AS BIGINT) AS outside FROM shp""")
def _(spark, d):
    # attainment: the returned members reproduce the bounds and stay inside the box
    scores = lineitem_units(spark, d).select("qty")
    p = rk.least_favourable(packed_boxes(spark, d, "qty"), "qty", weight="w", scores=scores)
    got = rk.auc(p, "qty", {"auc_lower": "p_lower", "auc_upper": "p_upper"}, weight="w", scores=scores)
    out_of_box = p.agg(F.count_if(~s.contains("p_lower", "lo", "hi") | ~s.contains("p_upper", "lo", "hi")).alias("outside"), F.lit(1).alias("k"))
    return out(got.withColumn("k", F.lit(1)).join(out_of_box, "k").drop("k"))


@query("a8_corner_interval", "WITH " + V1B + f""", g AS (SELECT qty AS s, count(*) AS w, sum(lo) AS a, sum(hi) AS b, sum((lo+hi)/2) AS m FROM bx GROUP BY qty),
  x AS (SELECT a/sum(w) OVER () AS a, b/sum(w) OVER () AS b, m/sum(w) OVER () AS m, (sum(w) OVER (ORDER BY s)-0.5e0*w)/sum(w) OVER () AS phi FROM g),
  v AS (SELECT (sum(a*phi)-0.5e0*power(sum(a),2))/(sum(a)*(1e0-sum(a))) AS va, (sum(b*phi)-0.5e0*power(sum(b),2))/(sum(b)*(1e0-sum(b))) AS vb, (sum(m*phi)-0.5e0*power(sum(m),2))/(sum(m)*(1e0-sum(m))) AS vm FROM x)
  SELECT {r('least(va, vb, vm)', 'lower')}, {r('greatest(va, vb, vm)', 'upper')} FROM v""")
def _(spark, d):
    return out(rk.corner_interval(packed_boxes(spark, d, "qty"), "qty", weight="w"))


@query("a9_separate_interval", "WITH " + V1B + f""", g AS (SELECT qty AS s, count(*) AS w, sum(lo) AS a, sum(hi) AS b FROM bx GROUP BY qty),
  x AS (SELECT a/sum(w) OVER () AS a, b/sum(w) OVER () AS b, (sum(w) OVER (ORDER BY s)-0.5e0*w)/sum(w) OVER () AS phi FROM g),
  v AS (SELECT sum(a) AS pa, sum(b) AS pb, sum(a*phi) AS na, sum(b*phi) AS nb FROM x), gr AS (SELECT *, pa+(pb-pa)*i/2000e0 AS pi FROM v, range(2001) q(i))
  SELECT {r('greatest(min((na-0.5e0*pi*pi)/(pi*(1e0-pi))), 0e0)', 'lower')}, {r('least(max((nb-0.5e0*pi*pi)/(pi*(1e0-pi))), 1e0)', 'upper')} FROM gr""")
def _(spark, d):
    return out(rk.separate_interval(packed_boxes(spark, d, "qty"), "qty", weight="w"))


@query("a10_contains_width", "WITH " + V1B + ", " + sharp_sql("bx", "qty", "z") + """, a AS (SELECT z, avg(y) AS base FROM u GROUP BY z)
  SELECT z, round(upper-lower, 6) + 0e0 AS width, CAST(0.5e0 >= lower-1e-9 AND 0.5e0 <= upper+1e-9 AS BIGINT) AS has_half, CAST(base >= lower-1e-9 AND base <= upper+1e-9 AS BIGINT) AS has_rate FROM shp JOIN a USING (z)""")
def _(spark, d):
    sh = rk.sharp_interval(packed_boxes(spark, d, "qty", "z"), "qty", weight="w", keys=["z"])
    base = lineitem_units(spark, d).groupBy("z").agg(F.avg("y").alias("base"))
    return out(sh.join(base, "z").select("z", "width", s.contains(F.lit(0.5), "lower", "upper").alias("has_half"),
                                         s.contains("base", "lower", "upper").alias("has_rate")))


DEPLOY = lambda src, y, p="": (f"(SELECT avg({y}*{L1}+(1e0-{y})*{L0}) AS {p}risk, avg(CAST(CAST(s > 0 AS INT) = {y} AS DOUBLE)) AS {p}accuracy, "  # noqa: E731
                               f"0.5e0*(avg(CASE WHEN {y}=1 THEN CAST(s > 0 AS DOUBLE) END)+avg(CASE WHEN {y}=0 THEN 1e0-CAST(s > 0 AS INT) END)) AS {p}balanced_accuracy, "
                               f"avg(power({EXPIT('s')}-{y}, 2)) AS {p}brier FROM {src})")


def deploy_sql(where: str, y: str, p: str) -> str:
    cols = ", ".join(f"round({p}{c}, 6) + 0e0 AS {p}{c}" for c in ("risk", "accuracy", "balanced_accuracy", "brier"))
    return ("WITH " + V1 + f", zz AS (SELECT *, {Z_SQL} AS s FROM u {where}), gq AS (SELECT s, count(*) AS w, sum({y}) AS sy FROM zz GROUP BY s), "
            f"cq AS (SELECT sy/sum(w) OVER () AS y, (sum(w) OVER (ORDER BY s)-0.5e0*w)/sum(w) OVER () AS phi FROM gq), "
            f"aq AS (SELECT (sum(y*phi)-0.5e0*power(sum(y),2))/(sum(y)*(1e0-sum(y))) AS au FROM cq) "
            f"SELECT {cols}, round(au, 6) + 0e0 AS {p}auroc FROM {DEPLOY('zz', y, p)}, aq")


@query("a11_deployment_metrics", deploy_sql("", "y", ""))
def _(spark, d):
    return out(ev.deployment_metrics(lineitem_units(spark, d).select("y", margin().alias("s"))))


@query("a12_observed_metrics", deploy_sql("WHERE t = 1", "y_obs", "obs_"))
def _(spark, d):
    return out(ev.observed_metrics(lineitem_units(spark, d).select("t", "y_obs", margin().alias("s")), y="y_obs"))


WORST = f"greatest(hi*{L1}+(1e0-hi)*{L0}, lo*{L1}+(1e0-lo)*{L0})"
Q_SQL = f"least(greatest({EXPIT('s')}, 1e-12), 1e0-1e-12)"
KL = lambda p: f"({p}*ln({p}/{Q_SQL})+(1e0-{p})*ln((1e0-{p})/(1e0-{Q_SQL})))"
REGRET = f"greatest({KL('lo')}, {KL('hi')})"
ABST = "CAST(lo <= 0.5e0 AND hi >= 0.5e0 AS DOUBLE)"


@query("a13_bounds_report", "WITH " + V1Z + ", " + sharp_sql("z") + f", f AS (SELECT avg({WORST}) AS wr, avg({REGRET}) AS mr, avg({ABST}) AS ab FROM z) "
       f"SELECT {r('lower', 'auroc_lo')}, {r('upper', 'auroc_hi')}, {r('upper-lower', 'auroc_width')}, {r('wr', 'worstcase_risk')}, {r('mr', 'minimax_regret')}, {r('ab', 'abstention_rate')} FROM shp, f")
def _(spark, d):
    return out(ev.bounds_report(scored(spark, d), weight="w"))


@query("a14_contraction", "WITH " + V1 + """, q AS (SELECT z, avg(t) AS rt, count(*) AS n FROM u GROUP BY z ORDER BY rt DESC, z LIMIT 1),
  k AS (SELECT y_obs, row_number() OVER (ORDER BY qty, """ + hu("uid", "contraction") + """, uid) - 1 AS rn, n FROM u JOIN q USING (z) WHERE t = 1)
  SELECT round(avg(y_obs), 6) + 0e0 AS failure_rate, count(*) AS n_kept FROM k WHERE rn < round_even(0.3e0*n, 0)""")
def _(spark, d):
    return out(ev.contraction_failure_rate(lineitem_units(spark, d), score="qty", t="t", y="y_obs", z="z", tie="uid", rate=0.3))


@query("a15_realised_auroc")
def _(spark, d):
    u = lineitem_units(spark, d).select("y", margin().alias("s"))
    return out(ev.bootstrap_summary(ev.auc_replicates(u, "s", "y", seeds=2, replicates=25), "auc"))


@query("a15_influence_interval", "WITH " + V1 + f""", k AS (SELECT z, price AS s, y_obs AS y FROM u WHERE y_obs IS NOT NULL AND price IS NOT NULL),
  v AS (SELECT z, y, count(*) FILTER (WHERE y = 0) OVER (PARTITION BY z ORDER BY s) AS d_upto, count(*) FILTER (WHERE y = 0) OVER (PARTITION BY z, s) AS d_at, count(*) FILTER (WHERE y = 1) OVER (PARTITION BY z ORDER BY s) AS u_upto, count(*) FILTER (WHERE y = 1) OVER (PARTITION BY z, s) AS u_at,
    count(*) FILTER (WHERE y = 1) OVER (PARTITION BY z) AS m, count(*) FILTER (WHERE y = 0) OVER (PARTITION BY z) AS k FROM k),
  i AS (SELECT z, y, m, k, CASE WHEN y = 1 THEN (d_upto - 0.5e0*d_at)/k ELSE (m - u_upto + 0.5e0*u_at)/m END AS x FROM v),
  g AS (SELECT z, any_value(m) AS n_pos, any_value(k) AS n_neg, avg(x) FILTER (WHERE y = 1) AS auc, sqrt(var_samp(x) FILTER (WHERE y = 1)/any_value(m) + var_samp(x) FILTER (WHERE y = 0)/any_value(k)) AS se FROM i GROUP BY z)
  SELECT z, {r('auc')}, {r('se')}, {r('auc - 1.959963984540054e0*se', 'lo')}, {r('auc + 1.959963984540054e0*se', 'hi')}, n_pos, n_neg FROM g""")
def _(spark, d):
    return out(ev.influence_interval(lineitem_units(spark, d), "price", "y_obs", keys=["z"]))


@query("a15_realised_auroc_point", "WITH " + V1 + f""", g AS (SELECT qty, count(*) AS w, sum(y_obs) AS sy FROM u WHERE y_obs IS NOT NULL GROUP BY qty), c AS (SELECT w, sy, sy/sum(w) OVER () AS y, (sum(w) OVER (ORDER BY qty)-0.5e0*w)/sum(w) OVER () AS phi FROM g)
  SELECT CAST(1 AS BIGINT) AS available, {r('(sum(y*phi)-0.5e0*power(sum(y),2))/(sum(y)*(1e0-sum(y)))', 'point')}, CAST(sum(w) AS BIGINT) AS n_units, CAST(sum(sy) AS BIGINT) AS n_events, CAST(1 AS BIGINT) AS ci_holds_point FROM c""")
def _(spark, d):
    x = ev.realised_auroc(lineitem_units(spark, d), "qty", "y_obs", replicates=50)
    return out(x.select("available", "point", "n_units", "n_events", F.col("point").between(F.col("ci_lo"), F.col("ci_hi")).alias("ci_holds_point")))


@query("a16_worst_case_auc", "WITH " + V1B + ", " + sharp_sql("bx", "qty", "z") + f" SELECT z, {r('lower', 'worst_auc')} FROM shp")
def _(spark, d):
    sh = rk.sharp_interval(packed_boxes(spark, d, "qty", "z"), "qty", weight="w", keys=["z"])
    return out(sh.select("z", F.col("lower").alias("worst_auc")))


CANDIDATES = {"mid": "(lo+hi)/2e0", "lo": "lo", "hi": "hi", "p1": "p1", "width": "hi-lo", "lo_plus_0.25": "lo+0.25e0*(hi-lo)", "lo_plus_0.75": "lo+0.75e0*(hi-lo)"}


@query("m18_candidate_orderings", "WITH " + V1B + ", cd AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS candidate, round({x}, 12) AS s, lo, hi FROM bx" for n, x in CANDIDATES.items()) + "), " + sharp_sql("cd", "s", "candidate") + f" SELECT candidate, {r('lower', 'worst_auc')}, {r('upper', 'best_auc')} FROM shp")
def _(spark, d):
    b = packed_boxes(spark, d)
    rows = [F.struct(F.lit(n).alias("candidate"), F.round(F.expr(x.replace("e0", "D").replace("0.25D", "0.25D")), 12).alias("s"))
            for n, x in CANDIDATES.items()]
    c = b.select("lo", "hi", "w", F.inline(F.array(*rows)))
    return out(rk.sharp_interval(c, "s", weight="w", keys=["candidate"]).select("candidate", F.col("lower").alias("worst_auc"), F.col("upper").alias("best_auc")))


# --- objectives -------------------------------------------------------------------

@query("l1_pointwise_worst", "WITH " + V1Z + f" SELECT qty, {r(f'avg({WORST})', 'worst')} FROM z GROUP BY qty")
def _(spark, d):
    return out(scored(spark, d).groupBy("qty").agg(ob.mean(s.worst_loss("s", "lo", "hi"), "w").alias("worst")))


@query("l2_decomposition", "WITH " + V1Z + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS loss, {r(f'avg((lo+hi)/2*{a}+(1e0-(lo+hi)/2)*{b})', 'midpoint_risk')}, {r(f'0.5e0*avg((hi-lo)*abs({a}-{b}))', 'penalty')} FROM z"
    for n, (a, b) in LOSS_SQL.items()))
def _(spark, d):
    b = scored(spark, d)
    aggs = []
    for n in LOSS_SQL:
        m, p = ob.risk_parts(loss=n, weight="w")
        aggs.append(F.struct(F.lit(n).alias("loss"), m.alias("midpoint_risk"), p.alias("penalty")))
    return out(b.agg(F.array(*aggs).alias("x")).select(F.inline("x")))


@query("l3_worst_case_risk", "WITH " + V1Z + f" SELECT z, {r(f'avg({WORST})', 'risk')} FROM z GROUP BY z")
def _(spark, d):
    b = packed_boxes(spark, d, "qty", "z").withColumn("s", margin())
    return out(b.groupBy("z").agg(ob.worst_case_risk(weight="w").alias("risk")))


@query("l4_least_favourable_vertex", "WITH " + V1Z + f" SELECT qty, {r(f'avg(CASE WHEN {L1} >= {L0} THEN hi ELSE lo END)', 'p')} FROM z GROUP BY qty")
def _(spark, d):
    return out(scored(spark, d).groupBy("qty").agg(ob.mean(s.least_favourable_vertex("s", "lo", "hi"), "w").alias("p")))


BAYES = f"CASE WHEN lo > 0.5e0 THEN {LOGIT('lo')} WHEN hi < 0.5e0 THEN {LOGIT('hi')} ELSE 0e0 END"
BAYES_REG = f"CASE WHEN hi-lo > 1e-9 THEN ({ENT('lo')}-{ENT('hi')})/(hi-lo) ELSE {LOGIT('(lo+hi)/2')} END"


def cell_boxes(spark, d, gamma=2.0):
    lo, hi = s.box("p1", "e", gamma)
    return cells(spark, d).withColumns({"lo": lo, "hi": hi})


@query("l5_bayes_score_risk", CELL + ", " + box_sql("1.3e0", "cell") + f" SELECT c1, c2, c3, {r(BAYES, 'score')} FROM bx")
def _(spark, d):
    return out(cell_boxes(spark, d, 1.3).select(*CELLS, s.bayes_score("lo", "hi").alias("score")))


@query("l6_bayes_score_regret", CELL + ", " + box_sql("2e0", "cell") + f" SELECT c1, c2, c3, {r(BAYES_REG, 'score')} FROM bx")
def _(spark, d):
    return out(cell_boxes(spark, d).select(*CELLS, s.bayes_score("lo", "hi", "regret").alias("score")))


@query("l7_minimax_regret", "WITH " + V1Z + f" SELECT z, {r(f'avg({REGRET})', 'regret')} FROM z GROUP BY z")
def _(spark, d):
    b = packed_boxes(spark, d, "qty", "z").withColumn("s", margin())
    return out(b.groupBy("z").agg(ob.minimax_regret(weight="w").alias("regret")))


@query("l8_abstention", "WITH " + V1N + ", " + grid_sql([1.0, 1.5, 2.0, 3.0], "nu") + ", " + box_sql("gamma", "gg") + f" SELECT gamma, {r(f'avg({ABST})', 'rate')} FROM bx GROUP BY gamma")
def _(spark, d):
    b = packed_lineitem(spark, d).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in (1.0, 1.5, 2.0, 3.0)])))
    lo, hi = s.box("p1", "e", F.col("gamma"))
    return out(b.withColumns({"lo": lo, "hi": hi}).groupBy("gamma").agg(ob.abstention_rate(weight="w").alias("rate")))


@query("l9_budget_fixed_lambda", "WITH " + V1N + f""", pk AS (SELECT qty, {Z_SQL} AS s, e, p1, count(*) AS w FROM nu GROUP BY ALL),
  gr AS (SELECT pk.*, i, -ln(2e0)+i*(2e0*ln(2e0)/128e0) AS tau FROM pk, range(129) t(i)),
  rr AS (SELECT *, (e*p1+(1e0-e)*{g_sql('p1', 'exp(tau)')}) AS p FROM gr), r2 AS (SELECT *, p*{L1}+(1e0-p)*{L0} AS risk FROM rr),
  o AS (SELECT r2.*, lam, risk-lam*abs(tau) AS obj FROM r2, (VALUES (0.05e0), (0.1e0), (0.2e0)) v(lam)),
  b AS (SELECT lam, w, arg_max(risk, round(obj, 13)*1e0 - i*1e-18) AS risk, arg_max(abs(tau), round(obj, 13)*1e0 - i*1e-18) AS tilt FROM o GROUP BY lam, qty, e, p1, w)
  SELECT lam, round(sum(w*risk)/sum(w), 4) + 0e0 AS risk FROM b GROUP BY lam""")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty").withColumn("s", margin())
    got = ob.budget_at(u, [0.05, 0.1, 0.2], gamma=2.0, weight="w")
    return got.select("lam", s.r6("risk", 4).alias("risk"))


@query("l9_budgeted_risk", "WITH " + V1N + f""", pk AS (SELECT row_number() OVER () AS u, * FROM (SELECT {Z_SQL} AS s, e, p1, count(*) AS w FROM nu GROUP BY ALL)),
  gr AS (SELECT u, s, e, p1, w, i, abs(-ln(2e0)+i*(2e0*ln(2e0)/128e0)) AS a, -ln(2e0)+i*(2e0*ln(2e0)/128e0) AS tau FROM pk, range(129) t(i)),
  rr AS (SELECT *, (e*p1+(1e0-e)*{g_sql('p1', 'exp(tau)')}) AS p FROM gr), lv AS (SELECT u, abs(i - 64) AS k, any_value(w) AS w, max(a) AS a, max(p*{L1}+(1e0-p)*{L0}) AS r FROM rr GROUP BY u, abs(i - 64)),
  sl AS (SELECT x.u, x.k, any_value(x.w) AS w, any_value(x.a) AS a, any_value(x.r) AS r, min((x.r-y.r)/(x.a-y.a)) FILTER (WHERE y.k < x.k) AS lft, max((y.r-x.r)/(y.a-x.a)) FILTER (WHERE y.k > x.k) AS rgt FROM lv x JOIN lv y ON x.u = y.u AND x.k <> y.k GROUP BY x.u, x.k),
  vx AS (SELECT *, a - lag(a) OVER o AS da, r - lag(r) OVER o AS dr FROM sl WHERE lft IS NULL OR rgt IS NULL OR lft > rgt WINDOW o AS (PARTITION BY u ORDER BY k)),
  st AS (SELECT lft AS slope, w*da AS da, w*dr AS dr FROM vx WHERE lft > 0), cu AS (SELECT *, sum(da) OVER o AS ca, sum(dr) OVER o AS cr FROM st WINDOW o AS (ORDER BY slope DESC ROWS UNBOUNDED PRECEDING)),
  b0 AS (SELECT sum(w) AS tw, sum(w*r) AS r0 FROM lv WHERE k = 0)
  SELECT budget, {r('(r0 + cr - dr + slope*(budget*tw - (ca - da)))/tw', 'risk')}, {r('slope', 'lam')}, budget AS tilt FROM cu, b0, (VALUES (0.05e0), (0.3e0)) v(budget) WHERE ca > budget*tw AND ca - da <= budget*tw""")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty").withColumn("s", margin())
    return out(ob.budgeted_risks(u, [0.05, 0.3], gamma=2.0, weight="w"))


METHODS_SQL = ("WITH " + V1N + ", " + grid_sql([1.5, 2.0], "nu", "gx") + ", " + box_sql("gamma", "gx", "bm")
               + f", me AS (SELECT *, 'risk' AS criterion, round({BAYES}, 12) AS s FROM bm UNION ALL SELECT *, 'regret', round({BAYES_REG}, 12) FROM bm), "
               "rep AS (SELECT * EXCLUDE (lo, hi) FROM me), " + box_sql("2e0", "rep", "bq") + ", " + sharp_sql("bq", "s", "gamma, criterion")
               + f", fl AS (SELECT gamma, criterion, avg(y*{L1}+(1e0-y)*{L0}) AS risk, avg({WORST}) AS wr, avg({REGRET}) AS mr, avg(CAST(s = 0 AS DOUBLE)) AS ab FROM bq GROUP BY gamma, criterion) "
               f"SELECT gamma, criterion, {r('risk')}, {r('lower', 'auroc_lo')}, {r('upper', 'auroc_hi')}, {r('wr', 'worstcase_risk')}, {r('mr', 'minimax_regret')}, {r('ab', 'abstention_rate')} FROM shp JOIN fl USING (gamma, criterion)")


@query("l10_method_table", METHODS_SQL)
def _(spark, d):
    u = packed_units_with_y(spark, d)
    u = u.withColumn("gamma", F.explode(F.array(F.lit(1.5), F.lit(2.0))))
    lo, hi = s.box("p1", "e", F.col("gamma"))
    u = u.withColumns({"lo": lo, "hi": hi})
    acts = F.array(*[F.struct(F.lit(c).alias("criterion"), F.round(s.bayes_score("lo", "hi", c), 12).alias("s")) for c in ("risk", "regret")])
    lo, hi = s.box("p1", "e", 2.0)
    m = u.select("gamma", "y", "w", "e", "p1", F.inline(acts)).withColumns({"lo": lo, "hi": hi})
    keys = ["gamma", "criterion"]
    rep = ev.bounds_report(m, keys=keys, weight="w").drop("abstention_rate")
    flat = m.groupBy(*keys).agg(ob.mean(s.loss_at("s", "y"), "w").alias("risk"), ob.mean((F.col("s") == 0).cast("double"), "w").alias("abstention_rate"))
    return out(rep.join(flat, keys).select(*keys, "risk", "auroc_lo", "auroc_hi", "worstcase_risk", "minimax_regret", "abstention_rate"))


def packed_units_with_y(spark, d):
    u = lineitem_units(spark, d)
    packed = u.groupBy(*CELLS, "t", "y", "y_obs").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return packed.join(nu.cell_nuisance(packed, CELLS, "t", "y_obs", weight="w").select(*CELLS, "e", "p1"), CELLS)


# --- sweeps -----------------------------------------------------------------------

GAMMAS = [1.0, 1.25, 1.5, 2.0, 3.0, 5.0]
SWEEP = "WITH " + V1N + ", " + grid_sql(GAMMAS, "nu") + ", " + box_sql("gamma", "gg", "bg") + f", z AS (SELECT *, {Z_SQL} AS s FROM bg), " + sharp_sql("z", "s", "gamma")


@query("g3_gamma_sweep", SWEEP + f", f AS (SELECT gamma, avg({WORST}) AS wr, avg({REGRET}) AS mr FROM z GROUP BY gamma) "
       f"SELECT gamma, {r('lower')}, {r('upper')}, {r('upper-lower', 'width')}, {r('wr', 'worstcase_risk')}, {r('mr', 'minimax_regret')} FROM shp JOIN f USING (gamma)")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty").withColumn("s", margin())
    return out(gm.sweep(u, GAMMAS, weight="w").select("gamma", "lower", "upper", "width", "worstcase_risk", "minimax_regret"))


@query("g4_break_even", SWEEP + f""" SELECT {r('coalesce(max(CASE WHEN lower >= 0.45e0 THEN gamma END), 1e0)', 'gamma_star')},
  CAST(max(CASE WHEN lower >= 0.45e0 THEN gamma END) IS NULL AS BIGINT) AS never, CAST(coalesce(max(CASE WHEN lower >= 0.45e0 THEN gamma END) >= max(gamma), false) AS BIGINT) AS at_grid_end FROM shp""")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty").withColumn("s", margin())
    t = gm.break_even(gm.sweep(u, GAMMAS, weight="w"), 0.45)
    return out(t.withColumn("at_grid_end", F.coalesce("at_grid_end", F.lit(0))))


@query("g5_smallest_containing", SWEEP + " SELECT min(CASE WHEN 0.55e0 >= lower-1e-9 AND 0.55e0 <= upper+1e-9 THEN gamma END) AS gamma FROM shp")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty").withColumn("s", margin())
    return out(gm.smallest_containing(gm.sweep(u, GAMMAS, weight="w"), 0.55))


@query("g5_search_containing")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty").withColumn("s", margin())
    packed = u.groupBy("s", "e", "p1").agg(F.sum("w").alias("w"))
    found = gm.search_containing(packed, 0.55, weight="w")
    return out(spark.createDataFrame([(found,)], "gamma double"))


@query("g6_containment", SWEEP + """, p AS (SELECT 0.5e0 AS a, 0.45e0 AS b, 0.55e0 AS c)
  SELECT gamma, CAST(a BETWEEN lower AND upper AS BIGINT) AS point_contained, CAST(b >= lower AND c <= upper AS BIGINT) AS ci_contained, CAST(c >= lower AND b <= upper AS BIGINT) AS ci_overlaps FROM shp, p""")
def _(spark, d):
    u = packed_lineitem(spark, d, "qty").withColumn("s", margin())
    c = gm.containment(gm.sweep(u, GAMMAS, weight="w"), point=0.5, ci_lo=0.45, ci_hi=0.55)
    return out(c.select("gamma", "point_contained", "ci_contained", "ci_overlaps"))


# --- uncertainty ---------------------------------------------------------------------

MEMBERS = 5
MEM_SQL = ("WITH " + V1B + f", mm AS (SELECT c1, c2, c3, {h32('uid', 'member')} % {MEMBERS} AS m, y_obs FROM u WHERE t = 1), "
           "mc AS (SELECT c1, c2, c3, m, (sum(y_obs)+0.5e0)/(count(*)+1e0) AS p FROM mm GROUP BY ALL), "
           "cb AS (SELECT DISTINCT c1, c2, c3, lo, hi FROM bx), wt AS (SELECT c1, c2, c3, count(*) AS w FROM u GROUP BY ALL), "
           f"agg AS (SELECT c1, c2, c3, avg(p) AS mp, avg({ENT('p')}) AS ha, min(p) AS mn, max(p) AS mx FROM mc GROUP BY ALL), "
           "j AS (SELECT agg.*, lo, hi, w, least(mn, lo) AS cl, greatest(mx, hi) AS ch FROM agg JOIN cb USING (c1, c2, c3) JOIN wt USING (c1, c2, c3)), "
           f"k AS (SELECT *, {ENT('mp')} AS total0, least({ENT('cl')}, {ENT('ch')}) AS al, {ENT('least(greatest(0.5e0, cl), ch)')} AS tot, "
           f"{ENT('least(greatest(0.5e0, lo), hi)')} - least({ENT('lo')}, {ENT('hi')}) AS cen FROM j)")


def member_cells(spark, d):
    """Cells with an array of member estimates from hash sub-samples, the box and a size."""
    u = lineitem_units(spark, d)
    m = u.filter("t = 1").groupBy(*CELLS, bucket("uid", "member", MEMBERS).alias("m")).agg(
        ((F.sum("y_obs") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("p"))
    arr = m.groupBy(*CELLS).agg(F.collect_list("p").alias("member_p"))
    return cell_boxes(spark, d).join(arr, CELLS)


@query("u1_naive_decomposition", MEM_SQL + f" SELECT c1, c2, c3, {r('total0', 'total')}, {r('ha', 'aleatoric')}, {r('total0-ha', 'epistemic')} FROM k")
def _(spark, d):
    return out(member_cells(spark, d).select(*CELLS, *[c.alias(n) for n, c in un.naive_parts().items()]))


@query("u2_credal_decomposition", MEM_SQL + f" SELECT c1, c2, c3, {r('tot', 'total')}, {r('al', 'aleatoric')}, {r('tot-al', 'epistemic')}, {r('cen', 'censoring')}, {r('greatest(tot-al-cen, 0e0)', 'sampling')} FROM k")
def _(spark, d):
    return out(member_cells(spark, d).select(*CELLS, *[c.alias(n) for n, c in un.credal_parts().items()]))


@query("u3_aleatoric_interval", "WITH " + V1B + f" SELECT {r('avg(least(' + ENT('lo') + ',' + ENT('hi') + '))', 'lower')}, {r('avg(' + ENT('least(greatest(0.5e0, lo), hi)') + ')', 'upper')} FROM bx")
def _(spark, d):
    return out(un.aleatoric_interval(cell_boxes(spark, d), weight="n"))


@query("u4_summary", MEM_SQL + f" SELECT {r('sum(w*tot)/sum(w)', 'total')}, {r('sum(w*al)/sum(w)', 'aleatoric')}, {r('sum(w*(tot-al))/sum(w)', 'epistemic')}, {r('sum(w*cen)/sum(w)', 'censoring')}, {r('sum(w*greatest(tot-al-cen, 0e0))/sum(w)', 'sampling')} FROM k")
def _(spark, d):
    return out(un.summary(member_cells(spark, d), un.credal_parts(), weight="n"))
