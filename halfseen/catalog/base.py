"""Registry of checkable queries, the unit views they run on, and SQL text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halfseen.functions import scalar as s
from halfseen.operators import nuisance as nu
from halfseen.operators import temporal as tm
from halfseen.operators.joins import match
from halfseen.operators.lineage import cut, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CELLS = ["c1", "c2", "c3"]


def query(name: str, sql: str | None = None):
    """Register a query and, if it has one, its oracle."""
    def add(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def out(df: DataFrame, *columns: str) -> DataFrame:
    """Published shape: doubles rounded to 6 digits, counts as BIGINT."""
    fields = {f.name: f.dataType.typeName() for f in df.schema.fields}
    sel = []
    for c in columns or df.columns:
        kind = fields[c]
        if kind in ("double", "float", "decimal"):
            sel.append(s.r6(F.col(c)).alias(c))
        elif kind in ("integer", "short", "byte", "boolean"):
            sel.append(F.col(c).cast("int").cast("bigint").alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


# --- V1: lineitem -------------------------------------------------------------

def lineitem_units(spark: SparkSession, d: str) -> DataFrame:
    """One row per line; decision = shipped line status, outcome = returned."""
    return table(spark, d, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT),"
        " CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),"
        " CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus, date_format(l_shipdate, 'yyyyMMdd')) AS uid",
        "CAST(l_linestatus = 'F' AS INT) AS t", "CAST(l_returnflag = 'R' AS DOUBLE) AS y",
        "IF(l_linestatus = 'F', CAST(l_returnflag = 'R' AS DOUBLE), NULL) AS y_obs",
        "floor(l_quantity / 10) AS c1", "CAST(round(l_discount * 100) AS BIGINT) DIV 4 AS c2",
        "CAST(round(l_tax * 100) AS BIGINT) DIV 3 AS c3", "l_quantity AS qty", "l_extendedprice AS price",
        "l_discount AS disc", "l_tax AS tax", "l_suppkey % 5 AS z", "l_orderkey AS okey", "l_suppkey AS skey")


V1 = """u AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT),
    CAST(round(l_extendedprice*100) AS BIGINT), CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT),
    l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d')) AS uid,
  CAST(l_linestatus = 'F' AS INT) AS t, CAST(l_returnflag = 'R' AS DOUBLE) AS y,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_returnflag = 'R' AS DOUBLE) END AS y_obs,
  CAST(floor(l_quantity/10) AS BIGINT) AS c1, CAST(round(l_discount*100) AS BIGINT)//4 AS c2,
  CAST(round(l_tax*100) AS BIGINT)//3 AS c3, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc,
  l_tax AS tax, l_suppkey % 5 AS z, l_orderkey AS okey, l_suppkey AS skey FROM lineitem)"""


def rates_sql(n="n", nt="nt", ny="ny") -> str:
    return (f"least(greatest(({nt}+0.5e0)/({n}+1e0), 0.001e0), 0.999e0) AS e, "
            f"least(greatest(({ny}+0.5e0)/({nt}+1e0), 0.001e0), 0.999e0) AS p1")


def cell_sql(src="u", cells="c1, c2, c3", name="cell") -> str:
    return (f"{name} AS (SELECT {cells}, n, nt, ny, {rates_sql()} FROM (SELECT {cells}, CAST(count(*) AS DOUBLE) AS n, "
            f"CAST(sum(t) AS DOUBLE) AS nt, CAST(sum(CASE WHEN t = 1 AND y_obs = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS ny FROM {src} GROUP BY {cells}))")


V1N = V1 + ", " + cell_sql() + ", nu AS (SELECT u.*, e, p1 FROM u JOIN cell USING (c1, c2, c3))"


def g_sql(p: str, g: str) -> str:
    return f"({g}*({p})/(1e0+({g}-1e0)*({p})))"


def box_sql(gamma: str, src="nu", name="bx") -> str:
    """Adds lo and hi at ``gamma`` (number or column) to ``src``."""
    return (f"{name} AS (SELECT *, e*p1+(1e0-e)*{g_sql('p1', f'(1e0/({gamma}))')} AS lo, "
            f"e*p1+(1e0-e)*{g_sql('p1', f'({gamma})')} AS hi FROM {src})")


def lineitem_nuisance(spark: SparkSession, d: str) -> DataFrame:
    return nu.with_nuisance(lineitem_units(spark, d), CELLS, "t", "y_obs")


def lineitem_boxes(spark: SparkSession, d: str, gamma: float = 2.0) -> DataFrame:
    lo, hi = s.box("p1", "e", gamma)
    return lineitem_nuisance(spark, d).withColumns({"lo": lo, "hi": hi})


def packed_lineitem(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Distinct (cell, extra) rows with their counts ``w`` and nuisances.

    Everything downstream is linear in the units, so the line table is read once and
    shrinks map-side before any join.
    """
    u = lineitem_units(spark, d)
    packed = u.groupBy(*CELLS, *extra, "t", "y_obs").agg(F.count(F.lit(1)).cast("double").alias("w"))
    table_ = nu.cell_nuisance(packed, CELLS, "t", "y_obs", weight="w").select(*CELLS, "e", "p1")
    return match(packed, table_, CELLS)


def packed_boxes(spark: SparkSession, d: str, *extra: str, gamma: float = 2.0) -> DataFrame:
    lo, hi = s.box("p1", "e", gamma)
    return packed_lineitem(spark, d, *extra).withColumns({"lo": lo, "hi": hi})


# --- V2: documents and labels ---------------------------------------------------

def document_units(spark: SparkSession, d: str) -> DataFrame:
    """One row per document; decision = somebody labelled it."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").join(lab, "doc_id", "left")
    return docs.select("doc_id", "lang", F.col("source").alias("z"), "n_chars", "text",
                       F.col("quality").isNotNull().cast("int").alias("t"), F.col("quality").cast("double").alias("y_obs"),
                       "toxic", F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).alias("c2"))


V2 = """dv AS (SELECT d.doc_id, lang, source AS z, n_chars, text, CAST(quality IS NOT NULL AS INT) AS t,
  CAST(quality AS DOUBLE) AS y_obs, toxic, CAST(least(n_chars // 1000, 9) AS BIGINT) AS c2
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
V2N = V2 + ", " + cell_sql("dv", "lang, c2", "dcell") + ", dn AS (SELECT dv.*, e, p1 FROM dv JOIN dcell USING (lang, c2))"


def document_nuisance(spark: SparkSession, d: str) -> DataFrame:
    return nu.with_nuisance(document_units(spark, d), ["lang", "c2"], "t", "y_obs")


# --- V3: orders and customers ---------------------------------------------------

def order_units(spark: SparkSession, d: str) -> DataFrame:
    """One row per order; decision = not pending, outcome = high price."""
    o, c = spread(table(spark, d, "orders")), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    t = (F.col("o_orderstatus") != "P").cast("int")
    y = (F.col("o_totalprice") > 250000).cast("double")
    return j.select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("ckey"), t.alias("t"), y.alias("y"),
                    F.when(F.col("o_orderstatus") != "P", y).alias("y_obs"), F.col("o_orderpriority").alias("priority"),
                    F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 2500).alias("c1"),
                    F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("bigint").alias("z"),
                    F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("odate"))


V3 = """ov AS (SELECT o_orderkey AS okey, o_custkey AS ckey, CAST(o_orderstatus <> 'P' AS INT) AS t,
  CAST(o_totalprice > 250000 AS DOUBLE) AS y, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice > 250000 AS DOUBLE) END AS y_obs,
  o_orderpriority AS priority, c_mktsegment AS segment, CAST(floor(c_acctbal/2500) AS BIGINT) AS c1, c_acctbal AS bal,
  CAST(c_nationkey AS BIGINT) AS z, o_totalprice AS price, o_orderdate AS odate FROM orders JOIN customer ON o_custkey = c_custkey)"""


# --- V4: events -----------------------------------------------------------------

def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Ids, subjects, times and ``k`` of all events, parsed once and handed over by type: :func:`events` takes it for ``d``.

    For queries that read many types, each in several steps.
    """
    return cut(events(spark, d).select("event_id", "subject", "at", "event_type", "k"), by="event_type")


def events(spark: SparkSession, d: str | DataFrame, kind: str | None = None) -> DataFrame:
    e = d if isinstance(d, DataFrame) else table(spark, d, "events")
    if kind is not None:
        e = e.filter(F.col("event_type") == kind)
    if isinstance(d, DataFrame):
        return e
    return e.select("event_id", F.col("user_id").alias("subject"), tm.micros("ts").alias("at"), "event_type", "value",
                    F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")


EV = """ev AS (SELECT event_id, user_id AS subject, epoch_us(ts) AS tat, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events)"""

DAY = tm.DAY
HOUR = tm.HOUR


def signup_spans(spark: SparkSession, d: str, days: float = 4.0) -> DataFrame:
    """Spans (stay_id, subject, start, stop) opened by a signup and closed after k-dependent days."""
    e = events(spark, d, "signup")
    return e.select(F.col("event_id").alias("stay_id"), "subject", F.col("at").alias("start"),
                    (F.col("at") + F.col("k") * int(days * DAY / 100)).alias("stop"), "k")


SPANS = f"""sp AS (SELECT event_id AS stay_id, subject, tat AS start, tat + k * {int(4.0 * DAY / 100)} AS stop, k
  FROM ev WHERE event_type = 'signup')"""


def h32(ident: str, salt: str) -> str:
    """SQL of the hash integer of :func:`halfseen.functions.hashing.hash32`."""
    return f"CAST('0x' || substr(md5(CAST({ident} AS VARCHAR) || '|' || '{salt}'), 1, 8) AS BIGINT)"


def hu(ident: str, salt: str) -> str:
    return f"({h32(ident, salt)} / 4294967296e0)"


def r(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0e0 AS {name or x}"


def sharp_sql(src: str, score: str = "s", keys: str = "", weight: str = "1e0", phi: str | None = None,
              c=("0e0", "0e0", "-0.5e0"), d=("0e0", "1e0", "-1e0"), tag: str = "") -> str:
    """CTEs ending in ``shp{tag}(keys, lower, upper, pi_lower, pi_upper)`` over ``src`` with lo and hi."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    v = phi or score
    rank = "v" if phi else "(cw-0.5e0*w)/tot"
    group = f"GROUP BY {k}v"
    return f"""g1{tag} AS (SELECT {k}{v} AS v, sum({weight}) AS w, sum(({weight})*lo) AS sl, sum(({weight})*hi) AS sh FROM {src} {group}),
g2{tag} AS (SELECT *, sum(w) OVER ({part}) AS tot, sum(w) OVER ({part} ORDER BY v) AS cw FROM g1{tag}),
g3{tag} AS (SELECT {k}v, w/tot AS w, sl/tot AS base, (sh-sl)/tot AS cap, {rank} AS phi FROM g2{tag}),
g4{tag} AS (SELECT *, sum(cap) OVER ({part} ORDER BY v) AS cc, sum(cap*phi) OVER ({part} ORDER BY v) AS cv,
  sum(cap) OVER ({part}) AS ct, sum(cap*phi) OVER ({part}) AS vt, sum(base) OVER ({part}) AS p0,
  sum(base*phi) OVER ({part}) AS v0, sum(CASE WHEN phi <> 0 THEN w ELSE 0e0 END) OVER ({part}) AS share FROM g3{tag}),
g5{tag} AS (SELECT {k}phi, p0, ct, share, 'low' AS side, p0+cc-cap AS a, v0+cv-cap*phi AS va, cap FROM g4{tag}
  UNION ALL SELECT {k}phi, p0, ct, share, 'up', p0+ct-cc, v0+vt-cv, cap FROM g4{tag}),
g6{tag} AS (SELECT {k}side, greatest(a, greatest(p0, 1e-6)) AS s0, least(a+cap, least(p0+ct, 1e0-1e-6)) AS s1,
  va-phi*a+({c[0]}) AS n0, phi+({c[1]}) AS n1, {c[2]} AS n2, {d[0]} AS d0, {d[1]} AS d1, {d[2]} AS d2 FROM g5{tag}),
g7{tag} AS (SELECT *, n2*d1-n1*d2 AS qa, 2e0*(n2*d0-n0*d2) AS qb, n1*d0-n0*d1 AS qc FROM g6{tag} WHERE s1 >= s0-1e-15),
g8{tag} AS (SELECT *, CASE WHEN abs(qa) >= 1e-14 AND qb*qb-4e0*qa*qc >= 0 THEN (-qb+sqrt(greatest(qb*qb-4e0*qa*qc,0e0)))/(2e0*qa)
    WHEN abs(qa) < 1e-14 AND abs(qb) >= 1e-14 THEN -qc/qb END AS r1,
  CASE WHEN abs(qa) >= 1e-14 AND qb*qb-4e0*qa*qc >= 0 THEN (-qb-sqrt(greatest(qb*qb-4e0*qa*qc,0e0)))/(2e0*qa) END AS r2 FROM g7{tag}),
g9{tag} AS (SELECT *, unnest([s0, s1, CASE WHEN r1 > s0 AND r1 < s1 THEN r1 END, CASE WHEN r2 > s0 AND r2 < s1 THEN r2 END]) AS pi FROM g8{tag}),
g10{tag} AS (SELECT {k}side, pi, (n0+n1*pi+n2*pi*pi)/(d0+d1*pi+d2*pi*pi) AS val FROM g9{tag}
  WHERE pi IS NOT NULL AND abs(d0+d1*pi+d2*pi*pi) > 1e-14),
shp{tag} AS (SELECT {k}min(val) FILTER (WHERE side = 'low') AS lower, max(val) FILTER (WHERE side = 'up') AS upper,
  arg_min(pi, val) FILTER (WHERE side = 'low') AS pi_lower, arg_max(pi, val) FILTER (WHERE side = 'up') AS pi_upper
  FROM g10{tag}{f' GROUP BY {keys}' if keys else ''})"""


def grid_sql(gammas, src: str, name: str = "gg") -> str:
    values = ", ".join(f"({float(g)!r}e0)" for g in gammas)
    return f"{name} AS (SELECT * FROM {src} CROSS JOIN (VALUES {values}) t(gamma))"
