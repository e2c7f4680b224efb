"""Time-ordered joins and de-duplication; times are BIGINT microseconds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col
from halfseen.operators.joins import match
from halfseen.operators.lineage import cut
from halfseen.operators.scan import OrderedScan, block_rows, hot_splits

DAY = 86_400_000_000
HOUR = 3_600_000_000


def micros(ts) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


@dataclass(frozen=True)
class Lookup:
    """The looked-up side of an as-of join.

    Of several rows at one instant the one with the largest ``tie`` counts (the
    smallest with ``smallest``).  A match farther than ``tolerance`` is dropped.
    Only rows with ``where`` are looked up; sizes are measured without it, from key
    and time alone, since no group grows by a condition.
    """

    df: DataFrame
    time: str
    cols: Sequence[str]
    name: str
    tie: str | None = None
    smallest: bool = False
    tolerance: int | None = None
    where: Column | None = None


def asof_join(left: DataFrame, lookups: Sequence[Lookup], by: str, time: str,
              directions: Sequence[str] = ("backward",)) -> DataFrame:
    """``left`` plus one struct column per lookup and direction.

    All lookups share one union, one shuffle and one sort per direction; the
    matched row's time is in the struct as ``at``.  With both directions the
    columns are ``<name>_backward`` and ``<name>_forward``.
    """
    payload = F.struct(*[F.col(c) for c in left.columns])
    # left rows without key or time match nothing: they travel along under null, salted
    known = F.col(by).isNotNull() & F.col(time).isNotNull()
    salt = F.when(known, 0).otherwise(F.pmod(F.xxhash64(payload), F.lit(4096)).cast("int"))
    spans = [left.select(F.when(known, F.col(by)).alias("__by"), salt.alias("__salt"), F.col(time).alias("__t"),
                         F.lit(1).alias("__side"), payload.alias("__left"))]
    probe = left.filter(known).select(F.col(by).alias("__by"), F.col(time).alias("__t"))
    for look in lookups:
        probe = probe.union(look.df.select(F.col(by), F.col(look.time)))
    probe = probe.withColumn("__salt", F.lit(0))
    small = hot_splits(probe, ["__by", "__salt"], "__t", block_rows(left)) is None
    for look in lookups:
        value = F.struct(F.col(look.time).alias("at"), *[F.col(c) for c in look.cols])
        tie = value if look.tie is None else F.col(look.tie)
        keyed = look.df.filter(F.col(by).isNotNull() & F.col(look.time).isNotNull())
        keyed = keyed if look.where is None else keyed.filter(look.where)
        if small:            # the scan's own sort puts the winner of an instant last
            side = keyed.select(F.col(by).alias("__by"), F.col(look.time).alias("__t"), value.alias(f"__{look.name}"),
                                tie.alias(f"__tie_{look.name}"))
        else:
            # as in the scan's sort, a row without tie wins only where no other row is
            pick, last = (F.min_by, tie.isNull()) if look.smallest else (F.max_by, tie.isNotNull())
            side = keyed.groupBy(F.col(by).alias("__by"), F.col(look.time).alias("__t")).agg(
                pick(value, F.struct(last, tie)).alias(f"__{look.name}"))
        spans.append(side.withColumns({"__side": F.lit(0), "__salt": F.lit(0)}))
    both = spans[0]
    for other in spans[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    # at equal times a looked-up row must come first in the scan direction; with hot keys the
    # left rows of one instant are spread between 0 and 1, so that even an instant can be cut
    if small:
        both = both.withColumns({"__up": F.col("__side").cast("double"), "__down": 1.0 - F.col("__side")})
    else:
        spot = 0.01 + 0.98 * F.pmod(F.xxhash64("__left"), F.lit(1 << 20)) / float(1 << 20)
        is_left = F.col("__side") == 1
        both = both.withColumns({"__up": F.when(is_left, spot).otherwise(0.0), "__down": F.when(is_left, spot).otherwise(0.999999)})
    names = {(look.name, d): look.name if len(directions) == 1 else f"{look.name}_{d}"
             for look in lookups for d in directions}
    ties = [F.col(f"__tie_{look.name}").desc_nulls_first() if look.smallest else F.col(f"__tie_{look.name}").asc()
            for look in lookups] if small else []
    for d in directions:
        desc = d == "forward"
        place = "__down" if desc else "__up"
        scan = OrderedScan(both, ["__by", "__salt"], ["__t", place], desc=desc, tie=place,
                           measure=probe, measured_small=small, then=ties)
        scan.add(**{f"__m_{names[look.name, d]}": ("last", F.col(f"__{look.name}"))
                    for look in lookups})
        both = scan.result()
    out = both.filter(F.col("__side") == 1)
    matched = {}
    for look in lookups:
        for d in directions:
            m = F.col(f"__m_{names[look.name, d]}")
            if look.tolerance is not None:
                m = F.when(F.abs(F.col("__t") - m["at"]) <= look.tolerance, m)
            matched[names[look.name, d]] = m
    return out.select("__left.*", *[m.alias(n) for n, m in matched.items()])


def nearest_join(left: DataFrame, right: DataFrame, *, by: str, time: str, right_time: str,
                 right_id: str, window: int) -> DataFrame:
    """Nearest right row in time per left row; ties go to the smaller right id.

    Adds ``nearest_id``, ``gap`` (signed, right minus left) and ``t`` = 1 iff
    ``|gap| <= window``.  The nearest row is reported even outside the window.
    """
    look = Lookup(right, right_time, [right_id], "near", tie=right_id, smallest=True)
    both = asof_join(left, [look], by, time, ("backward", "forward"))

    def candidate(name: str) -> Column:
        c = F.col(name)
        return F.when(c.isNotNull(), F.struct(
            F.abs(c["at"] - F.col(time)).alias("dist"), c[right_id].alias("id"),
            (c["at"] - F.col(time)).alias("gap")))

    best = F.array_min(F.array(candidate("near_backward"), candidate("near_forward")))
    out = both.withColumn("__b", best).drop("near_backward", "near_forward")
    return out.withColumns({
        "nearest_id": F.col("__b.id"), "gap": F.col("__b.gap"),
        "t": F.coalesce((F.col("__b.dist") <= window).cast("int"), F.lit(0))}).drop("__b")


def unique_or_fail(df: DataFrame, ident: str) -> DataFrame:
    """The table itself; the job fails if an id occurs twice."""
    dup = df.groupBy(ident).count().filter("count > 1").limit(1).count()
    if dup:
        raise ValueError(f"{ident} must be unique (one row per unit)")
    return df


def coverage(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def restrict_to_coverage(df: DataFrame, cover: DataFrame, time: str, pad: int) -> DataFrame:
    """Rows inside [first - pad, last + pad]; the one-row cover is a scalar subquery."""
    lo = cover.select(F.col("first") - pad).scalar()
    hi = cover.select(F.col("last") + pad).scalar()
    return df.filter((F.col(time) >= lo) & (F.col(time) <= hi))


def _walk(gap: int):
    """Keep rows of (subject, time) order batch by batch; what is carried on is one subject and its last kept time."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_by = open_t = None
        for batch in batches:
            if not batch.num_rows:
                continue
            by, t = batch.column(0), batch.column(1).to_numpy()
            changed = pc.not_equal(by.slice(1), by.slice(0, len(by) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, changed])
            end = np.r_[first[1:], len(t)]                    # of each subject in this batch
            i = first.copy()
            if open_by is not None and by[0] == open_by:
                i[0] = np.searchsorted(t[:end[0]], open_t + gap)
            take, last = [], open_t
            while True:                                       # one step of all subjects at a time
                i, end, first = (x[i < end] for x in (i, end, first))
                if not len(i):
                    break
                take.append(i)
                if end[-1] == len(t):
                    last = t[i[-1]]
                i = _next_from(t, i, end, t[i] + gap)
            at = np.sort(np.concatenate(take)) if take else np.zeros(0, np.int64)
            open_by, open_t = by[len(by) - 1], last
            yield batch.take(pa.array(at))
    return kept


def _next_from(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) of each stretch whose time is at least ``least``, by bisection of all at once."""
    while (lo < hi).any():
        mid = (lo + hi) // 2
        short = (lo < hi) & (t[np.minimum(mid, len(t) - 1)] < least)
        lo, hi = np.where(short, mid + 1, lo), np.where(short | (lo >= hi), hi, mid)
    return lo


def greedy_gap(df: DataFrame, *, by: str, ident: str, time: str, gap: int,
               small_group: int = 200_000) -> DataFrame:
    """Rows kept by: the first per subject, then each at least ``gap`` after the last kept.

    At one instant the row with the smallest id counts, of equal ids any one. Rows without
    subject or time are left out. Whole rows are sorted by subject, time and id and walked
    in Arrow batches, all subjects of a batch at once, with no join back; subjects above
    ``small_group`` rows are solved by pointer doubling over (subject, instant), which has
    no hot group.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    rows = df.filter(F.col(by).isNotNull() & F.col(time).isNotNull())
    limit = min(small_group, block_rows(df))
    hot = None
    if df.select(by).count() > limit:
        hot = rows.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("__by")
        hot = cut(hot)                                        # at most rows / limit subjects
        hot = None if hot.isEmpty() else hot
    cold = rows if hot is None else rows.join(F.broadcast(hot), rows[by] == hot["__by"], "left_anti")
    fields = ["__by", "__t", "__row"]
    lined = cold.select(F.col(by).alias("__by"), F.col(time).cast("bigint").alias("__t"), F.struct(*df.columns).alias("__row"))
    lined = lined.repartition("__by").sortWithinPartitions("__by", "__t", f"__row.{ident}")
    chosen = lined.mapInArrow(_walk(gap), lined.select(*fields).schema).select("__row.*")
    if hot is None:
        return chosen
    points = rows.join(F.broadcast(hot), rows[by] == hot["__by"], "left_semi").groupBy(
        F.col(by).alias("__by"), F.col(time).alias("__t")).agg(F.min_by(F.struct(*df.columns), F.struct(ident)).alias("__row"))
    points = cut(points)
    reached = _chain(points.select("__by", "__t"), gap)
    return chosen.unionByName(points.join(reached, ["__by", "__t"], "left_semi").select("__row.*"))


def _chain(points: DataFrame, gap: int) -> DataFrame:
    """Members of the path first -> next(first) -> ... by pointer doubling."""
    points = cut(points)
    probe = points.withColumn("__from", F.col("__t") + gap)
    jump = asof_join(probe, [Lookup(points, "__t", [], "nxt")], "__by", "__from", ("forward",))
    jump = cut(jump.select("__by", "__t", F.col("nxt.at").alias("__to")))
    reached = points.groupBy("__by").agg(F.min("__t").alias("__t"))
    while True:
        new = (reached.join(jump, ["__by", "__t"]).filter(F.col("__to").isNotNull())
               .select("__by", F.col("__to").alias("__t")))
        new = cut(new)
        if not new.limit(1).count():
            break
        reached = cut(reached.unionByName(new))
        ahead = jump.select("__by", F.col("__t").alias("__to"), F.col("__to").alias("__to2"))
        jump = cut(jump.join(ahead, ["__by", "__to"], "left").select("__by", "__t", F.col("__to2").alias("__to")))
    return points.join(reached, ["__by", "__t"], "left_semi")


def first_containing(left: DataFrame, spans: DataFrame, *, by: str, time: str, start: str, end: str,
                     ident: str) -> DataFrame:
    """The span with start <= time <= end that starts first, of equal starts the smallest id (``span_id``), without a range join.

    A span that ends no later than one before it in that order can never win.  Among the
    others order and ends rise together, so the first end >= time decides.  They are handed
    over, since the join measures them first.
    """
    one = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    one = one.groupBy(by, start, end).agg(F.min(ident).alias(ident))
    run = OrderedScan(one.withColumn("__e", F.col(end)), [by], [start, ident], measure=spans.select(by, start))
    run.add(__reach=("max", F.col("__e")))
    # the running maximum includes the row itself: it is new iff it was not reached before
    ranked = run.result().groupBy(by, "__reach").agg(
        F.min(F.struct(F.col(start), F.col(ident))).alias("__f"))
    front = ranked.select(by, F.col("__reach").alias(end), F.col(f"__f.{start}").alias(start),
                          F.col(f"__f.{ident}").alias(ident))
    out = asof_join(left, [Lookup(cut(front), end, [start, ident], "span")], by, time, ("forward",))
    hit = F.col(f"span.{start}") <= F.col(time)
    return out.withColumn("span_id", F.when(hit, F.col(f"span.{ident}"))).drop("span")


def windowed_counts(left: DataFrame, spans: DataFrame, *, by: str, ident: str, windows: dict[str, tuple[str, str]],
                    start: str, end: str, counts: dict[str, Column]) -> DataFrame:
    """Per left row and window: how many spans overlap it, by several conditions.

    ``windows`` names (lower, upper) columns; the result has ``<count>_<window>``.
    #overlapping = #(start <= upper) - #(end < lower), so one scan over starts, ends and
    probes yields every count and nothing of the size of the pairs is built.  Spans must
    have start <= end and ``ident`` must be unique.
    """
    tally = {n: c.cast("boolean").cast("bigint") for n, c in counts.items()}
    marks = F.array(
        F.struct(F.col(start).alias("__t"), F.lit(0).alias("__side"), *[c.alias(f"__s_{n}") for n, c in tally.items()],
                 *[F.lit(None).cast("bigint").alias(f"__e_{n}") for n in tally]),
        F.struct(F.col(end).alias("__t"), F.lit(2).alias("__side"),
                 *[F.lit(None).cast("bigint").alias(f"__s_{n}") for n in tally], *[c.alias(f"__e_{n}") for n, c in tally.items()]))
    events = spans.filter(F.col(by).isNotNull()).select(F.col(by).alias("__by"), F.inline(marks))
    # at equal times: starts, then probes, then ends
    probes = F.array(*[F.struct(F.lit(w).alias("__w"), F.lit(i).alias("__end"), F.col(c).alias("__t"))
                       for w, pair in windows.items() for i, c in enumerate(pair)])
    asked = left.select(F.col(by).alias("__by"), F.col(ident).alias("__id"), F.inline(probes), F.lit(1).alias("__side"))
    rows = events.unionByName(asked, allowMissingColumns=True)
    scan = OrderedScan(rows, ["__by"], ["__t", "__side"])
    scan.add(**{f"__r{x}_{n}": ("sum", F.col(f"__{x}_{n}")) for n in tally for x in "se"})
    at = scan.result().filter(F.col("__id").isNotNull())
    picked = at.groupBy("__id").agg(*[
        (F.coalesce(F.max(F.when((F.col("__w") == w) & (F.col("__end") == 1), F.col(f"__rs_{n}"))), F.lit(0))
         - F.coalesce(F.max(F.when((F.col("__w") == w) & (F.col("__end") == 0), F.col(f"__re_{n}"))), F.lit(0))
         ).alias(f"{n}_{w}") for w in windows for n in tally])
    found = left.join(picked.withColumnRenamed("__id", ident), ident, "left")
    return found.na.fill(0, [f"{n}_{w}" for w in windows for n in tally])


def overlap_pairs(left: DataFrame, spans: DataFrame, *, by: str, lower: str, upper: str,
                  start: str, end: str, cell: int) -> DataFrame:
    """Pairs of a left window and an overlapping span, found by (key, time cell).

    Only for results that list the matches; a pair is emitted in its first common
    cell, so none is repeated.  AQE splits a skewed (key, cell) join partition.
    """
    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))

    lhs = left.withColumn("__cell", cells(lower, upper))
    rhs = spans.filter(F.col(end) >= F.col(start)).withColumn("__cell", cells(start, end))
    first = F.greatest(F.floor(F.col(lower) / cell), F.floor(F.col(start) / cell))
    return (lhs.join(rhs, [by, "__cell"])
            .filter((F.col(start) <= F.col(upper)) & (F.col(end) >= F.col(lower))
                    & (F.col("__cell") == first)).drop("__cell"))


def attach_decision_maker(records: DataFrame, units: DataFrame, *, by: str, time: str,
                          services: DataFrame | None = None, stays: DataFrame | None = None) -> DataFrame:
    """``z`` and ``z_source``: care unit, else service, else admission location, else 'unknown'.

    ``units(by, unit, intime, outtime)``, ``services(by, service, transfertime,
    endtime)``, ``stays(by, location, admittime, dischtime)``.  Each source is looked
    up as of the record; only its latest-started row is tested for being active.
    """
    looks = [Lookup(units, "intime", ["unit", "outtime"], "__u", tie="unit", where=F.trim("unit") != "")]
    if services is not None:
        looks.append(Lookup(services, "transfertime", ["service", "endtime"], "__s", tie="service",
                            where=F.col("service").isNotNull()))
    if stays is not None:
        looks.append(Lookup(stays, "admittime", ["location", "dischtime"], "__a", tie="location",
                            where=F.col("location").isNotNull()))
    out = asof_join(records, looks, by, time)
    t = F.col(time)
    open_or = lambda end, ok: end.isNull() | ok
    steps = [("careunit", F.when(open_or(F.col("__u.outtime"), t < F.col("__u.outtime")), F.col("__u.unit")))]
    if services is not None:
        steps.append(("curr_service", F.when(open_or(F.col("__s.endtime"), t <= F.col("__s.endtime")),
                                             F.col("__s.service"))))
    if stays is not None:
        steps.append(("admission_location", F.when(open_or(F.col("__a.dischtime"), t <= F.col("__a.dischtime")),
                                                   F.col("__a.location"))))
    source = F.lit("unknown")
    for name, value in reversed(steps):
        source = F.when(value.isNotNull(), name).otherwise(source)
    return out.withColumns({"z": F.coalesce(*[v for _, v in steps], F.lit("unknown")),
                            "z_source": source}).drop(*[look.name for look in looks])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in an explicit order, as a map-side combined minimum."""
    place = F.struct(*[as_col(o).alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, place).alias("__row")).select("__row.*")


def merge_rare(df: DataFrame, level: str, min_count: int, other: str = "other") -> DataFrame:
    """Rare levels become ``other``; adds the level's index and its share of all rows."""
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("__n"))
    named = F.when(F.col("__n") >= min_count, F.col(level)).otherwise(F.lit(other))
    counts = counts.withColumn("__z", named)
    # one row per level: small enough for a single ordered window
    merged = counts.groupBy("__z").agg(F.sum("__n").alias("__m"))
    merged = merged.withColumns({
        "z_index": (F.row_number().over(Window.orderBy("__z")) - 1).cast("int"),
        "z_share": F.col("__m") / F.sum("__m").over(Window.partitionBy())})
    table = counts.join(merged, "__z").select(level, F.col("__z").alias("z_merged"), "z_index", "z_share")
    return match(df, table, [level])
