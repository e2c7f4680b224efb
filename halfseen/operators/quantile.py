"""Exact linear-interpolated quantiles without sorting a column.

Small groups: values are counted map-side, ordered by a scan, and the two order
statistics around each requested position survive.  A group above the block limit is
narrowed by brackets instead: sampled split points cut its value axis, one aggregate
counts what lies on and between them, and only the intervals that hold a requested
position are looked into again, until they are small enough to sort.  Split points
steer the work only; every count is exact, so the sample never shows in the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col
from halfseen.operators.joins import match
from halfseen.operators.lineage import cut
from halfseen.operators.scan import SAMPLE, OrderedScan, block_rows

GRID = 256            # most split points of one interval


def exact_quantiles(df: DataFrame, columns: dict[str, object], probs: Sequence[float], *,
                    keys: Sequence[str] = (), count=None) -> DataFrame:
    """One row per (keys, name): ``n`` and ``q0, q1, ...``; nulls and NaN are skipped.

    ``count`` is an optional frequency column.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), as_col(c).cast("double").alias("value"))
                      for n, c in columns.items()])
    freq = F.lit(1) if count is None else as_col(count)
    long = df.select(*keys, F.inline(pairs), freq.cast("bigint").alias("__f"))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    group, limit = [*keys, "name"], block_rows(df)
    hot = None
    if df.count() * len(columns) > limit:          # else no group can be large; a bare scan counts from file footers
        sizes = long.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"), F.sum("__f").alias("n"))
        hot = sizes.filter(F.col("__rows") > limit)
        hot = cut(hot)
        hot = None if hot.isEmpty() else hot
    if hot is None:
        return _read_off(_counted(long, group), probs, group)
    long = cut(long)
    narrow = _bracketed(long, hot, probs, group, limit)
    cold = match(long, F.broadcast(hot.select(*group)), group, "left_anti")
    return _read_off(_counted(cold, group).unionByName(narrow), probs, group)


def _counted(long: DataFrame, group: list[str]) -> DataFrame:
    """Per distinct value its frequency, the frequency up to it and the group's total."""
    table = long.groupBy(*group, "value").agg(F.sum("__f").alias("__n"))
    scan = OrderedScan(table, group, ["value"], measured_small=True)
    return scan.add(__cum=("sum", F.col("__n")), n=("total", F.col("__n"))).result().select(
        *group, "n", "value", "__n", "__cum")


def _places(probs: Sequence[float]) -> list[Column]:
    """Zero-based order statistics around every requested position."""
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in probs]
    return [f(p).cast("bigint") for p in at for f in (F.floor, F.ceil)]


def _holds(places: Sequence[Column]) -> Column:
    """Whether a row of (__cum, __n) covers one of the positions."""
    return F.exists(F.array(*places), lambda k: (F.col("__cum") > k) & (F.col("__cum") - F.col("__n") <= k))


def _bracketed(long: DataFrame, hot: DataFrame, probs: Sequence[float], group: list[str], limit: int) -> DataFrame:
    """The values of large groups that requested positions fall on, as ``_counted`` gives them.

    ``open_`` holds the intervals still to be looked into: above ``__lo`` and below ``__hi``
    (null: unbounded), with the frequency ``__base`` below them.  At most two per group and
    position are open, and groups are at most rows / limit.
    """
    places = _places(probs)
    ends = {"__lo": F.lit(None).cast("double"), "__hi": F.lit(None).cast("double"), "__base": F.lit(0).cast("bigint")}
    open_, done = hot.withColumns(ends), []
    span = [*group, "n", "__lo", "__hi", "__base"]
    while True:
        top = open_.agg(F.max("__rows").alias("m")).collect()[0]["m"]
        if top is None:
            break
        within = _inside(long, open_, group)
        if top <= limit:
            table = within.groupBy(*span, "value").agg(F.sum("__f").alias("__n"))
            run = Window.partitionBy(*group, "__lo").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            table = table.withColumn("__cum", F.col("__base") + F.sum("__n").over(run))
            done.append(table.filter(_holds(places)).select(*group, "n", "value", "__n", "__cum"))
            break
        cells = cut(_cells(within, _marks(long, open_, group, limit, top), group, span))
        order = Window.partitionBy(*group, "__lo").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("__cum", F.col("__base") + F.sum("__n").over(order)).filter(_holds(places))
        on = F.col("__cell") % 2 == 1                       # odd: on a split point, even: between two
        done.append(cells.filter(on).select(*group, "n", F.col("__to").alias("value"), "__n", "__cum"))
        below = F.col("__cum") - F.col("__n")
        open_ = cut(cells.filter(~on).select(*group, "__rows", "n", F.col("__from").alias("__lo"),
                                             F.col("__to").alias("__hi"), below.alias("__base")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _inside(long: DataFrame, open_: DataFrame, group: list[str]) -> DataFrame:
    both = match(long, F.broadcast(open_.drop("__rows")), group)
    return both.filter((F.col("__lo").isNull() | (F.col("value") > F.col("__lo")))
                       & (F.col("__hi").isNull() | (F.col("value") < F.col("__hi"))))


def _marks(long: DataFrame, open_: DataFrame, group: list[str], limit: int, top: int) -> DataFrame:
    """Split points of every open interval, about four per ``limit`` rows and GRID at most."""
    most = min(GRID, max(2, math.ceil(4 * top / limit)))
    # about SAMPLE rows between two split points
    rate = min(1.0, SAMPLE * most / top)
    sampled = _inside(long if rate == 1.0 else long.sample(rate, seed=1), open_, group)
    grid = F.lit([i / most for i in range(1, most)])
    marks = sampled.groupBy(*group, "__lo").agg(
        F.array_distinct(F.percentile_approx("value", grid, F.lit(10 * most))).alias("__marks"))
    wide = match(open_, marks, [*group, "__lo"], "left")
    # an interval just above the limit needs few of them
    step = F.greatest(F.lit(1), F.floor(F.lit(most * limit) / (4 * F.col("__rows"))).cast("int"))
    wide = wide.withColumn("__step", step)
    return wide.withColumn("__marks", F.expr("filter(__marks, (m, i) -> i % __step = least(__step, size(__marks)) - 1)"))


def _cells(within: DataFrame, marks: DataFrame, group: list[str], span: list[str]) -> DataFrame:
    """Rows and frequency on every split point and between neighbours."""
    mine = marks.select(*group, "__lo", "__marks")
    rows = match(within, F.broadcast(mine), [*group, "__lo"])
    rows = rows.withColumn("__at", F.lit(0))                # points below the value, by halving steps of generated code
    for step in (1 << k for k in reversed(range(GRID.bit_length() - 1))):
        rows = rows.withColumn("__at", F.expr(f"__at + IF(get(__marks, __at + {step - 1}) < value, {step}, 0)"))
    cell = F.expr("2 * __at + IF(get(__marks, __at) = value, 1, 0)")
    cells = rows.withColumn("__cell", cell).groupBy(*span, "__cell").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("__f").alias("__n"))
    cells = match(cells, F.broadcast(mine), [*group, "__lo"])
    left = F.try_element_at("__marks", F.nullif((F.col("__cell") / 2).cast("int"), F.lit(0)))
    right = F.try_element_at("__marks", (F.col("__cell") / 2).cast("int") + 1)
    return cells.withColumns({"__from": F.coalesce(left, "__lo"), "__to": F.coalesce(right, "__hi")}).drop("__marks")


def _read_off(table: DataFrame, probs: Sequence[float], group: list[str]) -> DataFrame:
    """Interpolated quantiles from the order statistics among the counted values."""
    picks, out = [F.first("n").alias("n")], []
    places = _places(probs)
    for i, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        for tag, k in zip("ab", places[2 * i:2 * i + 2]):
            here = (F.col("__cum") > k) & (F.col("__cum") - F.col("__n") <= k)
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"__{tag}{i}"))
        frac = pos - F.floor(pos)
        out.append((F.col(f"__a{i}") + frac * (F.col(f"__b{i}") - F.col(f"__a{i}"))).alias(f"q{i}"))
    return table.groupBy(*group).agg(*picks).select(*group, "n", *out)
