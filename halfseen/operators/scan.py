"""Ordered scans (running sums, maxima, last values) that survive one hot key.

A window ``partitionBy(key).orderBy(t)`` puts a whole key into one task.  When a
key holds more than ``block_rows`` rows, its order axis is cut at measured
quantiles into blocks; the window runs per (key, block) and the state carried
between blocks is a window over one summary row per block.  Results are equal
to the plain window; without hot keys the plan *is* the plain window.

Measured on the driver: only keys above ``block_rows`` (at most N / block_rows of
them) and at most about N / block_rows split points in total, which is also the
size bound of everything broadcast here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfseen.operators.joins import match
from halfseen.operators.lineage import cut

BLOCK_ROWS_CONF = "spark.halfseen.blockRows"
DEFAULT_BLOCK_ROWS = 2_000_000
SAMPLE = 200
_BLOCK = "__scan_block"
_KEY = "__scan_all"


def block_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))


def hot_splits(df: DataFrame, keys: Sequence[str], value: str, limit: int) -> DataFrame | None:
    """Split points of every key with more than ``limit`` rows, or None."""
    if df.count() <= limit:          # no key can be hot; a bare scan counts from file footers
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cut_n")).filter(F.col("__cut_n") > limit)
    hot = sizes.collect()
    if not hot:
        return None
    cuts = math.ceil(max(r["__cut_n"] for r in hot) / limit)
    hot_df = df.sparkSession.createDataFrame(hot, sizes.schema)
    marks = [i / cuts for i in range(1, cuts)]
    # about SAMPLE rows per block are enough to cut by: results do not depend on where the cuts lie
    per_key = (
        match(df.sample(min(1.0, SAMPLE / limit), seed=1), F.broadcast(hot_df), keys)
        .groupBy(*keys, "__cut_n")
        .agg(F.percentile_approx(value, F.lit(marks), F.lit(max(10_000, 10 * cuts))).alias("__cut_points"))
        # a key just above the limit needs few of the common split points
        .withColumn("__cut_step", F.greatest(F.lit(1), F.floor(F.lit(cuts * limit) / F.col("__cut_n"))))
        .withColumn("__cut_points", F.expr("filter(__cut_points, (s, i) -> (i + 1) % __cut_step = 0 OR __cut_step = 1)"))
        .select(*keys, "__cut_points")
        .filter(F.size("__cut_points") > 0)
    )
    rows = per_key.collect()
    if not rows:
        return None
    out = df.sparkSession.createDataFrame(rows, per_key.schema)
    # two-level search: the last element of every chunk, then one chunk
    return out.withColumn("__cut_chunk", F.ceil(F.sqrt(F.size("__cut_points"))).cast("int")).withColumn(
        "__cut_heads",
        F.expr("transform(sequence(1, cast(ceil(size(__cut_points) / __cut_chunk) as int)),"
               " i -> element_at(__cut_points, least(i * __cut_chunk, size(__cut_points))))"))


def _count_splits(value: str, op: str) -> str:
    heads = f"size(filter(__cut_heads, h -> h {op} {value}))"
    return f"({heads} * __cut_chunk + size(filter(slice(__cut_points, {heads} * __cut_chunk + 1, __cut_chunk), s -> s {op} {value})))"


class OrderedScan:
    """Running values over ``keys`` in ``order``; see the module docstring.

    ``order[0]`` must be numeric; it drives the blocks.  If ``tie`` names a
    column uniform in [0, 1) that is ``order[1]``, even a single hot order value
    is cut.  ``then`` adds sort columns of its own direction after ``order``; it is for
    scans measured small only.  ``add`` may be called repeatedly: later specs can use
    earlier results.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 desc: bool = False, tie: str | None = None, measure: DataFrame | None = None,
                 measured_small: bool = False, then: Sequence[Column] = ()):
        self.keys = list(keys)
        self.order = list(order)
        self.desc = desc
        self.then = list(then)
        self._own_key = not self.keys
        if self._own_key:
            self.keys = [_KEY]
            df = df.withColumn(_KEY, F.lit(0))
            measure = measure.withColumn(_KEY, F.lit(0)) if measure is not None else None
        hot = None
        if not measured_small:
            probe = (measure if measure is not None else df).select(*self.keys, self.order[0])
            hot = hot_splits(probe, self.keys, self.order[0], block_rows(df))
        self.hot = hot is not None
        if self.hot and self.then:
            raise ValueError("extra sort columns need a scan measured small")
        if self.hot:
            below, upto = _count_splits(self.order[0], "<"), _count_splits(self.order[0], "<=")
            inside = f"floor({tie} * ({upto} - {below}))" if tie else "0"
            # several branches read the blocked rows: hand them over once instead of recomputing
            df = cut(match(df, F.broadcast(hot), self.keys, "left")
                     .withColumn(_BLOCK, F.expr(
                         f"CASE WHEN __cut_points IS NULL THEN NULL WHEN {upto} > {below}"
                         f" THEN {below} + 1 + {inside} ELSE {below} END").cast("bigint"))
                     .drop("__cut_points", "__cut_chunk", "__cut_heads"))
        self.df = df

    def _sort(self, columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if self.desc else F.col(c).asc() for c in columns]

    def add(self, **specs: tuple[str, Column]) -> "OrderedScan":
        """Kinds: ``sum``, ``max``, ``last`` (ignoring nulls), ``total``; all inclusive."""
        part = self.keys + ([_BLOCK] if self.hot else [])
        whole = Window.partitionBy(*part)
        run = whole.orderBy(*self._sort(self.order), *self.then).rowsBetween(Window.unboundedPreceding, 0)
        local = {
            name: {"sum": lambda c: F.sum(c).over(run), "max": lambda c: F.max(c).over(run),
                   "last": lambda c: F.last(c, ignorenulls=True).over(run),
                   "total": lambda c: F.sum(c).over(whole)}[kind](col)
            for name, (kind, col) in specs.items()
        }
        base = self.df
        out = base.withColumns(local)
        if self.hot:
            out = self._carry(base, out, specs)
        self.df = out
        return self

    def _carry(self, base: DataFrame, out: DataFrame, specs) -> DataFrame:
        place = F.struct(*self.order)
        pick = F.min_by if self.desc else F.max_by
        summary = {"sum": F.sum, "max": F.max, "total": F.sum,
                   "last": lambda c: pick(c, F.when(c.isNotNull(), place))}
        blocks = (base.filter(F.col(_BLOCK).isNotNull()).groupBy(*self.keys, _BLOCK)
                  .agg(*[summary[k](c).alias(f"__carry_{n}") for n, (k, c) in specs.items()]))
        key = Window.partitionBy(*self.keys)
        before = key.orderBy(*self._sort([_BLOCK])).rowsBetween(Window.unboundedPreceding, -1)
        over = {"sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before),
                "last": lambda c: F.last(c, ignorenulls=True).over(before),
                "total": lambda c: F.sum(c).over(key)}
        carried = blocks.select(*self.keys, _BLOCK,
                                *[over[k](F.col(f"__carry_{n}")).alias(f"__carry_{n}")
                                  for n, (k, _) in specs.items()])
        merge = {"sum": lambda a, b: F.when(b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + b),
                 "max": lambda a, b: F.greatest(a, b),
                 "last": lambda a, b: F.coalesce(a, b),
                 "total": lambda a, b: F.coalesce(b, a)}
        out = match(out, F.broadcast(carried), [*self.keys, _BLOCK], "left")
        out = out.withColumns({n: merge[k](F.col(n), F.col(f"__carry_{n}"))
                               for n, (k, _) in specs.items()})
        return out.drop(*[f"__carry_{n}" for n in specs])

    def result(self) -> DataFrame:
        out = self.df.drop(_BLOCK) if self.hot else self.df
        return out.drop(_KEY) if self._own_key else out


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", *,
                 desc: bool = False, tie: str | None = None, measured_small: bool = False) -> DataFrame:
    """Zero-based position in the order, as a column."""
    scan = OrderedScan(df, keys, order, desc=desc, tie=tie, measured_small=measured_small)
    return scan.add(**{name: ("sum", F.lit(1).cast("bigint"))}).result().withColumn(
        name, F.col(name) - 1)
