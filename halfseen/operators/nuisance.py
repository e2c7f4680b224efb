"""Selection rate e(x) and selected outcome rate p1(x) from cells of x.

The only per-row work is one join with a table of cells (broadcast behind a measured
size); counts are combined map-side.  Leave-fold-out estimates subtract the fold's own counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col, clip
from halfseen.operators.cell_join import match_cells
from halfseen.operators.joins import match
from halfseen.operators.lineage import cut

CLIP = 1e-3


def _rates(n: Column, nt: Column, ny: Column, smooth: float, bound: float) -> tuple[Column, Column]:
    e = (nt + 0.5 * smooth) / (n + smooth)
    p1 = (ny + 0.5 * smooth) / (nt + smooth)
    return clip(e, bound, 1.0 - bound), clip(p1, bound, 1.0 - bound)


def cell_counts(df: DataFrame, cells: Sequence[str], t="t", y="y", weight=None) -> DataFrame:
    """Per cell: ``n``, selected ``nt`` and selected positives ``ny``."""
    w = F.lit(1.0) if weight is None else as_col(weight).cast("double")
    t, y = as_col(t), as_col(y)
    return df.groupBy(*cells).agg(
        F.sum(w).alias("n"), F.sum(F.when(t == 1, w).otherwise(0.0)).alias("nt"),
        F.sum(F.when((t == 1) & (y == 1), w).otherwise(0.0)).alias("ny"))


def cell_nuisance(df: DataFrame, cells: Sequence[str], t="t", y="y", *, smooth: float = 1.0,
                  bound: float = CLIP, weight=None) -> DataFrame:
    """One row per cell with ``n``, ``nt``, ``ny``, ``e`` and ``p1``."""
    table = cell_counts(df, cells, t, y, weight)
    e, p1 = _rates(F.col("n"), F.col("nt"), F.col("ny"), smooth, bound)
    return table.withColumns({"e": e, "p1": p1})


def with_nuisance(df: DataFrame, cells: Sequence[str], t="t", y="y", *, fit: DataFrame | None = None,
                  smooth: float = 1.0, bound: float = CLIP) -> DataFrame:
    """Units with ``e`` and ``p1``.  ``fit`` is the training table (default: the units).

    Units in a cell the training table never saw get the overall rates.
    """
    table = cell_nuisance(fit if fit is not None else df, cells, t, y, smooth=smooth, bound=bound)
    if fit is None:
        return match_cells(df, table.select(*cells, "e", "p1"), list(cells))
    table = cut(table)
    whole = table.agg(F.sum("n").alias("n"), F.sum("nt").alias("nt"), F.sum("ny").alias("ny"))
    e, p1 = _rates(F.col("n"), F.col("nt"), F.col("ny"), smooth, bound)
    base = whole.select(F.struct(e.alias("e"), p1.alias("p1")).alias("b")).scalar()
    out = match_cells(df, table.select(*cells, F.col("e").alias("__e"), F.col("p1").alias("__p")), list(cells), "left", handed=True)
    return out.withColumns({"e": F.coalesce("__e", base["e"]), "p1": F.coalesce("__p", base["p1"])}).drop("__e", "__p")


def out_of_fold(df: DataFrame, cells: Sequence[str], fold: str, t="t", y="y", *, smooth: float = 1.0,
                bound: float = CLIP) -> DataFrame:
    """Units with ``e`` and ``p1`` estimated on the other folds only."""
    table = cell_counts(df, [*cells, fold], t, y)
    cell = Window.partitionBy(*cells)           # at most one row per fold in a cell
    rest = {c: F.sum(c).over(cell) - F.col(c) for c in ("n", "nt", "ny")}
    e, p1 = _rates(rest["n"], rest["nt"], rest["ny"], smooth, bound)
    table = table.select(*cells, fold, e.alias("e"), p1.alias("p1"))
    return match_cells(df, table, [*cells, fold])


def by_decision_maker(df: DataFrame, cells: Sequence[str], z: str, t="t", y="y", *,
                      smooth: float = 1.0, bound: float = CLIP) -> DataFrame:
    """Long grid: one row per (cell, z) that occurs, with ``n``, ``e``, ``p1``."""
    return cell_nuisance(df, [*cells, z], t, y, smooth=smooth, bound=bound)


def full_grid(df: DataFrame, cells: Sequence[str], z: str, t="t", y="y", *, smooth: float = 1.0, bound: float = CLIP,
              most_levels: int = 10_000) -> DataFrame:
    """Long grid with every cell under every level of ``z``.

    A pair that does not occur gets ``n`` = 0 and the cell's own rates over all levels: its
    best prediction without that decision maker.  Levels come to the driver to be spread
    over the cells, so their number is checked.
    """
    levels = [r[0] for r in df.select(z).distinct().limit(most_levels + 1).collect()]
    if len(levels) > most_levels:
        raise ValueError(f"more than {most_levels} levels of {z}: merge rare ones first")
    if not levels:
        return by_decision_maker(df, cells, z, t, y, smooth=smooth, bound=bound)
    kind = df.schema[z].dataType
    whole = cell_nuisance(df, cells, t, y, smooth=smooth, bound=bound)
    every = whole.select(*cells, F.col("e").alias("__e"), F.col("p1").alias("__p1"),
                         F.explode(F.array(*[F.lit(v).cast(kind) for v in levels])).alias(z))
    seen = by_decision_maker(df, cells, z, t, y, smooth=smooth, bound=bound)
    out = match(every, seen, [*cells, z], "left")
    return out.select(*cells, z, F.coalesce("n", F.lit(0).cast(seen.schema["n"].dataType)).alias("n"),
                      F.coalesce("e", "__e").alias("e"), F.coalesce("p1", "__p1").alias("p1"))


def z_arrays(grid: DataFrame, cells: Sequence[str], z: str) -> DataFrame:
    """One row per cell: ``zs`` = array of (z, e, p1), ``n``.  Levels of z must be few."""
    return grid.groupBy(*cells).agg(F.sort_array(F.collect_list(F.struct(z, "e", "p1"))).alias("zs"),
                                    F.sum("n").alias("n"))


def marginalise(grid: DataFrame, cells: Sequence[str], share: DataFrame, z: str,
                bound: float = CLIP) -> DataFrame:
    """``e = sum pi_z e_z`` and ``p1 = sum pi_z e_z p1_z / e`` per cell.

    ``share`` has ``z`` and its probability ``pi``; within a cell the shares are
    renormalised over the levels that occur in it.
    """
    both = grid.join(share, z)
    sums = both.groupBy(*cells).agg(
        F.sum("pi").alias("w"), F.sum(F.col("pi") * F.col("e")).alias("se"),
        F.sum(F.col("pi") * F.col("e") * F.col("p1")).alias("sp"), F.sum("n").alias("n"))
    return sums.select(*cells, "n", clip(F.col("se") / F.col("w"), bound, 1.0 - bound).alias("e"),
                       clip(F.col("sp") / F.col("se"), bound, 1.0 - bound).alias("p1"))


def ipw_weight(e, floor: float = 0.02) -> Column:
    return 1.0 / clip(e, floor, 1.0)


def aipw_target(t, y, e, p1, floor: float = 0.02) -> Column:
    y = F.coalesce(as_col(y), F.lit(0.0))
    return as_col(p1) + as_col(t) * (y - as_col(p1)) / clip(e, floor, 1.0)


def imputation_target(t, y, p1) -> Column:
    return F.when(as_col(t) == 1, F.coalesce(as_col(y), F.lit(0.0))).otherwise(as_col(p1))
