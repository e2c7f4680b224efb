"""Small-cell suppression of published counts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col

MIN_CELL = 10


def count_cell(n, least: int = MIN_CELL) -> Column:
    """``{n, suppressed}``: zero and counts of at least ``least`` are published."""
    n = as_col(n)
    hide = (n > 0) & (n < least)
    return F.struct(F.when(~hide, n).cast("bigint").alias("n"), hide.alias("suppressed"))


def rate_cell(k, n, least: int = MIN_CELL) -> Column:
    """A proportion, published only if n, k and n - k are each 0 or at least ``least``."""
    k, n = as_col(k), as_col(n)
    fine = lambda x: (x == 0) | (x >= least)
    ok = (n >= least) & fine(k) & fine(n - k)
    return F.struct(F.when(ok, k / n).alias("value"), F.when(ok, n).cast("bigint").alias("n"),
                    (~ok).alias("suppressed"))


def _suppress(least: int):
    def fix(cells: pd.DataFrame) -> pd.DataFrame:
        grid = cells.pivot(index="row", columns="col", values="n").fillna(0).astype(int).sort_index()
        why = grid.map(lambda v: "primary" if 0 < v < least else "")
        changed = True
        while changed:
            changed = False
            for axis in ("row", "col"):
                lines = [(r, list(grid.columns)) for r in grid.index] if axis == "row" else [
                    (c, list(grid.index)) for c in grid.columns]
                for line, others in lines:
                    at = [(line, o) if axis == "row" else (o, line) for o in others]
                    if sum(why.at[a] != "" for a in at) != 1:
                        continue
                    spare = sorted((grid.at[a], *a) for a in at if why.at[a] == "" and grid.at[a] > 0)
                    if spare:
                        why.at[spare[0][1], spare[0][2]] = "complementary"
                        changed = True
        out = grid.stack().rename("n").reset_index()
        out["reason"] = [why.at[r, c] for r, c in zip(out["row"], out["col"])]
        out["tab"] = cells["tab"].iloc[0]
        return out[["tab", "row", "col", "n", "reason"]]
    return fix


def suppress_table(counts: DataFrame, row: str, col: str, n: str, *, table=None,
                   least: int = MIN_CELL) -> DataFrame:
    """Primary and complementary suppression of published two-way tables.

    ``counts`` are already aggregated cells; each table (key ``table``) is fixed on its
    own.  A row or column with exactly one hidden cell also loses its smallest
    non-zero cell, until nothing changes.
    """
    tab = F.lit("all") if table is None else as_col(table)
    cells = counts.select(tab.cast("string").alias("tab"), F.col(row).cast("string").alias("row"),
                          F.col(col).cast("string").alias("col"), F.col(n).cast("bigint").alias("n"))
    done = cells.groupBy("tab").applyInPandas(
        _suppress(least), "tab string, row string, col string, n bigint, reason string")
    hide = F.col("reason") != ""
    return done.select("tab", "row", "col", F.when(~hide, F.col("n")).alias("n"), hide.alias("suppressed"),
                       F.when(hide, F.col("reason")).alias("reason"))


def suppress_partition(counts: DataFrame, level: str, n: str, *, least: int = MIN_CELL) -> DataFrame:
    """One-way counts of a published total."""
    out = suppress_table(counts.withColumn("__r", F.lit("_")), "__r", level, n, least=least)
    return out.select(F.col("col").alias(level), "n", "suppressed", "reason")


def unit_counts(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    return units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
