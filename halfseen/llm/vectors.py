"""Array columns as numpy matrices, and sums of matrices over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry of a million or more counts as not finite: its squares would not add up exactly in a long.
LIMIT = 1 << 20


def finite(vector: str) -> Column:
    """True for a vector that is there and holds only finite numbers below LIMIT."""
    return F.coalesce(F.forall(F.col(vector), lambda v: v.isNotNull() & (F.abs(v) < F.lit(float(LIMIT)))), F.lit(False))


def integers(vector: str, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of every entry, as long."""
    return F.transform(F.col(vector), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long") + F.lit(shift))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long lists as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> DataFrame:
    """(pos, value): the entries of part(batch), summed over the batches of a task and then over all tasks.

    `part` gives a vector of fixed length; kind is double, or long for exact sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pos", "value"])

    value = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
    return df.mapInArrow(run, f"pos long, value {kind}").groupBy("pos").agg(F.sum(value).alias("value"))


def collected(sums: DataFrame, length: int, kind: type = float) -> np.ndarray:
    """The summed vector on the driver; its length is that of a model, never of the data."""
    out = np.zeros(length, float if kind is float else object)
    for r in sums.collect():
        out[r["pos"]] = kind(r["value"])
    return out
