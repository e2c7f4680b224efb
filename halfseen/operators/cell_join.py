"""Units joined to a table of cells: broadcast behind a measured size, hot cells apart beyond it.

The cells are an aggregate of the units, so Spark has no size for them when it plans and
would shuffle every unit by a key of few values.  Here they are handed over once and
measured.  Small ones are broadcast and the units stay where they are.  Beyond the bound
only cells with more than a block of units (at most units / block of them) are broadcast
to their units; the others are shuffled, and none of them fills a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from halfseen.operators.joins import match
from halfseen.operators.lineage import cut
from halfseen.operators.scan import block_rows

BROADCAST_BYTES_CONF = "spark.halfseen.broadcastBytes"
BROADCAST_BYTES = 64 << 20
FIELD = 16                # bytes of a fixed-width value in a hashed relation, and of a variable one beside its content


def measured_bytes(cells: DataFrame) -> int:
    """Upper estimate of a handed-over table in a hashed relation: rows times fields, plus the content of variable-length fields."""
    wide = [f.name for f in cells.schema.fields if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    content = [F.sum(F.coalesce(F.octet_length(F.col(c) if isinstance(cells.schema[c].dataType, (StringType, BinaryType)) else F.to_json(F.array(c))), F.lit(0)))
               for c in wide]
    row = cells.agg(F.count(F.lit(1)), *content).collect()[0]
    return int(row[0]) * FIELD * (len(cells.columns) + 1) + sum(int(v or 0) for v in row[1:])


def match_cells(units: DataFrame, cells: DataFrame, on: Sequence[str], how: str = "inner", *, handed: bool = False) -> DataFrame:
    """``match(units, cells, on, how)`` for cells that hold a key at most once; ``how`` is inner or left.

    Null keys match each other.  The rows are the same on every path.  ``handed`` says that
    ``cells`` is a stored table (or a projection of one), which need not be written again.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    conf = units.sparkSession.conf
    cells = cells if handed else cut(cells)
    if measured_bytes(cells) <= int(conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES))):
        return match(units, F.broadcast(cells), on, how)
    limit = block_rows(units)
    hot = cut(units.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*on))
    if hot.isEmpty():
        return match(units, cells, on, how)
    few = F.broadcast(hot)                                      # at most units / limit rows
    apart = match(match(units, few, on, "left_semi"), F.broadcast(match(cells, few, on, "left_semi")), on, how)
    return match(match(units, few, on, "left_anti"), cells, on, how).unionByName(apart)
