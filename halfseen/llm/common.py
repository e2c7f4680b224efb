"""What the operators of this package share: registry, table reads, hand-over, distributed ranks and components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halfseen.operators.lineage import shared_folder

ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its DuckDB text."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The table itself; texts go to Python in batches of at most BATCH_ROWS rows, so that a worker holds few of them at a time.

    The session's own setting stays if it is smaller. It counts when a plan runs, so it is
    left in place for the caller.
    """
    spark = df.sparkSession
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS or int(spark.conf.get(ARROW_ROWS)) <= 0:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return df


def gathered(batches: Iterator[pa.RecordBatch], least: int = 8192) -> Iterator[pa.Table]:
    """Batches put together to tables of at least `least` rows."""
    parts, rows = [], 0
    for batch in batches:
        parts.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield pa.Table.from_batches(parts)
            parts, rows = [], 0
    if rows:
        yield pa.Table.from_batches(parts)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder all executors share."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end inside go when they end; use it for plans that run once."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def handover(df: DataFrame) -> DataFrame:
    """Write a stage's rows as Parquet in the shared folder and go on from there.

    It cuts lineage, survives lost executors and stops later stages from recomputing
    what is upstream.
    """
    path = shared_path(df.sparkSession, "handover")
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """The table handed over with a number of its own for every row; it is drawn while writing and stays."""
    return handover(df.withColumn(name, F.monotonically_increasing_id()))


def join_back(rows: DataFrame, groups: DataFrame, key: str, size: str, limit: int = 100_000) -> DataFrame:
    """Inner join of rows with one line per key that holds the key's number of rows.

    Keys above `limit` rows are broadcast, so that no task gets all rows of a key; there are
    at most (rows / limit) of them. The others go through the plain join.
    """
    hot = groups.where(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= limit), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def gapless_rank(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows of each key 0, 1, 2, … without bringing a key into one task.

    A key of n rows is cut into about sqrt(n) parts by a hash of the row; rows are numbered
    in their part and shifted by the parts before, so no task sees more than about sqrt(n)
    rows of a key, if the table has a column that tells equal rows apart (`numbered`). The
    numbering is gapless per key; it follows `order` inside a part only. Null keys count as
    a key. Equal rows may swap numbers.
    """
    names = [f"__k{i}" for i in range(len(by))]

    def same(suffix: str = "") -> Column:
        on = F.lit(True)
        for b, n in zip(by, names):
            on &= F.col(b).eqNullSafe(F.col(n + suffix))
        return on

    if by:
        sizes = df.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)]).agg(F.count(F.lit(1)).alias("__n"))
        rows = df.join(sizes, same()).drop(*names)
    else:
        rows = df.withColumn("__n", F.lit(df.count()))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.ceil(F.sqrt("__n")))).drop("__n")
    parts = rows.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col("__part").alias("__pp")).agg(F.count(F.lit(1)).alias("__m"))
    ahead = Window.partitionBy(*(names or [F.lit(0)])).orderBy("__pp").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__m").over(ahead), F.lit(0))).drop("__m")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1)
    return rows.join(parts, same() & (F.col("__part") == F.col("__pp"))).select(
        *df.columns, (F.col("__r") + F.col("__before")).cast("long").alias(out))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); component is the smallest node reachable.

    Nodes hook onto their smallest neighbour, chains are shortened by pointer jumping and
    the graph is contracted until no edge is left. Every step is a join or a partial
    aggregation on at most the edges left, handed over in the shared folder.
    """
    edges = handover(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        parent = handover(hook.select("node", F.least("node", "m").alias("up")))
        while True:
            up = parent.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            jumped = handover(parent.join(up, F.col("up") == F.col("n2"))
                              .select("node", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")))
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:
            labels = handover(labels.join(parent.select(F.col("node").alias("n2"), F.col("up").alias("u2")),
                                          F.col("up") == F.col("n2"), "left")
                              .select("node", F.coalesce("u2", "up").alias("up")))
        pa, pb = (parent.select(F.col("node").alias(f"n{c}"), F.col("up").alias(f"u{c}")) for c in "ab")
        edges = handover(edges.join(pa, F.col("a") == F.col("na")).select("ua", "b")
                         .join(pb, F.col("b") == F.col("nb"))
                         .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a <> b").distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("up"))
    return labels.select("node", F.col("up").alias("component"))
