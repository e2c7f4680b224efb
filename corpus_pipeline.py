"""From raw documents to packed sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halfseen.llm.common import handover, table
from halfseen.llm.decontaminate import contained_items
from halfseen.llm.exact_dedup import exact_dedup
from halfseen.llm.near_dedup import near_dedup
from halfseen.llm.packing import pack
from halfseen.llm.toxicity import toxicity

ORACLE_SQL = None


ROW = "__row"


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a long that names one row: the id where no row lacks one and none has it twice, else a number.

    Numbers are drawn while the rows are handed over, so they stay the same afterwards.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if shared.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return handover(docs.withColumn(ROW, F.monotonically_increasing_id()))


def only(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows that are (left_semi) or are not (left_anti) among the chosen ones."""
    return rows.join(chosen.select(ROW).distinct(), ROW, how).drop(ROW)


def firsts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group (row, grp) the row with the smallest id; one without id only where the group has none."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    return groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("grp").agg(F.min(order)[ROW].alias(ROW))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model calls toxic go; it learns from all labels."""
    rows = keyed(docs)
    scored = toxicity(rows, table(spark, sf_dir, "labels"), row_col=ROW)
    return only(rows, scored.where("predicted = 1"), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) one row stays, with the smallest id."""
    rows = keyed(docs)
    groups = exact_dedup(rows, ROW).select(ROW, F.col("keep_id").alias("grp"))
    return only(rows, firsts(rows, groups), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, with the smallest id."""
    rows = keyed(docs)
    groups = near_dedup(rows, ROW).select(ROW, F.col("component_id").alias("grp"))
    return only(rows, firsts(rows, groups), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rows = keyed(docs)
    return only(rows, contained_items(rows, table(spark, sf_dir, "benchmark"), ROW), "left_anti")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of training sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each handed over as Parquet to the next.

    Nulls, empty texts, repeated rows and empty tables have the results that the operators
    state. Stages decide by row: rows that share an id, or have none, stay or go each for
    itself, and of equal texts one row is left.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = handover(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
