"""Exact duplicates: 128-bit content hash, bytes compared inside groups, one stable id stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import handover, join_back, query, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                hash_bits: int = 128, limit: int = 100_000) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    Texts are grouped by the leading `hash_bits` of their SHA-256 together with the text
    itself, so a group's members are compared byte by byte by the aggregation (after
    map-side combining, so one text that fills a third of the table costs one row per
    map task). Members find their group by the hash alone, those of groups above `limit`
    rows without a shuffle; only hashes that several different texts share are matched on
    the text as well.

    A null text counts as empty, empty texts form one group. A row without id is counted
    but is kept only where no row of its group has an id (keep_id is then null). Repeated
    rows of one id and text are one document: each is counted and each says kept.
    Other columns of `docs` are not read. An empty table gives no rows.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", F.sha2("body", 256))
    rows = rows.withColumn("key", F.unhex(F.substring("sha", 1, hash_bits // 4)))
    size = [pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    groups = handover(rows.groupBy("key", "body").agg(*size).select("key", "keep_id", "group_size"))
    clashing = groups.groupBy("key").count().where("count > 1").select("key")
    if clashing.isEmpty():
        found = join_back(rows.select("id", "sha", "key"), groups, "key", "group_size", limit)
    else:
        plain = rows.select("id", "sha", "key").join(groups.join(clashing, "key", "left_anti"), "key")
        mixed = rows.join(clashing, "key")
        found = plain.unionByName(mixed.join(mixed.groupBy("key", "body").agg(*size), ["key", "body"]).drop("body"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.col("sha").alias("text_sha256"))


@query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op8_exact_dedup(spark, d):
    return exact_dedup(table(spark, d, "documents"), keep="largest")
