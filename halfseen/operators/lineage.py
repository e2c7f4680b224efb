"""Cutting lineage and handing tables over, in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROW_GROUP = 16 << 20      # bytes; what few tasks wrote many can read


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-shared-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: hand the table over as Parquet in the shared folder, read back by column.

    A column without a type (a bare null) has no Parquet form; such a table is checkpointed.
    With ``by`` the rows lie apart by its few values, and who asks for one reads only its rows;
    an empty string there comes back as null.
    """
    spark = df.sparkSession
    if "void" not in df.schema.simpleString():
        path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path, partitionBy=by)
        return spark.read.schema(df.schema).parquet(path).select(*df.columns)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the input has fewer splits than the cluster has cores.

    For row-wise work that costs far more than moving the row (text extraction); an
    input of many splits is left as it is, however few files it comes from.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()       # planned, not run
    return df.repartition(cores) if 0 < splits < cores else df
