"""Writes that carry their provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halfseen.sources.reader import SOURCES, MissingInput, exists


def write_prepared(units: DataFrame, path: str, record: dict, *, fmt: str = "parquet", mode: str = "error") -> None:
    """A unit table and, next to it, a one-row JSON record that describes it."""
    if record.get("data_source") not in SOURCES:
        raise ValueError(f"data_source must be one of {SOURCES}")
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be parquet or csv")
    writer = units.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(f"{path}/units")
    else:
        writer.option("header", True).csv(f"{path}/units")
    spark = units.sparkSession
    line = spark.createDataFrame([(json.dumps({**record, "format": fmt, "schema": units.schema.jsonValue()}, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode(mode).text(f"{path}/record")


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    if not exists(spark, f"{path}/record"):
        raise MissingInput(f"{path} has no record next to its units")
    record = json.loads(spark.read.text(f"{path}/record").collect()[0][0])
    reader = spark.read
    if record["format"] == "parquet":
        return reader.parquet(f"{path}/units"), record
    return reader.schema(StructType.fromJson(record["schema"])).option("header", True).csv(f"{path}/units"), record


def write_result(table: DataFrame, path: str, data_source: str, *, fmt: str = "json", mode: str = "error") -> None:
    """A published table; every row names where its data came from."""
    if data_source not in SOURCES:
        raise ValueError(f"data_source must be one of {SOURCES}")
    out = table.withColumn("data_source", F.lit(data_source))
    if fmt == "json":
        out.write.mode(mode).json(path)
    elif fmt == "csv":
        out.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError("fmt must be json or csv")
