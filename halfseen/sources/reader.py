"""Reads that check a contract before planning and never substitute an input."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halfseen.functions.scalar import as_col
from halfseen.sources.contracts import (
    CLINICAL, DATETIMES, LAYOUTS, MEASUREMENT_ALIASES, MEASUREMENT_FILES, MULTILINE, TELLING_MEASUREMENTS,
)

SOURCES = ("real", "fixture", "synthetic")


class MissingInput(FileNotFoundError):
    """A required input does not exist; the message names path and origin."""


class ContractViolation(ValueError):
    """A table lacks required columns."""


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def find(spark: SparkSession, candidates: Sequence[str], origin: str) -> str:
    """First existing path of several accepted layouts."""
    for path in candidates:
        if exists(spark, path):
            return path
    raise MissingInput(f"{origin}: none of {list(candidates)} exists; obtain it from its publisher")


def find_any(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Those of several optional inputs that exist; at least one must."""
    got = {}
    for name, candidates in groups.items():
        hit = next((p for p in candidates if exists(spark, p)), None)
        if hit:
            got[name] = hit
    if not got:
        raise MissingInput(f"at least one of {sorted(groups)} is needed; looked in {dict(groups)}")
    return got


def raw_table(spark: SparkSession, path: str, *, multiline: bool = False, schema: str | None = None) -> DataFrame:
    """Parquet, JSON or CSV (also compressed) by the name's ending; CSV stays untyped text.

    With ``multiline`` a CSV cell may hold line breaks, which keeps a file in one task.
    ``schema`` spares JSON the pass that infers one.
    """
    name = path.rstrip("/").rpartition("/")[2].lower()
    read = spark.read if schema is None else spark.read.schema(schema)
    if name.endswith(".parquet"):
        return read.parquet(path)
    if re.search(r"\.json[l]?(\.\w+)?$", name):
        return read.json(path)
    return read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)


def checked(df: DataFrame, required: Iterable[str], name: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractViolation(f"{name} is missing columns {missing}; has {df.columns}")
    return df


def load(spark: SparkSession, path: str, name: str, required: Sequence[str], *, columns: Sequence[str] | None = None,
         datetimes: Sequence[str] = (), rows: int | None = None, multiline: bool = False) -> DataFrame:
    """Contract-checked read: column subset, optional row cap, datetimes with bad values as null."""
    df = checked(raw_table(spark, path, multiline=multiline), required, name)
    if columns is not None:
        df = df.select(*columns)
    parse = {c: F.try_to_timestamp(c) for c in datetimes
             if c in df.columns and df.schema[c].dataType.typeName() == "string"}
    if parse:
        df = df.withColumns(parse)
    return df if rows is None else df.limit(rows)


def load_table(spark: SparkSession, root: str, name: str, *, columns: Sequence[str] | None = None, rows: int | None = None,
               layouts: Mapping[str, Sequence[str]] = LAYOUTS) -> DataFrame:
    """A named table below ``root`` in either layout, against its full contract, with its timestamps read."""
    if name not in layouts:
        raise KeyError(f"unknown table {name!r}; known: {sorted(layouts)}")
    path = find(spark, [f"{root.rstrip('/')}/{p}" for p in layouts[name]], name)
    return load(spark, path, name, CLINICAL[name], columns=columns, datetimes=DATETIMES, rows=rows, multiline=name in MULTILINE)


def discover(spark: SparkSession, root: str, *, patterns: Sequence[str] = MEASUREMENT_FILES,
             aliases: Mapping[str, Sequence[str]] = MEASUREMENT_ALIASES,
             telling: Sequence[str] = TELLING_MEASUREMENTS) -> tuple[str | None, dict[str, str], list[str]]:
    """(path, measurement -> column, what was searched) of the first file below ``root`` that holds a telling measurement.

    File names come from a listing (no content is read), then headers are tried in the
    order of the patterns; a file that cannot be read is noted and passed over.
    """
    searched: list[str] = []
    for pattern in patterns:
        try:
            listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
            paths = sorted(r["path"] for r in listing.select("path").collect())     # a folder of candidate tables
        except AnalysisException:
            return None, {}, [f"{root} (not found)"]
        for path in paths:
            if not re.search(r"\.csv(\.gz)?$", path.lower()) or path in searched:
                continue
            searched.append(path)
            try:
                hit = match_columns(raw_table(spark, path).columns, aliases)
            except Exception as exc:  # noqa: BLE001  any reader's error: the file is of no use here
                searched.append(f"{path} (unreadable: {type(exc).__name__})")
                continue
            if any(m in hit for m in telling):
                return path, hit, searched
    return None, {}, searched


def load_filtered(df: DataFrame, cohort: DataFrame, key: str, *, column: str | None = None,
                  values: Sequence | None = None) -> DataFrame:
    """Rows of a huge table for cohort keys and wanted values.

    The value filter reaches the scan; the cohort side is semi-joined and left to
    Spark's own size check for broadcasting.
    """
    if column is not None and values is not None:
        df = df.filter(F.col(column).isin(*values))
    return df.join(cohort.select(key).distinct(), key, "left_semi")


def provenance(df: DataFrame, name: str, source: str) -> DataFrame:
    """One row: source, rows, columns and an order-free fingerprint of the content."""
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}")
    return df.agg(F.lit(name).alias("name"), F.lit(source).alias("source"), F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_columns"),
                  content_rows(df).alias("fingerprint"))


def file_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Digest of the first MiB of each (small) file; large tables use :func:`provenance`."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring(F.col("content"), 1, 1 << 20)
    return files.select("path", "length", F.sha2(head, 256).alias("sha256_first_mib"))


def all_real(tables: DataFrame) -> bool:
    return tables.filter(F.col("source") != "real").limit(1).count() == 0


def claim_root(root: str, source: str, fixture_marks: Sequence[str] = ("fixture",)) -> str:
    """A fixture directory may never be labelled real."""
    if source == "real" and any(m in root.lower() for m in fixture_marks):
        raise ValueError(f"{root} looks like a fixture and cannot be declared real")
    return source


def match_columns(columns: Iterable[str], aliases: Mapping[str, Sequence[str]] = MEASUREMENT_ALIASES) -> dict[str, str]:
    """Measurement -> actual column, by lower-cased alias; the first alias wins."""
    have = {c.lower().strip(): c for c in columns}
    return {m: have[hit] for m, names in aliases.items() if (hit := next((a for a in names if a in have), None))}


def measurement_tables(spark: SparkSession, paths: Sequence[str], *, aliases: Mapping[str, Sequence[str]] = MEASUREMENT_ALIASES,
                       telling: Sequence[str] = TELLING_MEASUREMENTS) -> dict[str, dict[str, str]]:
    """Candidate files with a telling measurement (headers only are read)."""
    found = {p: match_columns(raw_table(spark, p).columns, aliases) for p in paths if exists(spark, p)}
    return {p: m for p, m in found.items() if any(t in m for t in telling)}


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV in which an empty cell and the word NA stay different."""
    return (spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "")
            .option("multiLine", True).option("escape", '"').csv(path).na.fill(""))


INTERVAL_SCHEMA = ("gamma double, auroc_lo double, auroc_hi double, data_source string, model string, "
                   "by_gamma map<string, struct<auroc_lo: double, auroc_hi: double>>, "
                   "nuisances struct<scores: array<double>, p1: array<double>, e: array<double>>")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(gamma, lower, upper, top_level) rows of a published interval file, validated."""
    raw = spark.read.schema(INTERVAL_SCHEMA).option("multiLine", True).json(path)
    top = raw.filter("gamma IS NOT NULL AND auroc_lo IS NOT NULL AND auroc_hi IS NOT NULL").select(
        "gamma", F.col("auroc_lo").alias("lower"), F.col("auroc_hi").alias("upper"), F.lit(True).alias("top_level"))
    table = raw.select(F.explode("by_gamma").alias("g", "v")).select(
        F.col("g").try_cast("double").alias("gamma"), F.col("v.auroc_lo").alias("lower"),
        F.col("v.auroc_hi").alias("upper"), F.lit(False).alias("top_level"))
    rows = top.unionByName(table).filter("gamma IS NOT NULL AND lower IS NOT NULL AND upper IS NOT NULL")
    bad = rows.filter("NOT (gamma >= 1 AND 0 <= lower AND lower <= upper AND upper <= 1)").limit(1).count()
    if bad:
        raise ContractViolation(f"malformed interval in {path}")
    return rows


def choose_interval(rows: DataFrame, gamma: float | None = None) -> DataFrame:
    """The row at ``gamma``; without one the top-level row, or the only row of the table."""
    if gamma is not None:
        hit = rows.filter(F.abs(F.col("gamma") - gamma) < 1e-6).orderBy("top_level").limit(1)
    else:
        top = rows.filter("top_level")
        table = rows.filter("NOT top_level")
        if not top.limit(1).count() and table.limit(2).count() > 1:
            raise ContractViolation("several tabulated gammas and no top-level one: name the gamma")
        hit = rows.orderBy(F.col("top_level").desc()).limit(1)
    if not hit.count():
        raise MissingInput("no interval at the requested gamma")
    return hit


def read_interval_units(spark: SparkSession, path: str) -> DataFrame:
    """Published unit arrays (score, p1, e) as rows; the arrays must have equal length."""
    raw = spark.read.schema(INTERVAL_SCHEMA).option("multiLine", True).json(path).filter("nuisances IS NOT NULL")
    n = raw.select(F.size("nuisances.scores").alias("a"), F.size("nuisances.p1").alias("b"),
                   F.size("nuisances.e").alias("c"))
    if n.filter("a <> b OR a <> c OR a < 2").count():
        raise ContractViolation(f"nuisance arrays of {path} must have equal length >= 2")
    zipped = F.arrays_zip(F.col("nuisances.scores").alias("score"), F.col("nuisances.p1").alias("p1"),
                          F.col("nuisances.e").alias("e"))
    return raw.select(F.inline(zipped))


def content_rows(df: DataFrame, *columns) -> Column:
    """Order-free fingerprint of selected columns: the XOR of row hashes and, since pairs of equal rows cancel in it, their sum."""
    row = F.xxhash64(*[as_col(c) for c in columns or df.columns])
    return F.concat_ws("-", F.hex(F.bit_xor(row)), F.sum(row.cast("decimal(20,0)")).cast("string"))
