"""Typed contracts as data: what a column of a raw table may hold, compiled into one set of rules.

A contract is checked before anything is derived: missing columns first, then an empty
table, then every field and cross rule together. Raw columns may be text (as read from
CSV) or typed; blank text and NaN are empty.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halfseen.operators import validate as vd

KINDS = ("text", "date", "integer", "number", "choice", "flag")
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Field:
    """One column: its kind, bounds or allowed values, and whether it may be absent or empty."""

    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    allowed: tuple = ()
    unit: str = ""
    empty: bool = False
    optional: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r} of {self.name}")
        if self.kind == "choice" and not self.allowed:
            raise ValueError(f"{self.name} needs allowed values")

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "number", "flag") or (self.kind == "choice" and not isinstance(self.allowed[0], str))


@dataclass(frozen=True)
class Contract:
    """Fields, and cross rules: name -> SQL condition of a violation over the typed columns."""

    fields: tuple[Field, ...]
    cross: Mapping[str, str] = field(default_factory=dict)

    def missing(self, df: DataFrame) -> list[str]:
        return [f.name for f in self.fields if not f.optional and f.name not in df.columns]

    def present(self, df: DataFrame) -> list[Field]:
        return [f for f in self.fields if f.name in df.columns]


def _raw(f: Field, kind: T.DataType) -> Column:
    """The column, null where empty."""
    c = F.col(f.name)
    if isinstance(kind, T.StringType):
        return F.when(F.trim(c) != "", F.trim(c) if f.numeric else c)
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def _typed(f: Field, kind: T.DataType) -> Column:
    """The value as its kind, null where it is empty or cannot be read."""
    raw = _raw(f, kind)
    if f.numeric:
        if isinstance(kind, T.StringType):
            return F.when(raw.rlike(PLAIN_NUMBER), raw.try_cast("double"))
        return raw.cast("double")
    if f.kind == "date":
        text = F.date_format(raw, "yyyy-MM-dd") if isinstance(kind, (T.DateType, T.TimestampType)) else raw.cast("string")
        return F.when(~vd.bad_date_format(text), F.try_to_date(text, "yyyy-MM-dd"))
    return raw.cast("string")


def typed(df: DataFrame, contract: Contract) -> DataFrame:
    """The table with the contract's columns in their types; unreadable values are null."""
    final = {"integer": "bigint", "flag": "int", "number": "double", "date": "date"}
    cols = {}
    for f in contract.present(df):
        value = _typed(f, df.schema[f.name].dataType)
        to = final.get(f.kind, "double" if f.numeric else "string")
        cols[f.name] = value.try_cast(to) if to in ("bigint", "int") else value.cast(to)
    return df.withColumns(cols)


def field_rules(f: Field, raw: Column, value: Column) -> dict[str, Column]:
    """Rule -> violated, over the raw (null: empty) and the typed value of one field."""
    end = "" if f.empty else " (no missing)"
    given = raw.isNotNull()
    wrong = lambda bad: (given & F.coalesce(bad, F.lit(True))) if f.empty else F.coalesce(bad, F.lit(True))
    if f.kind == "text":
        return {} if f.empty else {f"{f.name} must be a non-empty string": ~given}
    if f.kind == "date":
        format_ = vd.bad_date_format(raw.cast("string"))
        return {f"{f.name} must be formatted YYYY-MM-DD": (given & format_) if f.empty else format_,
                f"{f.name} is not a valid calendar date": ~format_ & value.isNull()}
    if f.kind in ("choice", "flag"):
        values = list(f.allowed) or [0, 1]
        listed = value.isin([float(v) for v in values] if f.numeric else values)
        return {f"{f.name} must be one of {values}{end}": wrong(~listed)}
    low, high = F.lit(f.low), F.lit(f.high)
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    if f.kind == "integer":
        return {f"{f.name} must be an integer in [{f.low}, {f.high}]{end}": wrong((value != F.floor(value)) | outside)}
    unit = f" {f.unit}" if f.unit else ""
    unread = {f"{f.name} must be numeric{end}": wrong(value.isNull())}
    return unread | ({f"{f.name} outside [{f.low}, {f.high}]{unit}": value.isNotNull() & outside}
                     if (f.low, f.high) != (None, None) else {})


def check(df: DataFrame, contract: Contract, ident: str, examples: int = 5) -> DataFrame:
    """Rows (rule, n, first_ids) of the violated rules; none for a valid table.

    A missing column is the only finding of its table (n: columns missing), then an empty
    table; otherwise all rules are read off one projection.
    """
    ids = df.schema[ident].dataType.simpleString() if ident in df.columns else "string"
    told = lambda rule, n: df.sparkSession.createDataFrame([(rule, n, [])], f"rule string, n bigint, first_ids array<{ids}>")
    absent = contract.missing(df)
    if absent:
        return told(f"missing required columns: {absent}", len(absent))
    if df.isEmpty():
        return told("no rows", 0)
    fields = contract.present(df)
    kinds = {f.name: df.schema[f.name].dataType for f in fields}
    # raw values beside typed ones, so that cross rules name columns as they are
    rows = df.select(F.col(ident).alias("__id"), *[_raw(f, kinds[f.name]).alias(f"__raw_{f.name}") for f in fields],
                     *[_typed(f, kinds[f.name]).alias(f.name) for f in fields])
    rules: dict[str, Column] = {}
    for f in fields:
        rules |= field_rules(f, F.col(f"__raw_{f.name}"), F.col(f.name))
    rules |= {name: F.expr(bad) for name, bad in contract.cross.items()}
    return vd.violations(rows, rules, "__id", examples)


def refuse(findings: DataFrame) -> None:
    """Raises with every violated rule, its rows and first ids."""
    broken = findings.collect()                               # one row per violated rule
    if broken:
        raise ValueError("schema violation: " + "; ".join(f"{r['rule']}: {r['n']} row(s), e.g. {r['first_ids']}" for r in broken))


def require(df: DataFrame, contract: Contract, ident: str) -> DataFrame:
    """The table in its types, once it keeps the contract."""
    refuse(check(df, contract, ident))
    return typed(df, contract)


# Covariates of a screening examination, with unit and plausible range.
SCREENING_NUMBERS = {
    "bmi": ("kg/m^2", 10.0, 80.0), "sbp": ("mmHg", 50.0, 300.0), "dbp": ("mmHg", 30.0, 200.0),
    "fasting_glucose": ("mg/dL", 20.0, 1000.0), "total_cholesterol": ("mg/dL", 50.0, 1000.0), "ldl": ("mg/dL", 0.0, 800.0),
    "hdl": ("mg/dL", 5.0, 200.0), "triglycerides": ("mg/dL", 10.0, 5000.0), "creatinine": ("mg/dL", 0.1, 30.0),
    "egfr": ("mL/min/1.73m^2", 0.0, 300.0), "ast": ("IU/L", 1.0, 5000.0), "alt": ("IU/L", 1.0, 5000.0),
    "ggt": ("IU/L", 1.0, 5000.0), "haemoglobin": ("g/dL", 3.0, 25.0),
}
SCREENING_LEVELS = {"smoking_status": 3, "alcohol_freq": 5, "exercise_freq": 8}          # 0 to one below
SCREENING_FLAGS = ("fh_diabetes", "fh_hypertension", "fh_cvd", "fh_cancer")


def screening(window: int = 365) -> Contract:
    """The contract of a screening examination table; outcomes count within ``window`` days."""
    return Contract(
        (Field("subject_id", "text"), Field("exam_date", "date"), Field("centre_id", "text"),
         Field("age", "integer", 19, 110), Field("sex", "choice", allowed=("F", "M")),
         *[Field(n, "number", lo, hi, unit=u, empty=True) for n, (u, lo, hi) in SCREENING_NUMBERS.items()],
         *[Field(n, "choice", allowed=tuple(range(k)), empty=True) for n, k in SCREENING_LEVELS.items()],
         *[Field(n, "flag", empty=True) for n in SCREENING_FLAGS],
         Field("followup_test_ordered", "flag"), Field("outcome", "flag", empty=True), Field("followup_days", "integer", 0),
         Field("public_model_score", "number", empty=True, optional=True)),
        {"outcome must be recorded wherever followup_test_ordered == 1": "followup_test_ordered = 1 AND outcome IS NULL",
         f"outcome == 1 requires followup_days <= {window}": f"outcome = 1 AND followup_days > {window}"})
