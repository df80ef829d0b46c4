"""Types and placeholder values of text columns, found in one aggregate over all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inferred types in order of precedence; BOOLEAN is never inferred.
PRECEDENCE = ("BIGINT", "DOUBLE", "DATE", "TIMESTAMP")
#: Placeholders that stand for a missing value, and the share from which one is reported.
SENTINELS = ("", "--empty--", "n/a", "N/A", "NA", "NULL", "null", "None", "none", "Other", "unknown")
SENTINEL_SHARE = 0.02
#: Rows that are looked at where a caller asks for a sample.
SAMPLE_ROWS = 1_000_000

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"
_WHEN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def _name(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def fits(c: Column, kind: str) -> Column:
    """Whether a text is of the type. Guards keep out what Spark's casts accept beyond other engines'."""
    t = F.trim(c)
    if kind == "BIGINT":
        return t.rlike("^-?[0-9]+$")
    if kind == "DOUBLE":
        return F.lower(t).rlike(_NUMBER)
    if kind == "DATE":
        return t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    if kind == "TIMESTAMP":
        return t.rlike(_WHEN) & t.try_cast("timestamp").isNotNull()
    raise ValueError(f"no test for {kind}")


@dataclass
class SentinelProfile:
    column: str
    non_null: int
    #: placeholder to share of the non-null rows, at or above the threshold
    shares: dict[str, float] = field(default_factory=dict)


@dataclass
class Inference:
    types: dict[str, str]
    mode: str  # full, sampled or empty
    rows: int
    failures: dict[str, dict[str, int]] = field(default_factory=dict)
    sentinels: dict[str, SentinelProfile] = field(default_factory=dict)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def native(kind: T.DataType) -> str:
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT"}
    return names.get(kind.simpleString(), kind.simpleString().upper())


def infer_types(df: DataFrame, overrides: dict[str, str] | None = None, full_scan_rows: int | None = None, sample_rows: int = SAMPLE_ROWS, sentinels: bool = False) -> Inference:
    """Types of all columns: native ones as they are, text ones by what no value contradicts, overrides before all.

    Types, failures and, if asked for, placeholder values come from one aggregate. Every row is looked at, unless full_scan_rows is given: a table of more rows is then sampled to about sample_rows, and
    failures are counts of the sample.
    """
    overrides = overrides or {}
    types = {f.name: native(f.dataType) for f in df.schema}
    text = text_columns(df)
    probe = [c for c in text if c not in overrides]
    rows, mode, failures = 0, "empty", {}
    looked = list(dict.fromkeys([*probe, *(text if sentinels else [])]))
    shares: dict[str, SentinelProfile] = {}
    if looked:
        source, mode = df, "full" if probe else "empty"
        if full_scan_rows is not None and (rows := df.count()) > full_scan_rows:
            source, mode = df.sample(min(1.0, sample_rows / rows), seed=7), "sampled"
        tests = [F.count(F.lit(1)).alias("rows")]
        tests += [F.count_if(_name(c).isNotNull() & ~F.coalesce(fits(_name(c), k), F.lit(False))).alias(f"{i}:{k}") for i, c in enumerate(looked) if c in probe for k in PRECEDENCE]
        tests += _sentinel_counts(looked, SENTINELS if sentinels else ())
        found = source.agg(*tests).first()
        rows = found["rows"] if mode != "sampled" else rows
        for i, c in enumerate(looked):
            if c in probe:
                failures[c] = {k: found[f"{i}:{k}"] for k in PRECEDENCE}
                types[c] = next((k for k in PRECEDENCE if not failures[c][k]), "VARCHAR") if found[f"{i}:n"] else "VARCHAR"
        if sentinels:
            shares = _profiles(looked, found, SENTINELS, SENTINEL_SHARE)
    types |= {c: k for c, k in overrides.items() if c in types}
    return Inference(types, mode, rows if probe else 0, failures, shares)


def _sentinel_counts(columns: list[str], candidates: tuple[str, ...]) -> list[Column]:
    counts = [F.count(_name(c)).alias(f"{i}:n") for i, c in enumerate(columns)]
    return counts + [F.count_if(_name(c) == F.lit(s)).alias(f"{i}:{j}") for i, c in enumerate(columns) for j, s in enumerate(candidates)]


def _profiles(columns: list[str], found, candidates: tuple[str, ...], threshold: float) -> dict[str, SentinelProfile]:
    out = {}
    for i, c in enumerate(columns):
        n = found[f"{i}:n"]
        shares = {s: round(found[f"{i}:{j}"] / n, 4) for j, s in enumerate(candidates) if n and found[f"{i}:{j}"] / n >= threshold}
        if shares:
            out[c] = SentinelProfile(c, n, shares)
    return out


def detect_sentinels(df: DataFrame, columns: list[str], candidates: tuple[str, ...] = SENTINELS, threshold: float = SENTINEL_SHARE) -> dict[str, SentinelProfile]:
    """Columns in which a placeholder makes up at least the threshold of the non-null rows."""
    if not columns:
        return {}
    return _profiles(columns, df.agg(*_sentinel_counts(columns, candidates)).first(), candidates, threshold)


def spark_type(kind: str) -> str:
    base = kind.upper().strip()
    return {"VARCHAR": "STRING", "TEXT": "STRING"}.get(base.partition("(")[0], base)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with casts where a column's type is to differ; others stay bare, so that filters still reach the scan."""
    out = []
    for f in df.schema:
        want = spark_type(types.get(f.name, native(f.dataType)))
        same = want == "STRING" and isinstance(f.dataType, T.StringType) or want == native(f.dataType) or want.lower() == f.dataType.simpleString()
        c = _name(f.name)
        out.append(c if same else (F.trim(c) if isinstance(f.dataType, T.StringType) else c).try_cast(want).alias(f.name))
    return df.select(*out)
