"""Errors sorted into buckets by Spark's error class."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any


class Bucket(StrEnum):
    """The buckets' names are part of the run diagnostics."""

    CONVERSION = "conversion"
    TYPE_MISMATCH = "type_mismatch"
    FUNCTION_SIGNATURE = "function_signature"
    IDEMPOTENCE = "idempotence"
    MISSING_OBJECT = "missing_object"
    PARSER = "parser"
    OTHER = "other"


@dataclass(frozen=True)
class Diagnosis:
    bucket: Bucket
    subcategory: str
    hint: str
    message: str
    operands: dict[str, str] = field(default_factory=dict)


#: Spark error classes: bucket, subcategory, hint, and an expression that finds operands in the message.
CLASSES: dict[str, tuple[Bucket, str, str, str | None]] = {
    "CAST_INVALID_INPUT": (Bucket.CONVERSION, "sentinel_string_to_typed", "use TRY_CAST(NULLIF(column, '{value}') AS {target})", r"The value '(?P<value>[^']*)' of the type \"\w+\" cannot be cast to \"(?P<target>[\w(), ]+)\""),
    "CANNOT_PARSE_TIMESTAMP": (Bucket.CONVERSION, "empty_string_vs_timestamp", "compare with IS NULL, or use TRY_CAST", None),
    "DATATYPE_MISMATCH": (Bucket.TYPE_MISMATCH, "comparison_type_mismatch", "cast one side with TRY_CAST", r"\(\"(?P<left>\w+)\" and \"(?P<right>\w+)\"\)"),
    "INCOMPATIBLE_COLUMN_TYPE": (Bucket.TYPE_MISMATCH, "set_operation_types", "cast the columns to one type", None),
    "UNRESOLVED_ROUTINE": (Bucket.FUNCTION_SIGNATURE, "unknown_function", "check the name of {fn}, or its spelling in Spark SQL", r"routine `?(?P<fn>\w+)`?"),
    "WRONG_NUM_ARGS": (Bucket.FUNCTION_SIGNATURE, "function_arg_count", "check the arguments of {fn}", r"The `?(?P<fn>\w+)`? requires"),
    "TABLE_OR_VIEW_ALREADY_EXISTS": (Bucket.IDEMPOTENCE, "table_already_exists", "use CREATE OR REPLACE", r"\s(?P<name>[`\w.]+) (?:because it )?already exists"),
    "TABLE_OR_VIEW_NOT_FOUND": (Bucket.MISSING_OBJECT, "table_not_found", "an earlier failure may have left {name} out, or a seed is missing", r"The table or view `?(?P<name>[^ ]+?)`? cannot be found"),
    "UNRESOLVED_COLUMN": (Bucket.MISSING_OBJECT, "column_not_found", "check the columns of what is read", r"name `(?P<name>[^ ]+)` cannot be resolved"),
    "SCHEMA_NOT_FOUND": (Bucket.MISSING_OBJECT, "schema_not_found", "create the schema first", None),
    "PARSE_SYNTAX_ERROR": (Bucket.PARSER, "syntax_error", "rewrite the construct in Spark SQL", r"at or near '?(?P<near>[^'.:]+)'?"),
    "PARSE_EMPTY_STATEMENT": (Bucket.PARSER, "syntax_error", "the statement is empty", None),
    "UNSUPPORTED_DATATYPE": (Bucket.PARSER, "unknown_type", "use a type that Spark has", None),
    "DATATYPE_MISSING_SIZE": (Bucket.PARSER, "unknown_type", "use STRING", None),
    "MERGE_CARDINALITY_VIOLATION": (Bucket.IDEMPOTENCE, "several_matches", "make the source's keys unique before MERGE", r"\] (?P<name>[\w.]+):"),
    "DUPLICATE_KEY": (Bucket.IDEMPOTENCE, "duplicate_key", "use INSERT OR REPLACE or INSERT OR IGNORE", r"\] (?P<name>[\w.]+):"),
    "DIVIDE_BY_ZERO": (Bucket.OTHER, "divide_by_zero", "guard with NULLIF or try_divide", None),
}

class _Blank(dict):
    def __missing__(self, key: str) -> str:
        return "..."


def classify_error(message: str) -> Diagnosis:
    known = re.search(r"\[([A-Z_]+)(?:\.[A-Z_]+)*\]", message)
    if known and known[1] in CLASSES:
        bucket, sub, hint, find = CLASSES[known[1]]
        m = re.search(find, message) if find else None
        operands = {k: v.strip("`") for k, v in (m.groupdict() if m else {}).items() if v is not None}
        return Diagnosis(bucket, sub, hint.format_map(_Blank(operands)), message, operands)
    return Diagnosis(Bucket.OTHER, "unclassified", "read the message", message)


def run_diagnostics(run: dict[str, Any]) -> dict[str, Any]:
    """Counts by bucket and subcategory of a history entry's errors, and each error by model."""
    found = []
    for m in run.get("models", []):
        errors = [(e["index"], e["error"]) for e in m.get("statement_errors") or []] or ([(None, m["error"])] if m.get("error") else [])
        found += [(m["name"], i, classify_error(text)) for i, text in errors]
    by_model: dict[str, list[dict[str, Any]]] = {}
    for name, i, d in found:
        by_model.setdefault(name, []).append({"index": i, "bucket": str(d.bucket), "subcategory": d.subcategory, "hint": d.hint, "operands": d.operands, "error": d.message})
    return {
        "run_id": run.get("run_id"),
        "total": len(found),
        "buckets": dict(Counter(str(d.bucket) for _, _, d in found)),
        "subcategories": dict(Counter(f"{d.bucket}/{d.subcategory}" for _, _, d in found)),
        "models": by_model,
    }
