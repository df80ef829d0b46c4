"""Run history: a JSON object a line."""

from __future__ import annotations

import json
from pathlib import Path
from typing import TYPE_CHECKING, Any

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

    from ..plans.runner import RunReport

#: The shape of a line, for spark.read.
SCHEMA = (
    "run_id string, project_name string, started_at string, elapsed_seconds double, ok boolean, successes int, failures int, skipped int, partial int, disabled int, "
    "models array<struct<name: string, kind: string, materialization: string, status: string, elapsed_seconds: double, error: string, row_count: bigint, skipped_reason: string, "
    "statement_errors: array<struct<index: int, error: string, layer: int>>>>, "
    "tests array<struct<model: string, column: string, name: string, passed: boolean, failing_rows: bigint>>"
)


def entry(report: RunReport) -> dict[str, Any]:
    counts = {k: sum(m.status == s for m in report.models) for k, s in (("successes", "success"), ("failures", "failed"), ("skipped", "skipped"), ("partial", "partial"), ("disabled", "disabled"))}
    models = [
        {
            "name": m.model.name,
            "kind": str(m.model.kind),
            "materialization": str(m.model.materialization),
            "status": str(m.status),
            "elapsed_seconds": round(m.elapsed, 4),
            "error": m.error,
            "row_count": m.row_count,
            "skipped_reason": m.skipped_reason,
            "statement_errors": [{"index": e.index, "error": e.error, "layer": e.layer} for e in m.statement_errors],
        }
        for m in report.models
    ]
    tests = [{"model": t.model, "column": t.column, "name": t.name, "passed": t.passed, "failing_rows": t.failing_rows} for t in report.tests]
    return {"run_id": report.run_id, "project_name": report.project, "started_at": report.started_at, "elapsed_seconds": round(report.elapsed, 4), "ok": report.ok, **counts, "models": models, "tests": tests}


def append_run(path: Path, report: RunReport) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.write(json.dumps(entry(report)) + "\n")


def read_runs(path: Path, limit: int | None = None) -> list[dict[str, Any]]:
    """Newest first; lines that can't be read are left out."""
    out = []
    for line in reversed(path.read_text().splitlines() if path.is_file() else []):
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(value)
        if limit is not None and len(out) >= limit:
            break
    return out


def runs_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
