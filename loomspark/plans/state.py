"""What is remembered of incremental models between runs."""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import functions as F

from ..model import Model
from ..operators.materialize import Backend, upsert

TABLE = "_loom_state"
SCHEMA = "model_name string, last_run_at double, watermark string, row_count bigint, fingerprint string"


def fingerprint(m: Model) -> str:
    """Sixteen hex digits that change with name, materialisation, key or body."""
    body = m.sql if m.sql is not None else inspect.getsource(m.function) if m.function else ""
    text = "\x1f".join([m.name, str(m.materialization), ",".join(m.unique_key), body])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class StateStore:
    def __init__(self, backend: Backend):
        self.backend = backend

    def ensure(self) -> None:
        if not self.backend.exists(TABLE):
            self.backend.write_table(TABLE, self.backend.spark.createDataFrame([], SCHEMA))

    def get(self, name: str) -> dict | None:
        self.ensure()
        rows = self.backend.table(TABLE).where(F.col("model_name") == name).collect()
        return rows[0].asDict() if rows else None

    def put(self, name: str, last_run_at: float, watermark: str | None = None, row_count: int | None = None, mark: str | None = None) -> None:
        self.ensure()
        new = self.backend.spark.createDataFrame([(name, last_run_at, watermark, row_count, mark)], SCHEMA)
        self.backend.write_table(TABLE, upsert(self.backend.table(TABLE), new, ["model_name"]).coalesce(1))

    def all(self) -> list[dict]:
        self.ensure()
        return [r.asDict() for r in self.backend.table(TABLE).orderBy("model_name").collect()]
