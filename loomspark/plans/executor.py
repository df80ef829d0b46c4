"""Running a graph: each model starts as soon as what it reads is there."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any

from ..model import BackendError, Kind, Materialization, Model
from ..operators.materialize import Backend, Materialized, StatementError
from ..sqlfront.refs import render_refs
from ..sqlfront.template import render
from .context import Context
from .graph import Graph


class Status(StrEnum):
    SUCCESS = "success"
    FAILED = "failed"
    SKIPPED = "skipped"
    PARTIAL = "partial"
    DISABLED = "disabled"


@dataclass
class ModelRun:
    model: Model
    status: Status
    elapsed: float = 0.0
    row_count: int | None = None
    error: str | None = None
    skipped_reason: str | None = None
    statement_errors: list[StatementError] = field(default_factory=list)


@dataclass
class Options:
    threads: int = 4
    fail_fast: bool = False
    full_refresh: bool = False
    parallelism: int | None = None
    continue_on_error: bool | None = None
    disabled: frozenset[str] = frozenset()


class Executor:
    """Statuses: a failure skips all that follow from it (upstream_failure), a disabled model likewise
    (upstream_disabled); where both apply, failure is the reason. With fail_fast nothing new starts after a failure,
    and the report still names every model."""

    def __init__(self, graph: Graph, backend: Backend, variables: dict[str, Any], options: Options, seed_rows: dict[str, int | None] | None = None, types: dict[str, dict[str, str]] | None = None, listen: Callable[[str, Model, ModelRun | None], None] | None = None):
        self.graph, self.backend, self.variables, self.options = graph, backend, variables, options
        self.seed_rows, self.types, self.listen = seed_rows or {}, types or {}, listen or (lambda *_: None)

    def run(self) -> list[ModelRun]:
        done: dict[str, ModelRun] = {}
        waiting = set(self.graph.models)
        running: dict[Any, str] = {}
        stopped = False

        def settle() -> None:
            """Models that won't run, as far as that is known."""
            changed = True
            while changed:
                changed = False
                for name in sorted(waiting):
                    m, ups = self.graph.models[name], self.graph.parents(name)
                    reason = None
                    if name in self.options.disabled or m.disabled:
                        found = ModelRun(m, Status.DISABLED)
                    elif any(u in done and (done[u].status == Status.FAILED or done[u].skipped_reason == "upstream_failure") for u in ups):
                        reason = "upstream_failure"
                    elif all(u in done for u in ups) and any(done[u].status == Status.DISABLED or done[u].skipped_reason == "upstream_disabled" for u in ups):
                        reason = "upstream_disabled"
                    elif stopped and not running:
                        reason = "fail_fast"
                    else:
                        continue
                    done[name] = ModelRun(m, Status.SKIPPED, skipped_reason=reason) if reason else found
                    waiting.discard(name)
                    changed = True

        with ThreadPoolExecutor(max_workers=max(1, self.options.threads)) as pool:
            settle()
            while waiting or running:
                if not stopped:
                    ready = sorted(n for n in waiting if all(u in done for u in self.graph.parents(n)))
                    for name in ready[: max(1, self.options.threads) - len(running)]:  # no more than can begin now
                        running[pool.submit(self._one, self.graph.models[name])] = name
                        waiting.discard(name)
                if running:
                    for f in wait(running, return_when=FIRST_COMPLETED)[0]:
                        name = running.pop(f)
                        done[name] = f.result()
                        stopped |= self.options.fail_fast and done[name].status == Status.FAILED
                settle()
        return [done[n] for n in self.graph.order()]

    def _one(self, m: Model) -> ModelRun:
        began = time.monotonic()
        self.listen("START", m, None)
        self.backend.spark.sparkContext.setLocalProperty("spark.scheduler.pool", m.name)
        try:
            made = self._materialize(m)
            status = Status.PARTIAL if made.errors else Status.SUCCESS
            error = made.errors[0].error if made.errors else None
            out = ModelRun(m, status, time.monotonic() - began, made.row_count, error, statement_errors=made.errors)
        except Exception as e:
            out = ModelRun(m, Status.FAILED, time.monotonic() - began, error=str(e))
        self.listen("FAIL" if out.status == Status.FAILED else "COMPLETE", m, out)
        return out

    def _materialize(self, m: Model) -> Materialized:
        if m.kind == Kind.SEED:
            return Materialized(self.seed_rows.get(m.name))
        if m.kind == Kind.PYTHON:
            return self.backend.materialize_frame(m, self.backend.coerce(m.function(Context(m, self.backend, self.variables))), full_refresh=self.options.full_refresh)
        sql = m.sql or ""
        if m.materialization == Materialization.INCREMENTAL and "is_incremental" in sql:  # an extension: templates may ask
            first = self.options.full_refresh or not self.backend.exists(m.name)
            sql = render(sql, self.variables, is_incremental=lambda: not first, this=self.backend.fqn(m.name))
        sql = render_refs(sql, self.backend.fqn)
        if m.materialization != Materialization.EXECUTE and not sql.strip():
            raise BackendError(f"{m.name} is empty")
        parallelism = self.options.parallelism if self.options.parallelism is not None else m.config.get("parallelism", 1)
        go_on = self.options.continue_on_error if self.options.continue_on_error is not None else bool(m.config.get("continue_on_error", False))
        types = {n: t for n, t in self.types.items() if n in m.depends_on} if m.config.get("harmonize") else None
        if types:
            types = {self.backend.fqn(n).split(".")[-1].strip("`"): t for n, t in types.items()}
        return self.backend.materialize(m, sql, full_refresh=self.options.full_refresh, parallelism=parallelism, continue_on_error=go_on, schema=types)
