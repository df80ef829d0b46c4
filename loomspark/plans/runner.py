"""Runs and plans of a project."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..model import Kind, Materialization, Model, ProjectError
from ..observe.history import append_run
from ..observe.lineage import emitter
from ..operators.data_tests import DataTests, TestResult
from ..operators.materialize import Backend
from ..project import Project
from ..sources import seeds as seed_files
from ..sqlfront.dialect import problems
from ..sqlfront.refs import render_refs
from ..sqlfront.script import build_statement_dag, layers
from .executor import Executor, ModelRun, Options, Status
from .graph import Graph
from .state import StateStore, fingerprint


@dataclass
class RunRequest:
    select: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    connection: str | None = None
    profile: str | None = None
    threads: int = 4
    run_vars: dict[str, Any] = field(default_factory=dict)
    test: bool = False
    fail_fast: bool = False
    full_refresh: bool = False
    reuse_seeds: bool = False
    parallelism: int | None = None
    continue_on_error: bool | None = None
    disable: list[str] = field(default_factory=list)
    enable_only: list[str] = field(default_factory=list)
    history: bool = True


@dataclass
class RunReport:
    run_id: str
    project: str
    started_at: str
    elapsed: float
    models: list[ModelRun]
    tests: list[TestResult] = field(default_factory=list)

    def count(self, status: Status) -> int:
        return sum(m.status == status for m in self.models)

    @property
    def ok(self) -> bool:
        """No model failed or ran in part, and no test failed; disabled models and what they skip don't count."""
        bad = any(m.status in (Status.FAILED, Status.PARTIAL) or m.skipped_reason in ("upstream_failure", "fail_fast") for m in self.models)
        return not bad and all(t.passed for t in self.tests)


@dataclass(frozen=True)
class ScriptStats:
    statements: int
    layers: int
    widest: int
    sizes: tuple[int, ...]
    parallelism: int


@dataclass
class Plan:
    project: str
    layers: list[list[str]]
    models: dict[str, Model]
    disabled: list[str]
    skipped: list[str]
    scripts: dict[str, ScriptStats]


def script_stats(m: Model, parallelism: int | None = None) -> ScriptStats:
    sizes = tuple(map(len, layers(build_statement_dag(m.sql or ""), lambda n: n.needs)))
    return ScriptStats(sum(sizes), len(sizes), max(sizes, default=0), sizes, parallelism or m.config.get("parallelism", 1))


def switched_off(graph: Graph, request: RunRequest) -> frozenset[str]:
    """Names that this run disables. enable_only goes first; seeds stay, as what is enabled may read them."""
    unknown = {*request.disable, *request.enable_only} - graph.models.keys()
    if unknown:
        raise ProjectError(f"unknown models: {', '.join(sorted(unknown))}")
    off = {n for n, m in graph.models.items() if request.enable_only and n not in request.enable_only and m.kind != Kind.SEED}
    return frozenset(off | set(request.disable))


class Runner:
    def __init__(self, path: Path | str, spark: SparkSession | None = None, listen: Callable[[str, Model, ModelRun | None], None] | None = None):
        self.path, self.spark, self.listen = Path(path), spark, listen

    def load(self, request: RunRequest) -> tuple[Project, Graph]:
        project = Project.load(self.path, request.profile, request.run_vars)
        return project, Graph(project.models)

    def session(self, params: dict[str, Any]) -> SparkSession:
        """The caller's session, or one of the connection's settings."""
        if self.spark is None:
            builder = SparkSession.builder.appName("loomspark").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR")
            if params.get("master"):
                builder = builder.master(params["master"])
            if params.get("warehouse"):
                builder = builder.config("spark.sql.warehouse.dir", params["warehouse"])
            for k, v in (params.get("conf") or {}).items():
                builder = builder.config(k, v)
            self.spark = builder.getOrCreate()
        return self.spark

    def backend(self, project: Project, connection: str | None = None) -> Backend:
        chosen = project.config.connection(connection)
        params = project.config.resolved(chosen)
        return Backend(self.session(params), params.get("schema", project.config.default_schema), project.config.dialect)

    def plan(self, request: RunRequest) -> Plan:
        """What a run would do; nothing is opened."""
        project, graph = self.load(request)
        graph = graph.apply(request.select, request.exclude)
        off = switched_off(graph, request) | {n for n, m in graph.models.items() if m.disabled}
        skipped = sorted(set().union(*(graph.downstream(n) for n in off)) - off) if off else []
        scripts = {n: script_stats(m, request.parallelism) for n, m in graph.models.items() if m.materialization == Materialization.EXECUTE}
        return Plan(project.config.name, graph.layers(), graph.models, sorted(off), skipped, scripts)

    def problems(self, request: RunRequest) -> dict[str, list[str]]:
        """What keeps the models' SQL from being read, by model; nothing runs and no table is looked at."""
        project, graph = self.load(request)
        spark = self.session(project.config.resolved(project.config.connection(request.connection)))
        out = {}
        for n, m in graph.apply(request.select, request.exclude).models.items():
            found = problems(spark, render_refs(m.sql, lambda r: f"`{r}`"), project.config.dialect) if m.sql else []
            if found:
                out[n] = found
        return out

    def run(self, request: RunRequest, tests_only: bool = False) -> RunReport:
        began, started = time.monotonic(), dt.datetime.now(dt.UTC).isoformat()
        project, whole = self.load(request)
        graph = whole.apply(request.select, request.exclude)
        off = switched_off(graph, request)
        backend = self.backend(project, request.connection)
        runs: list[ModelRun] = []
        if not tests_only:
            wanted = [s for s in project.seeds if s.name in graph.models and s.name not in off and not graph.models[s.name].disabled]
            rows = seed_files.load(backend, wanted, request.reuse_seeds, request.threads)
            options = Options(request.threads, request.fail_fast, request.full_refresh, request.parallelism, request.continue_on_error, off)
            types = {**seed_files.schemas(backend.spark, project.seeds, project.config.root / ".loom/seed_schemas.json"), **project.declared_types()}
            self.lend(whole, graph, backend, project)
            tell = emitter(project.config)

            def listen(kind: str, m: Model, result: ModelRun | None) -> None:
                tell(kind, m, result)
                if self.listen:
                    self.listen(kind, m, result)

            runs = Executor(graph, backend, project.variables, options, rows, types, listen).run()
            store = StateStore(backend)
            incremental = [r for r in runs if r.model.materialization == Materialization.INCREMENTAL and r.status == Status.SUCCESS]
            for r in incremental:
                store.put(r.model.name, time.time(), watermark(backend, r.model), r.row_count, fingerprint(r.model))
        report = RunReport(uuid.uuid4().hex, project.config.name, started, 0.0, runs)
        if (request.test or tests_only) and report.ok:
            checks = DataTests(backend)
            for n in graph.order():
                if n not in off and not graph.models[n].disabled and (tests_only or any(r.model.name == n and r.status == Status.SUCCESS for r in runs)):
                    report.tests += checks.run_model(graph.models[n])
            report.tests += [checks.run_custom(t) for t in project.tests if set(t.depends_on) <= graph.models.keys()]
        report.elapsed = time.monotonic() - began
        if request.history and not tests_only:
            append_run(project.config.root / project.config.history, report)
        return report


    def lend(self, whole: Graph, graph: Graph, backend: Backend, project: Project) -> None:
        """Ephemeral models that aren't selected but lie above what is: they live only as long as a run, so they are made here."""
        above = set().union(*(whole.upstream(n) for n in graph.models)) - graph.models.keys()
        needed = whole.subgraph(n for n in above if whole.models[n].materialization == Materialization.EPHEMERAL and not whole.models[n].disabled)
        if needed.models:
            Executor(needed, backend, project.variables, Options(threads=1)).run()


def watermark(backend: Backend, m: Model) -> str | None:
    """The largest value of the column that config.watermark names."""
    column = m.config.get("watermark")
    if not column:
        return None
    value = backend.table(m.name).agg({column: "max"}).first()[0]
    return None if value is None else str(value)
