"""Functions for agents and notebooks: list, compile, run, translate, explain."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from .observe.catalog import detail, manifest
from .plans.graph import Graph
from .plans.runner import Runner, RunRequest
from .project import Project
from .sqlfront.dialect import translate
from .sqlfront.refs import render_refs


def _load(path: str | Path, profile: str | None = None) -> tuple[Project, Graph]:
    project = Project.load(path, profile)
    return project, Graph(project.models)


def list_models(path: str | Path, profile: str | None = None) -> list[dict[str, Any]]:
    return manifest(*_load(path, profile))["models"]


def compile_sql(path: str | Path, name: str, profile: str | None = None) -> str:
    """A model's SQL as Spark would get it."""
    project, _ = _load(path, profile)
    schema = project.config.default_schema
    return translate(render_refs(project.model(name).sql or "", lambda n: f"`{schema}`.`{n}`"), project.config.dialect)


def run_subgraph(path: str | Path, select: list[str], spark=None, **options: Any) -> dict[str, Any]:
    from .observe.history import entry

    return entry(Runner(path, spark).run(RunRequest(select=select, **options)))


def translate_sql(sql: str, read: str = "duckdb", schema: dict[str, dict[str, str]] | None = None) -> str:
    return translate(sql, read, schema)


def explain_model(path: str | Path, name: str, profile: str | None = None) -> dict[str, Any]:
    return detail(*_load(path, profile), name)
