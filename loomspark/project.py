"""Loading a project directory."""

from __future__ import annotations

import importlib.util
import sys
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from .config import ProjectConfig, load_dotenv
from .model import Governance, Kind, Materialization, Model, ProjectError, as_list, column_of
from .sources.seeds import Seed, discover
from .sqlfront.refs import extract_refs
from .sqlfront.template import TemplateError, load_macros, render


@dataclass(frozen=True)
class CustomTest:
    name: str
    sql: str
    depends_on: tuple[str, ...]


@dataclass
class Project:
    config: ProjectConfig
    models: list[Model] = field(default_factory=list)
    seeds: list[Seed] = field(default_factory=list)
    tests: list[CustomTest] = field(default_factory=list)
    variables: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: Path | str, profile: str | None = None, run_vars: Mapping[str, Any] | None = None) -> Project:
        path = Path(path)
        root = path.parent if path.is_file() else path
        load_dotenv(root / ".env")
        config = ProjectConfig.from_file(path, profile)
        variables = {**config.vars, **(run_vars or {})}
        out = cls(config, variables=variables)
        out.seeds = discover(root / config.seeds_dir, config.seed_schemas)
        schema = _schema_files(root / config.models_dir)
        try:
            macros = load_macros(root / config.macros_dir, variables) if config.jinja else {}
        except TemplateError as e:
            raise ProjectError(f"macros: {e}") from e

        def text(file: Path) -> str:
            sql = file.read_text()
            if not config.jinja:
                return sql
            try:
                return render(sql, variables, macros)
            except TemplateError as e:
                raise ProjectError(f"{file}: {e}") from e

        out.models = [Model(s.name, Kind.SEED, Materialization.TABLE if s.format == "csv" else Materialization.VIEW, path=s.path) for s in out.seeds]
        for m in out.models:
            _describe(m, schema.get(m.name, {}))
        models = root / config.models_dir
        for file in sorted(models.rglob("*.sql")) if models.is_dir() else []:
            out.models.append(_sql_model(file, text(file), schema.get(file.stem, {}), config, models))
        for file in sorted(models.rglob("*.py")) if models.is_dir() else []:
            if not file.name.startswith("_"):
                for m in _python_models(file):
                    _describe(m, schema.get(m.name, {}))
                    out.models.append(m)
        tests = root / config.tests_dir
        for file in sorted(tests.rglob("*.sql")) if tests.is_dir() else []:
            sql = text(file)
            out.tests.append(CustomTest(file.stem, sql, tuple(extract_refs(sql))))
        return out

    def model(self, name: str) -> Model:
        for m in self.models:
            if m.name == name:
                return m
        raise ProjectError(f"unknown model {name!r}")

    def declared_types(self) -> dict[str, dict[str, str]]:
        return {m.name: kinds for m in self.models if (kinds := {c.name: c.data_type for c in m.columns if c.data_type})}


def _schema_files(folder: Path) -> dict[str, dict[str, Any]]:
    out: dict[str, dict[str, Any]] = {}
    files = sorted({*folder.rglob("*.yml"), *folder.rglob("*.yaml")}) if folder.is_dir() else []
    for file in files:
        text = file.read_text()
        try:
            raw = yaml.safe_load(text) or {}
        except yaml.YAMLError as e:
            hint = " (it holds tabs; YAML wants spaces)" if "\t" in text else ""
            raise ProjectError(f"{file}: {e}{hint}") from e
        for entry in [*(raw.get("models") or []), *(raw.get("seeds") or [])]:
            out[entry["name"]] = {**out.get(entry["name"], {}), **entry}
    return out


def _describe(m: Model, spec: dict[str, Any]) -> None:
    m.description = spec.get("description") or m.description
    m.docs = spec.get("docs") or m.docs
    m.columns = [column_of(c) for c in spec.get("columns") or []] or m.columns
    m.tags = list(dict.fromkeys([*m.tags, *as_list(spec.get("tags"))]))
    m.config = {**m.config, **(spec.get("config") or {})}
    m.unique_key = as_list(spec.get("unique_key") or m.config.get("unique_key")) or m.unique_key
    m.partition_by = as_list(spec.get("partition_by") or m.config.get("partition_by")) or m.partition_by
    m.cluster_by = as_list(spec.get("cluster_by") or m.config.get("cluster_by")) or m.cluster_by
    m.schedule_cron = spec.get("schedule_cron") or m.schedule_cron
    m.disabled = bool(spec.get("disabled", m.disabled)) or spec.get("enabled") is False
    consumers = [{"name": c} if isinstance(c, str) else dict(c) for c in as_list(spec.get("consumers"))]
    m.governance = Governance(spec.get("owner"), spec.get("team"), spec.get("business_unit"), spec.get("criticality"), dict(spec.get("sla") or {}), consumers, bool(spec.get("pii") or "pii" in m.tags))


def _sql_model(file: Path, sql: str, spec: dict[str, Any], config: ProjectConfig, folder: Path) -> Model:
    defaults: dict[str, Any] = {}
    for part in file.relative_to(folder).parts[:-1]:
        defaults |= config.model_defaults.get(part) or {}
    wanted = spec.get("materialization") or (spec.get("config") or {}).get("materialization") or defaults.get("materialization") or config.default_materialization
    try:
        kind = Materialization(wanted)
    except ValueError as e:
        raise ProjectError(f"{file}: unknown materialization {wanted!r}") from e
    m = Model(file.stem, Kind.SQL, kind, sql, depends_on=[r for r in extract_refs(sql) if r != file.stem], path=file)
    _describe(m, {**defaults, **spec})
    m.depends_on = list(dict.fromkeys([*m.depends_on, *as_list(spec.get("depends_on"))]))
    return m


def _python_models(file: Path) -> Iterator[Model]:
    name = f"_loom_{file.stem}_{zlib.crc32(str(file.resolve()).encode()):08x}"  # stems may repeat
    spec = importlib.util.spec_from_file_location(name, file)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        raise ProjectError(f"{file}: {type(e).__name__}: {e}") from e
    seen = set()
    for value in vars(module).values():
        m = getattr(value, "__loom__", None)
        if isinstance(m, Model) and m.name not in seen and getattr(value, "__module__", name) == name:
            seen.add(m.name)
            m.path = file
            yield m
