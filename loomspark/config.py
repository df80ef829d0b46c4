"""Project files: environment, profiles, variables, connections."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from .model import ProjectError

FILE = "loom.yaml"
PROFILE_ENV = "LOOM_PROFILE"
_ENV = re.compile(r"\$\{(\w+)(?::-(.*?))?\}")


def load_dotenv(path: Path, environ: dict[str, str] | None = None) -> None:
    """KEY=value lines into the environment; what is set there stays."""
    env = os.environ if environ is None else environ
    if not path.is_file():
        return
    for line in path.read_text().splitlines():
        m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line)
        if m and not line.lstrip().startswith("#"):
            value = m[2]
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            env.setdefault(m[1], value)


def interpolate(value: Any, environ: Mapping[str, str] | None = None) -> Any:
    """${NAME} and ${NAME:-default} in all strings; an unset name without default is an error."""
    env = os.environ if environ is None else environ
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ProjectError(f"environment variable {m[1]} is not set and has no default")
        return m[2]

    return _ENV.sub(put, value)


@dataclass
class Connection:
    name: str
    type: str = "spark"
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class ProjectConfig:
    name: str
    version: str = "0.1.0"
    root: Path = Path(".")
    default_schema: str = "main"
    default_materialization: str = "table"
    jinja: bool = False
    dialect: str = "duckdb"
    vars: dict[str, Any] = field(default_factory=dict)
    connections: dict[str, Connection] = field(default_factory=dict)
    #: name of the connection to use, the older spelling of a default
    profile: str | None = None
    active_profile: str | None = None
    available_profiles: list[str] = field(default_factory=list)
    models_dir: str = "models"
    seeds_dir: str = "seeds"
    macros_dir: str = "macros"
    tests_dir: str = "tests"
    seed_schemas: dict[str, Any] = field(default_factory=dict)
    #: defaults by folder below the models directory
    model_defaults: dict[str, dict[str, Any]] = field(default_factory=dict)
    history: str = ".loom/runs.jsonl"
    #: where a run's lineage events go, a JSON object a line; without it they are logged
    lineage: str | None = None

    @classmethod
    def from_file(cls, path: Path, profile: str | None = None, environ: Mapping[str, str] | None = None) -> ProjectConfig:
        path = Path(path)
        if path.is_dir():
            path = path / FILE
        if not path.is_file():
            raise ProjectError(f"{path} does not exist")
        try:
            raw = yaml.safe_load(path.read_text()) or {}
        except yaml.YAMLError as e:
            raise ProjectError(f"{path}: {e}") from e
        raw = overlay(interpolate(raw, environ), profile, os.environ if environ is None else environ)
        if "name" not in raw:
            raise ProjectError(f"{path}: name is missing")
        connections = {k: Connection(k, v.get("type", "spark"), {a: b for a, b in v.items() if a != "type"}) for k, v in (raw.get("connections") or {}).items()}
        simple = {k: raw[k] for k in ("version", "default_schema", "default_materialization", "dialect", "models_dir", "seeds_dir", "macros_dir", "tests_dir", "history", "lineage") if k in raw}
        return cls(
            raw["name"],
            root=path.parent,
            jinja=bool(raw.get("jinja", False)),
            vars=dict(raw.get("vars") or {}),
            connections=connections,
            profile=raw.get("profile"),
            active_profile=raw.get("_active"),
            available_profiles=raw.get("_available", []),
            seed_schemas=seed_overrides(raw.get("seeds") or {}),
            model_defaults=raw.get("model_defaults") or {},
            **simple,
        )

    def connection(self, wanted: str | None = None) -> Connection:
        """The named one, else the one that `profile` names, else the only one; no connections at all mean plain Spark."""
        if wanted:
            if wanted not in self.connections:
                raise ProjectError(f"unknown connection {wanted!r}; known are {sorted(self.connections)}")
            return self.connections[wanted]
        if self.profile in self.connections:
            return self.connections[self.profile]
        if len(self.connections) == 1:
            return next(iter(self.connections.values()))
        if not self.connections:
            return Connection("default")
        raise ProjectError(f"several connections and none chosen: {sorted(self.connections)}")

    def resolved(self, connection: Connection) -> dict[str, Any]:
        """Its parameters with paths relative to the project made whole."""
        out = dict(connection.params)
        for k in ("path", "warehouse", "private_key_path"):
            if isinstance(out.get(k), str) and "://" not in out[k] and not Path(out[k]).is_absolute():
                out[k] = str(self.root / out[k])
        return out


def overlay(raw: dict[str, Any], wanted: str | None, environ: Mapping[str, str]) -> dict[str, Any]:
    """raw under a profile: variables merge, connections merge by name, other keys replace."""
    profiles = raw.get("profiles") or {}
    if not profiles:
        return raw
    name = wanted or environ.get(PROFILE_ENV) or (raw.get("profile") if raw.get("profile") in profiles else None)
    out = {k: v for k, v in raw.items() if k != "profiles"} | {"_available": sorted(profiles)}
    if not name:
        return out
    if name not in profiles:
        raise ProjectError(f"unknown profile {name!r}; known are {sorted(profiles)}")
    for k, v in (profiles[name] or {}).items():
        if k in ("vars", "connections"):
            out[k] = {**(raw.get(k) or {}), **(v or {})}
        else:
            out[k] = v
    return out | {"_active": name}


def seed_overrides(raw: Any) -> dict[str, dict[str, str]]:
    """{seed: {column: type}} from {seed: {columns: [{name, type or data_type}]}} or {seed: {column: type}}, or a list of named seeds."""
    items = {x["name"]: x for x in raw} if isinstance(raw, list) else raw
    out = {}
    for seed, spec in items.items():
        columns = spec.get("columns", spec) if isinstance(spec, dict) else spec
        if isinstance(columns, list):
            out[seed] = {c["name"]: c.get("data_type") or c.get("type") for c in columns if c.get("data_type") or c.get("type")}
        else:
            out[seed] = {k: (v.get("data_type") or v.get("type")) if isinstance(v, dict) else v for k, v in columns.items() if k != "name"}
    return out
