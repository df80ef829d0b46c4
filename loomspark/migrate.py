"""Importers: a transformation's JSON configuration, and a pulled tree of tables and transformations."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from .config import FILE
from .sqlfront.script import SplitResult, split_execute_script, table_positions
from .sqlfront.scan import Token, text_of


@dataclass
class Imported:
    models: dict[str, str] = field(default_factory=dict)
    issues: list[str] = field(default_factory=list)


def _plain(name: str) -> str:
    return re.sub(r"\W+", "_", name.strip().lower()).strip("_") or "model"


def import_config(raw: dict[str, Any]) -> Imported:
    """Blocks and their codes become models named after the code, or block__code where that is taken.

    Tables of the input mapping and of earlier models become references.
    """
    out = Imported()
    parameters = raw.get("parameters", raw)
    inputs = {t["destination"]: t["source"] for t in raw.get("storage", {}).get("input", {}).get("tables", [])}
    for block in parameters.get("blocks", []):
        for item in block.get("codes", []):
            name = _plain(item.get("name", "model"))
            if name in out.models:
                name = f"{_plain(block.get('name', 'block'))}__{name}"
            script = item.get("script", [])
            sql = ";\n".join(script) if isinstance(script, list) else str(script)
            tokens, found = table_positions(sql)
            for i, table in found.items():
                if table in inputs or table in out.models:
                    tokens[i] = Token("template", "{{ ref('" + inputs.get(table, table) + "') }}")
            out.models[name] = text_of(tokens)
    if not out.models:
        out.issues.append("no code was found")
    return out


def write_import(found: Imported, folder: Path, name: str) -> None:
    (folder / "models").mkdir(parents=True, exist_ok=True)
    for model, sql in found.models.items():
        (folder / "models" / f"{model}.sql").write_text(sql + "\n")
    scripts = [m for m, sql in found.models.items() if re.search(r"(?i)\b(create|insert|update|delete)\b", sql)]
    (folder / "models" / "schema.yml").write_text(yaml.safe_dump({"models": [{"name": m, "materialization": "execute"} for m in scripts]}))
    (folder / FILE).write_text(yaml.safe_dump({"name": name, "connections": {"local": {"type": "spark"}}, "profile": "local"}))


def table_path(root: Path, table: str) -> Path:
    """Where a table in.c-bucket.name lies in the pulled tree: stage-bucket/name."""
    stage, bucket, name = table.split(".", 2)
    return root / f"{stage}-{bucket}" / name


def import_tree(tables: Path, configuration: Path, folder: Path, name: str) -> Imported:
    """A pulled tree as a project: linked seeds and one script model, with a note of what is missing."""
    raw = json.loads(configuration.read_text())
    parameters = raw.get("parameters", raw)
    statements = [s for b in parameters.get("blocks", []) for c in b.get("codes", []) for s in ([c["script"]] if isinstance(c.get("script"), str) else c.get("script", []))]
    out = Imported({"transformation": ";\n".join(statements)}, validate_tree(tables, configuration))
    inputs = [t["source"] for t in raw.get("storage", {}).get("input", {}).get("tables", [])]
    seeds = folder / "seeds"
    seeds.mkdir(parents=True, exist_ok=True)
    for t in inputs:
        at, link = table_path(tables, t), seeds / t
        if at.exists() and not link.exists():
            link.symlink_to(at.resolve(), target_is_directory=at.is_dir())
    write_import(out, folder, name)
    lines = [f"# Import of {configuration.name}", "", f"{len(statements)} statements, {len(inputs)} input tables", "", *(f"- {i}" for i in out.issues)]
    (folder / "MIGRATION.md").write_text("\n".join(lines) + "\n")
    return out


def validate_tree(tables: Path, configuration: Path) -> list[str]:
    raw = json.loads(configuration.read_text())
    return [f"{t['source']}: {table_path(tables, t['source'])} is missing" for t in raw.get("storage", {}).get("input", {}).get("tables", []) if not table_path(tables, t["source"]).exists()]


def write_split(sql: str, folder: Path, prefix: str = "") -> SplitResult:
    """Writes a script's models, what is left of it as a script that follows them, and a schema file."""
    found = split_execute_script(sql)
    folder.mkdir(parents=True, exist_ok=True)
    entries: list[dict[str, Any]] = []
    for m in found.models:
        (folder / f"{prefix}{m.name}.sql").write_text(m.body.rstrip() + "\n")
        entries.append({"name": f"{prefix}{m.name}", "materialization": m.materialization})
    if found.residual:
        after = "".join(f"SELECT 1 FROM {{{{ ref('{prefix}{d}') }}}} LIMIT 0;\n" for d in found.residual_depends_on)
        (folder / "_residual.sql").write_text(after + found.residual + "\n")
        entries.append({"name": "_residual", "materialization": "execute"})
    (folder / "schema.yml").write_text(yaml.safe_dump({"models": entries}, sort_keys=False))
    return found
