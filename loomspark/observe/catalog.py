"""What a project holds, as plain dictionaries: for documents, HTTP and tools. Their keys are fixed values, which clients read."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path
from typing import Any

import yaml

from ..config import FILE
from ..operators.data_tests import parsed
from ..plans.graph import Graph
from ..project import Project


def pii_models(graph: Graph) -> set[str]:
    """Flagged models and all that follow from them."""
    flagged = {n for n, m in graph.models.items() if m.governance.pii}
    return flagged.union(*(graph.downstream(n) for n in flagged)) if flagged else set()


def manifest(project: Project, graph: Graph) -> dict[str, Any]:
    pii = pii_models(graph)
    return {
        "project": project.config.name,
        "models": [
            {
                "name": n,
                "kind": str(m.kind),
                "materialization": str(m.materialization),
                "description": m.description,
                "tags": m.tags,
                "columns": [{"name": c.name, "description": c.description, "data_type": c.data_type, "tests": [parsed(t)[0] for t in c.tests]} for c in m.columns],
                "depends_on": sorted(graph.parents(n)),
                "disabled": m.disabled,
                "pii": n in pii,
                "schedule_cron": m.schedule_cron,
            }
            for n in graph.order()
            for m in [graph.models[n]]
        ],
        "edges": [[u, n] for n in sorted(graph.models) for u in sorted(graph.parents(n))],
    }


def detail(project: Project, graph: Graph, name: str) -> dict[str, Any]:
    m = project.model(name)
    entry = next(x for x in manifest(project, graph)["models"] if x["name"] == name)
    g = m.governance
    return {
        **entry,
        "sql": m.sql,
        "path": str(m.path) if m.path else None,
        "unique_key": m.unique_key,
        "config": m.config,
        "upstream": sorted(graph.upstream(name)),
        "downstream": sorted(graph.downstream(name)),
        "owner": g.owner,
        "team": g.team,
        "business_unit": g.business_unit,
        "criticality": g.criticality,
        "sla": g.sla,
        "consumers": g.consumers,
    }


def contract(graph: Graph, name: str) -> dict[str, Any]:
    """Columns with their tests, and everything, near and far, that a change would reach."""
    m = graph.models[name]
    return {
        "model": name,
        "columns": [{"name": c.name, "data_type": c.data_type, "tests": [parsed(t)[0] for t in c.tests]} for c in m.columns],
        "direct": sorted(graph.children(name)),
        "would_break": sorted(graph.downstream(name)),
        "consumers": [x for n in [name, *sorted(graph.downstream(name))] for x in graph.models[n].governance.consumers],
    }


def docs(project: Project, name: str) -> dict[str, Any]:
    """A model's description and long text: the file that `docs` in a schema file names, else the markdown beside the model.

    A file outside of the project is not read.
    """
    m = project.model(name)
    root = project.config.root.resolve()
    places = [project.config.root / m.docs] if m.docs else []
    places += [m.path.with_suffix(".md")] if m.path else []
    found = next((p for p in places if p.is_file() and p.resolve().is_relative_to(root)), None)
    return {"model": name, "description": m.description, "source": str(found.resolve().relative_to(root)) if found else None, "markdown": found.read_text() if found else None}


def seeds(project: Project) -> list[dict[str, Any]]:
    return [{"name": s.name, "format": s.format, "path": str(s.path), "bytes": s.path.stat().st_size if s.path.is_file() else sum(f.stat().st_size for f in s.path.glob("*.parquet")), "overrides": s.overrides} for s in project.seeds]


def raw_config(project: Project) -> dict[str, Any]:
    """The project file as written: environment variables are not filled in, so no secret shows."""
    path = project.config.root / FILE
    return {"path": str(path), "config": yaml.safe_load(path.read_text())}


def readme(project: Project) -> dict[str, Any]:
    path = next((p for p in (project.config.root / n for n in ("README.md", "readme.md")) if p.is_file()), None)
    return {"markdown": path.read_text() if path else None}


def git(project: Project) -> dict[str, Any]:
    def ask(*args: str) -> str | None:
        try:
            out = subprocess.run(["git", "-C", str(project.config.root), *args], capture_output=True, text=True, timeout=5)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return out.stdout.strip() if out.returncode == 0 else None

    remote = ask("remote", "get-url", "origin")
    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(ask("status", "--porcelain")), "remote": re.sub(r"//[^/@]+@", "//", remote) if remote else None}


def knowledge(project: Project, graph: Graph) -> dict[str, Any]:
    """One text that describes the project, for a language model's context."""
    lines = [f"# {project.config.name}", ""]
    for n in graph.order():
        m = graph.models[n]
        lines.append(f"## {n} ({m.kind}, {m.materialization})")
        lines += [m.description] if m.description else []
        lines += [f"reads: {', '.join(sorted(graph.parents(n)))}"] if graph.parents(n) else []
        lines += [f"- {c.name} {c.data_type or ''}: {c.description}".rstrip(": ") for c in m.columns]
        lines += ["```sql", m.sql.strip(), "```"] if m.sql else []
        lines.append("")
    return {"project": project.config.name, "markdown": "\n".join(lines)}


def save(path: Path, value: Any) -> Path:
    import json

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, default=str))
    return path
