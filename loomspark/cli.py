"""Command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import migrate
from .config import FILE
from .model import BackendError, ProjectError
from .observe import catalog
from .observe.diagnostics import run_diagnostics
from .observe.history import entry
from .plans.graph import Graph
from .plans.runner import Runner, RunRequest
from .project import Project
from .sqlfront.dialect import DIALECTS, Untranslatable, translate
from .sqlfront.script import SplitError

VERSION = "0.2.0"
EXAMPLE = {
    "models/stg_users.sql": "SELECT * FROM (VALUES (1, 'Ada', DATE '2024-01-01'), (2, 'Bo', DATE '2024-02-01')) AS t(id, name, signed_up)\n",
    "models/users_by_month.sql": "SELECT date_trunc('month', signed_up) AS month, count(*) AS users FROM {{ ref('stg_users') }} GROUP BY 1\n",
    "models/schema.yml": "models:\n  - name: stg_users\n    columns:\n      - name: id\n        tests: [not_null, unique]\n",
}


def _request(a: argparse.Namespace) -> RunRequest:
    variables = dict(v.split("=", 1) for v in getattr(a, "var", None) or [])
    names = lambda k: [x for v in getattr(a, k, None) or [] for x in v.split(",") if x]
    return RunRequest(
        names("select"), names("exclude"), getattr(a, "connection", None), a.profile, getattr(a, "threads", 4), variables, getattr(a, "test", False), getattr(a, "fail_fast", False),
        getattr(a, "full_refresh", False), getattr(a, "reuse_seeds", False), getattr(a, "parallelism", None), getattr(a, "continue_on_error", None), names("disable"), names("enable_only"),
    )


def init(a: argparse.Namespace) -> int:
    root = Path(a.path)
    if (root / FILE).exists():
        print(f"{root / FILE} exists already", file=sys.stderr)
        return 1
    for folder in ("models", "seeds", "macros", "tests"):
        (root / folder).mkdir(parents=True, exist_ok=True)
    (root / FILE).write_text(f"name: {a.name or root.resolve().name}\nprofile: local\nconnections:\n  local:\n    type: spark\n    warehouse: data/warehouse\n")
    for name, text in EXAMPLE.items() if a.with_examples else ():
        (root / name).write_text(text)
    return 0


def compile_(a: argparse.Namespace) -> int:
    if a.check:
        found = Runner(a.project).problems(_request(a))
        for n, lines in found.items():
            print("\n".join(f"{n}: {x}" for x in lines))
        return 1 if found else 0
    project = Project.load(a.project, a.profile)
    graph = Graph(project.models)
    if a.dot:
        print(graph.dot())
    elif a.json:
        print(json.dumps({**catalog.manifest(project, graph), "order": graph.order()}, default=str))
    else:
        for i, layer in enumerate(graph.layers()):
            for n in layer:
                m = graph.models[n]
                print(f"{i:3}  {n:40} {m.kind:7} {m.materialization:12} {', '.join(sorted(graph.parents(n)))}")
    return 0


def _show(report, as_json: bool) -> int:
    if as_json:
        print(json.dumps(entry(report)))
    else:
        for m in report.models:
            print(f"{m.status:9} {m.model.name:40} {m.elapsed:8.2f}s {m.row_count if m.row_count is not None else '':>10} {m.skipped_reason or (m.error or '').splitlines()[0:1] or ''}")
        for t in report.tests:
            print(f"{'pass' if t.passed else 'FAIL':9} {t.model}.{t.column or ''} {t.name} {t.failing_rows if not t.passed else ''} {t.error or ''}")
        print("ok" if report.ok else "not ok")
    return 0 if report.ok else 1


def run(a: argparse.Namespace) -> int:
    runner = Runner(a.project)
    if a.dry_run:
        plan = runner.plan(_request(a))
        for i, layer in enumerate(plan.layers):
            for n in layer:
                state = "disabled" if n in plan.disabled else "skipped" if n in plan.skipped else ""
                stats = plan.scripts.get(n)
                print(f"{i:3}  {n:40} {plan.models[n].materialization:12} {state}" + (f" {stats.statements} statements, {stats.layers} layers, widest {stats.widest}" if stats else ""))
        return 0
    return _show(runner.run(_request(a)), a.json)


def test(a: argparse.Namespace) -> int:
    return _show(Runner(a.project).run(_request(a), tests_only=True), a.json)


def docs(a: argparse.Namespace) -> int:
    project = Project.load(a.project, a.profile)
    print(catalog.save(Path(a.output) / "manifest.json", catalog.manifest(project, Graph(project.models))))
    return 0


def web(a: argparse.Namespace) -> int:
    from .web import server

    s = server(a.project, a.host, a.port)
    print(f"http://{a.host}:{s.server_port}")
    s.serve_forever()
    return 0


def sql(a: argparse.Namespace) -> int:
    if a.action == "translate":
        print(translate(Path(a.file).read_text() if a.file != "-" else sys.stdin.read(), a.read, json.loads(Path(a.schema).read_text()) if a.schema else None))
    elif a.action == "sanitize":
        project = Project.load(a.project, a.profile)
        types = project.declared_types()
        for file in sorted((project.config.root / project.config.models_dir).glob("*.sql")):
            old = file.read_text()
            new = translate(old, a.read, types) + "\n"
            if new.strip() != old.strip():
                print(file)
                if not a.dry_run:
                    file.write_text(new)
    else:
        found = migrate.write_split(Path(a.file).read_text(), Path(a.output))
        print(f"{len(found.models)} models" + (", and a residual script" if found.residual else ""))
    return 0


def import_(a: argparse.Namespace) -> int:
    if a.action == "config":
        migrate.write_import(migrate.import_config(json.loads(Path(a.source).read_text())), Path(a.output), a.name)
        return 0
    issues = migrate.validate_tree(Path(a.tables), Path(a.source)) if a.validate else migrate.import_tree(Path(a.tables), Path(a.source), Path(a.output), a.name).issues
    print("\n".join(issues))
    return 1 if a.validate and issues else 0


def diagnostics(a: argparse.Namespace) -> int:
    request = _request(a)
    request.continue_on_error = True
    print(json.dumps(run_diagnostics(entry(Runner(a.project).run(request))), indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(required=True)

    def command(name: str, do, *, project: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(do=do)
        if project:
            c.add_argument("--project", default=".")
            c.add_argument("--profile")
        return c

    c = command("init", init, project=False)
    c.add_argument("path")
    c.add_argument("--name")
    c.add_argument("--with-examples", action="store_true")
    c = command("compile", compile_)
    c.add_argument("--json", action="store_true")
    c.add_argument("--dot", action="store_true")
    c.add_argument("--check", action="store_true", help="parse every model's SQL")
    for name, do in (("run", run), ("test", test), ("diagnostics", diagnostics)):
        c = command(name, do)
        c.add_argument("--select", action="append")
        c.add_argument("--exclude", action="append")
        c.add_argument("--connection")
        c.add_argument("--threads", type=int, default=4)
        c.add_argument("--var", action="append")
        c.add_argument("--json", action="store_true")
        if name != "test":
            for flag in ("test", "full-refresh", "dry-run", "reuse-seeds", "fail-fast"):
                c.add_argument(f"--{flag}", action="store_true")
            c.add_argument("--continue-on-error", action="store_true", default=None)
            c.add_argument("--parallelism", type=int)
            c.add_argument("--disable", action="append")
            c.add_argument("--enable-only", action="append")
    c = command("docs", docs)
    c.add_argument("--output", default="target")
    c = command("web", web)
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8765)
    c = command("sql", sql)
    c.add_argument("action", choices=("translate", "sanitize", "split"))
    c.add_argument("file", nargs="?", default="-")
    c.add_argument("--read", default="duckdb", choices=DIALECTS)
    c.add_argument("--schema")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--output", default="models")
    c = command("import", import_, project=False)
    c.add_argument("action", choices=("config", "tree"))
    c.add_argument("source")
    c.add_argument("--tables", default="tables")
    c.add_argument("--output", default=".")
    c.add_argument("--name", default="imported")
    c.add_argument("--validate", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.do(a)
    except (ProjectError, BackendError, SplitError, Untranslatable, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
