"""A read-only JSON interface over a project."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any
from urllib.parse import parse_qs, urlsplit

from .observe import catalog, lineage
from .observe.diagnostics import run_diagnostics
from .observe.history import read_runs
from .observe.reliability import model_history, portfolio, reliability
from .plans.graph import Graph
from .project import Project

PAGE = """<!doctype html><meta charset=utf-8><title>loomspark</title><h1 id=n></h1><ul id=m></ul><script>
fetch('/api/manifest').then(r=>r.json()).then(x=>{n.textContent=x.project;for(const e of x.models){const l=document.createElement('li');l.textContent=`${e.name} (${e.kind}, ${e.materialization})`;m.append(l)}})
</script>"""


class App:
    """Routes to dictionaries; the project is loaded anew for each request."""

    def __init__(self, path: Path | str, static: Path | None = None):
        self.path, self.static = Path(path), static.resolve() if static else None
        self.routes: list[tuple[re.Pattern, Callable[..., Any]]] = [
            (re.compile(p + "$"), f)
            for p, f in (
                (r"/api/project", lambda p, g, q: {"name": p.config.name, "version": p.config.version, "models": len(p.models), "profile": p.config.active_profile, "profiles": p.config.available_profiles}),
                (r"/api/project/config", lambda p, g, q: catalog.raw_config(p)),
                (r"/api/project/readme", lambda p, g, q: catalog.readme(p)),
                (r"/api/project/git", lambda p, g, q: catalog.git(p)),
                (r"/api/manifest", lambda p, g, q: catalog.manifest(p, g)),
                (r"/api/manifest/openlineage", lambda p, g, q: lineage.export(p.config.name, g)),
                (r"/api/seeds", lambda p, g, q: catalog.seeds(p)),
                (r"/api/portfolio", lambda p, g, q: portfolio(g, self._runs(p))),
                (r"/api/reliability", lambda p, g, q: reliability(g, self._runs(p))),
                (r"/api/llm-knowledge", lambda p, g, q: catalog.knowledge(p, g)),
                (r"/api/models/(?P<name>[^/]+)", lambda p, g, q, name: catalog.detail(p, g, name)),
                (r"/api/models/(?P<name>[^/]+)/contract", lambda p, g, q, name: catalog.contract(g, self._known(g, name))),
                (r"/api/models/(?P<name>[^/]+)/docs", lambda p, g, q, name: catalog.docs(p, name)),
                (r"/api/models/(?P<name>[^/]+)/history", lambda p, g, q, name: model_history(self._runs(p), self._known(g, name), int(q.get("limit", 20)))),
                (r"/api/runs", lambda p, g, q: read_runs(p.config.root / p.config.history, int(q.get("limit", 50)))),
                (r"/api/runs/(?P<run>[^/]+)", lambda p, g, q, run: self._run(p, run)),
                (r"/api/runs/(?P<run>[^/]+)/diagnostics", lambda p, g, q, run: run_diagnostics(self._run(p, run))),
            )
        ]

    def _runs(self, p: Project) -> list[dict[str, Any]]:
        return read_runs(p.config.root / p.config.history)

    def _run(self, p: Project, run: str) -> dict[str, Any]:
        return next(r for r in self._runs(p) if r["run_id"] == run)

    def _known(self, g: Graph, name: str) -> str:
        g.models[name]
        return name

    def get(self, target: str) -> tuple[int, str, bytes]:
        """Status, content type and body."""
        url = urlsplit(target)
        if url.path == "/":
            return 200, "text/html", PAGE.encode()
        if url.path.startswith("/assets/"):
            return self._asset(url.path.removeprefix("/assets/"))
        query = {k: v[-1] for k, v in parse_qs(url.query).items()}
        for pattern, handler in self.routes:
            if m := pattern.match(url.path):
                try:
                    project = Project.load(self.path)
                    return 200, "application/json", json.dumps(handler(project, Graph(project.models), query, **m.groupdict()), default=str).encode()
                except (KeyError, StopIteration):
                    return 404, "application/json", b'{"error": "not found"}'
                except ValueError as e:
                    missing = "unknown model" in str(e)
                    return 404 if missing else 500, "application/json", json.dumps({"error": str(e)}).encode()
        return 404, "application/json", b'{"error": "not found"}'

    def _asset(self, name: str) -> tuple[int, str, bytes]:
        path = (self.static / name).resolve() if self.static else None
        if path is None or not path.is_relative_to(self.static) or not path.is_file():
            return 404, "text/plain", b"not found"
        kinds = {".js": "text/javascript", ".css": "text/css", ".html": "text/html", ".svg": "image/svg+xml"}
        return 200, kinds.get(path.suffix, "application/octet-stream"), path.read_bytes()


def server(path: Path | str, host: str = "127.0.0.1", port: int = 8765, static: Path | None = None) -> ThreadingHTTPServer:
    app = App(path, static)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, body = app.get(self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: Any) -> None:
            return None

    return ThreadingHTTPServer((host, port), Handler)
