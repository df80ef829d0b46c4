"""Lineage events in the OpenLineage shape: an export of the graph, and events while models run."""

from __future__ import annotations

import datetime as dt
import json
import logging
import threading
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from ..model import Model
from ..plans.graph import Graph

SCHEMA_URL = "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent"
log = logging.getLogger("loomspark.lineage")


def event(kind: str, project: str, m: Model, graph: Graph | None = None, run_id: str | None = None, **facets: Any) -> dict[str, Any]:
    fields = [{"name": c.name, "type": c.data_type or "", "description": c.description} for c in m.columns]
    inputs = sorted(graph.parents(m.name) if graph and m.name in graph.models else m.depends_on)
    output: dict[str, Any] = {"namespace": project, "name": m.name}
    if fields:
        output["facets"] = {"schema": {"fields": fields}}
    return {
        "eventType": kind,
        "eventTime": dt.datetime.now(dt.UTC).isoformat(),
        "producer": "loomspark",
        "schemaURL": SCHEMA_URL,
        "run": {"runId": run_id or str(uuid.uuid4()), "facets": facets},
        "job": {"namespace": project, "name": m.name},
        "inputs": [{"namespace": project, "name": i} for i in inputs],
        "outputs": [output],
    }


def export(project: str, graph: Graph) -> list[dict[str, Any]]:
    """A COMPLETE event for each model, in order."""
    return [event("COMPLETE", project, graph.models[n], graph) for n in graph.order()]


class Emitter:
    """Listens to an executor. Without a sink, events are logged; a sink that fails never fails the run."""

    def __init__(self, project: str, sink: Callable[[dict[str, Any]], None] | None = None):
        self.project, self.sink, self._runs = project, sink, {}

    def __call__(self, kind: str, m: Model, result: Any = None) -> None:
        run_id = self._runs.setdefault(m.name, str(uuid.uuid4()))
        facets = {}
        if result is not None and result.error:
            facets["errorMessage"] = {"message": result.error, "programmingLanguage": "SQL"}
        e = event(kind, self.project, m, None, run_id, **facets)
        if self.sink is None:
            log.info("%s", e)
            return
        try:
            self.sink(e)
        except Exception:
            log.exception("a lineage event was lost")


def to_file(path: Path) -> Callable[[dict[str, Any]], None]:
    """A sink that adds events to a file, one a line."""
    path.parent.mkdir(parents=True, exist_ok=True)
    lock = threading.Lock()

    def put(e: dict[str, Any]) -> None:
        with lock, path.open("a") as f:
            f.write(json.dumps(e, default=str) + "\n")

    return put


def emitter(config) -> Emitter:
    """What a project's runs tell of themselves: to the file that it names, else to the log."""
    return Emitter(config.name, to_file(config.root / config.lineage) if config.lineage else None)
