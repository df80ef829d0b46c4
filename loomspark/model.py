"""What a project consists of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import StrEnum
from pathlib import Path
from typing import Any


class Kind(StrEnum):
    """Kinds of models, as manifests name them."""

    SQL = "sql"
    PYTHON = "python"
    SEED = "seed"


class Materialization(StrEnum):
    """As project files name them."""

    TABLE = "table"
    VIEW = "view"
    INCREMENTAL = "incremental"
    EPHEMERAL = "ephemeral"
    EXECUTE = "execute"


class ProjectError(ValueError):
    """A project that can't be loaded or selected from."""


class BackendError(RuntimeError):
    """A model that can't be materialised."""


@dataclass
class Column:
    name: str
    description: str = ""
    tests: list[Any] = field(default_factory=list)
    data_type: str | None = None


@dataclass
class Governance:
    owner: str | None = None
    team: str | None = None
    business_unit: str | None = None
    criticality: str | None = None
    sla: dict[str, Any] = field(default_factory=dict)
    consumers: list[dict[str, Any]] = field(default_factory=list)
    pii: bool = False


@dataclass
class Model:
    # what it is called and where it comes from
    name: str
    kind: Kind
    materialization: Materialization = Materialization.TABLE
    # its body
    sql: str | None = None
    function: Callable[..., Any] | None = None
    path: Path | None = None
    depends_on: list[str] = field(default_factory=list)
    # how it is written
    config: dict[str, Any] = field(default_factory=dict)
    unique_key: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    #: clusters the rows of a written table; honoured as a sort within files
    cluster_by: list[str] = field(default_factory=list)
    disabled: bool = False
    # what is told about it
    columns: list[Column] = field(default_factory=list)
    governance: Governance = field(default_factory=Governance)
    tags: list[str] = field(default_factory=list)
    description: str = ""
    docs: str = ""
    #: for an outside scheduler
    schedule_cron: str | None = None


def as_list(value: Any) -> list[Any]:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def transform(
    name: str | None = None,
    *,
    materialization: str = "table",
    depends_on: list[str] | None = None,
    description: str | None = None,
    columns: list[dict[str, Any]] | None = None,
    tags: list[str] | None = None,
    unique_key: str | list[str] | None = None,
    schedule_cron: str | None = None,
    **config: Any,
) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Marks a function of a context as a Python model. depends_on says what it reads; an undeclared ref() is an error.

    The parameters' names are fixed values: projects are written against them.
    """

    def mark(function: Callable[..., Any]) -> Callable[..., Any]:
        function.__loom__ = Model(
            name or function.__name__,
            Kind.PYTHON,
            Materialization(materialization),
            function=function,
            depends_on=list(depends_on or []),
            description=description or (function.__doc__ or "").strip(),
            columns=[column_of(c) for c in columns or []],
            tags=list(tags or []),
            config=dict(config),
            unique_key=as_list(unique_key),
            schedule_cron=schedule_cron,
        )
        return function

    if callable(name):  # used without parentheses
        function, name = name, None
        return mark(function)
    return mark


def column_of(entry: dict[str, Any]) -> Column:
    return Column(entry["name"], entry.get("description", ""), list(entry.get("tests") or entry.get("data_tests") or []), entry.get("data_type") or entry.get("type"))
