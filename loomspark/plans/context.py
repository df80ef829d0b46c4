"""What a Python model is given."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame

from ..model import BackendError, Model
from ..operators.materialize import Backend


class Context:
    """ref() reads a declared dependency, sql() runs a query, vars() and config() give settings."""

    def __init__(self, model: Model, backend: Backend, variables: dict[str, Any]):
        self.model, self.backend, self._vars = model, backend, variables
        self.spark = backend.spark
        self.logger = logging.getLogger(f"loomspark.{model.name}")

    def ref(self, name: str) -> DataFrame:
        if name not in self.model.depends_on:
            raise BackendError(f"{self.model.name} reads {name!r}, which its depends_on doesn't list")
        return self.backend.table(name)

    def sql(self, query: str) -> DataFrame:
        return self.backend.sql(query)

    def vars(self, key: str | None = None, default: Any = None) -> Any:
        return dict(self._vars) if key is None else self._vars.get(key, default)

    def config(self, key: str | None = None, default: Any = None) -> Any:
        return dict(self.model.config) if key is None else self.model.config.get(key, default)
