"""Data tests: columns' tests, several of a model in one aggregate, and custom SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Model
from ..project import CustomTest
from ..sqlfront.refs import render_refs
from .materialize import Backend


@dataclass(frozen=True)
class TestResult:
    __test__ = False
    model: str
    column: str | None
    name: str
    passed: bool
    failing_rows: int
    error: str | None = None


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def not_null(df: DataFrame, column: str) -> int:
    return df.where(col(column).isNull()).count()


def unique(df: DataFrame, column: str) -> int:
    """Values, nulls aside, that occur more than once."""
    return df.where(col(column).isNotNull()).groupBy(col(column)).count().where("count > 1").count()


def relationships(df: DataFrame, column: str, parent: DataFrame, field: str) -> int:
    """Rows, nulls aside, whose value the parent's field lacks."""
    known = parent.select(col(field).alias("__parent"))
    return df.where(col(column).isNotNull()).join(known, col(column) == F.col("__parent"), "left_anti").count()


def rejected(column: str, values: list[Any]) -> Column:
    """Not null and not among the values. A null among them is ignored: else nothing could ever fail."""
    c = col(column)
    allowed = [v for v in values if v is not None]
    if not allowed:
        return c.isNotNull()
    if any(isinstance(v, str) for v in allowed):
        c, allowed = c.cast("string"), [str(v) for v in allowed]
    return c.isNotNull() & ~c.isin(allowed)


def accepted_values(df: DataFrame, column: str, values: list[Any]) -> int:
    return df.where(rejected(column, values)).count()


def parsed(entry: Any) -> tuple[str, dict[str, Any]]:
    """A test as written in YAML: a name, or a name with parameters."""
    if isinstance(entry, str):
        return entry, {}
    name, params = next(iter(entry.items()))
    return name, dict(params or {})


class DataTests:
    def __init__(self, backend: Backend, custom: dict[str, Callable[[DataFrame, str, dict], int]] | None = None):
        self.backend, self.custom = backend, custom or {}

    def run_model(self, m: Model) -> list[TestResult]:
        """All tests of the model's columns. Those that are conditions on single rows share one aggregate."""
        wanted = [(c.name, *parsed(t)) for c in m.columns for t in c.tests]
        if not wanted:
            return []
        fused: dict[int, Column] = {}
        for i, (column, name, params) in enumerate(wanted):
            if name == "not_null":
                fused[i] = col(column).isNull()
            elif name == "accepted_values" and params.get("values") is not None:
                fused[i] = rejected(column, params["values"])
        counts: dict[int, int] = {}
        try:
            df = self.backend.table(m.name)
            row = df.agg(*(F.count_if(c).alias(str(i)) for i, c in fused.items())).first() if fused else {}
            counts = {i: row[str(i)] for i in fused}
        except AnalysisException:
            counts = {}  # one of them can't be read, say for want of a column: below, each is run alone and says what is wrong
        out = []
        for i, (column, name, params) in enumerate(wanted):
            try:
                n = counts[i] if i in counts else self._one(self.backend.table(m.name), column, name, params)
                out.append(TestResult(m.name, column, name, n == 0, n))
            except Exception as e:
                out.append(TestResult(m.name, column, name, False, -1, str(e)))
        return out

    def _one(self, df: DataFrame, column: str, name: str, params: dict[str, Any]) -> int:
        if name == "not_null":
            return not_null(df, column)
        if name == "unique":
            return unique(df, column)
        if name == "accepted_values":
            return accepted_values(df, column, params["values"])
        if name == "relationships":
            to = render_refs(str(params["to"]), self.backend.fqn)
            short = to.split(".")[-1].strip("`")
            parent = self.backend.table(short) if self.backend.exists(short) else self.backend.spark.table(to)
            return relationships(df, column, parent, params["field"])
        if name in self.custom:
            return self.custom[name](df, column, params)
        raise ValueError(f"unknown test {name!r}")

    def run_custom(self, test: CustomTest) -> TestResult:
        """A query whose rows are failures."""
        try:
            n = self.backend.sql(render_refs(test.sql.rstrip().rstrip(";"), self.backend.fqn)).count()
            return TestResult(test.name, None, test.name, n == 0, n)
        except Exception as e:
            return TestResult(test.name, None, test.name, False, -1, str(e))
