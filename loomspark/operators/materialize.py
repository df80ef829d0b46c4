"""Writing models: staged swaps, views, keyed upserts, scripts with emulated DML."""

from __future__ import annotations

import contextlib
import json
import re
import threading
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BackendError, Materialization, Model
from ..sqlfront.dialect import translate
from ..sqlfront.scan import Token, code, scan, split_statements, text_of
from ..sqlfront.script import Node, Output, build_statement_dag, layers, parse_output


@dataclass(frozen=True)
class StatementError:
    index: int
    sql: str
    error: str
    layer: int | None = None


@dataclass
class Materialized:
    row_count: int | None = None
    errors: list[StatementError] = field(default_factory=list)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def physical_name(name: str) -> str:
    """A name that the catalog accepts; one that had to change carries a short hash."""
    plain = re.sub(r"\W", "_", name)
    return plain.lower() if plain == name else f"{plain}_{zlib.crc32(name.encode()):08x}".lower()


def same_key(left: DataFrame, right: DataFrame, key: list[str]):
    """Equality on the key; a null key equals nothing."""
    out = F.lit(True)
    for k in key:
        out = out & (left[k] == right[k])
    return out


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new replacing those of equal key, columns matched by name; rows with a null key are added."""
    kept = old.alias("o").join(new.select(*key).alias("n"), [F.col(f"o.{quoted(k)}") == F.col(f"n.{quoted(k)}") for k in key], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


class Backend:
    """Tables and views of one schema in a session that the caller owns."""

    def __init__(self, spark: SparkSession, schema: str = "main", dialect: str = "duckdb"):
        self.spark, self.schema, self.dialect = spark, schema, dialect
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self._temporary: dict[str, str] = {}
        #: primary keys that scripts declared; Spark has none
        self._keys: dict[str, list[str]] = {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(schema)}")
        self._home = spark.catalog.getDatabase(schema).locationUri

    def __enter__(self) -> Backend:
        return self

    def __exit__(self, *_: Any) -> None:
        return None  # the session is not ours to stop

    # names

    def fqn(self, name: str) -> str:
        return self._temporary.get(name) or f"{quoted(self.schema)}.{quoted(physical_name(name))}"

    def exists(self, name: str) -> bool:
        return name in self._temporary or self.spark.catalog.tableExists(f"{quoted(self.schema)}.{quoted(physical_name(name))}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.fqn(name))

    def sql(self, text: str, schema: dict[str, dict[str, str]] | None = None) -> DataFrame:
        return self.spark.sql(self.translated(text, schema))

    def use(self) -> None:
        self.spark.sql(f"USE {quoted(self.schema)}")

    def columns(self, name: str) -> dict[str, str]:
        """Types of a table's columns by name, for the rewriter; nothing for what isn't there."""
        try:
            return {f.name: f.dataType.simpleString() for f in self.table(name.split(".")[-1]).schema}
        except AnalysisException:
            return {}

    def translated(self, sql: str, schema: dict[str, dict[str, str]] | None = None) -> str:
        return translate(sql, self.dialect, schema, self.columns)

    # writing

    def write_table(self, name: str, df: DataFrame, partition_by: list[str] | None = None, cluster_by: list[str] | None = None) -> int:
        """Replaces the table by df, which may read it; the rows are counted on the way.

        The files go to a place of their own. A table of the same columns is then pointed there, in one step; another one
        is set aside under its own name until the new one has taken its place.
        """
        counted = Observation()
        df = df.observe(counted, F.count(F.lit(1)).alias("n"))
        mark = uuid.uuid4().hex[:12]
        plain, location = physical_name(name), self._new_location(name, mark)
        full = f"{quoted(self.schema)}.{quoted(plain)}"
        if cluster_by:
            df = df.sortWithinPartitions(*cluster_by)
        with self._locks[name]:
            old = self._stored(plain)
            same = old is not None and not partition_by and not old["partitions"] and old["kind"] != "VIEW" and old["columns"] == _columns(df.schema)
            writer = df.write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            try:
                if same:
                    writer.parquet(location)
                else:
                    stage = full if old is None else f"{quoted(self.schema)}.{quoted(plain[:80] + '__stage_' + mark)}"
                    writer.format("parquet").option("path", location).saveAsTable(stage)
            except Exception:
                if not same and old is not None:
                    self.spark.sql(f"DROP TABLE IF EXISTS {stage}")
                self._delete_files(location)
                raise
            self._forget(name)
            if same:
                self.spark.sql(f"ALTER TABLE {full} SET LOCATION '{location}'")
                self.spark.catalog.refreshTable(full)
            elif old is not None and old["kind"] == "VIEW":
                self.spark.sql(f"DROP VIEW IF EXISTS {full}")
                self.spark.sql(f"ALTER TABLE {stage} RENAME TO {full}")
            elif old is not None:
                aside = f"{quoted(self.schema)}.{quoted(plain[:80] + '__old_' + mark)}"
                self.spark.sql(f"ALTER TABLE {full} RENAME TO {aside}")
                self.spark.sql(f"ALTER TABLE {stage} RENAME TO {full}")
                self.spark.sql(f"DROP TABLE IF EXISTS {aside}")
        if old is not None and old["location"]:
            self._delete_files(old["location"])
        return counted.get["n"]

    def _stored(self, plain: str) -> dict[str, Any] | None:
        """What the catalog knows of a table or view: kind, columns, names of partition columns, where its files are."""
        catalog = self.spark._jsparkSession.sharedState().externalCatalog()
        if not catalog.tableExists(self.schema, plain):
            return None
        t = catalog.getTable(self.schema, plain)
        view = t.tableType().name() == "VIEW"
        return {
            "kind": t.tableType().name(),
            "columns": _columns(T.StructType.fromJson(json.loads(t.schema().json()))),
            "partitions": [x for x in t.partitionColumnNames().mkString("\n").split("\n") if x],
            "location": None if view else t.location().toString(),
        }

    def _forget(self, name: str) -> None:
        """A temporary view of this name gives way."""
        if name in self._temporary:
            self.spark.catalog.dropTempView(self._temporary.pop(name).strip("`"))

    def _new_location(self, name: str, mark: str) -> str:
        """A place of its own for each writing: nothing that is there already, known to this catalog or not, is in the way."""
        return f"{self._home.rstrip('/')}/{physical_name(name)}__{mark}"

    def _delete_files(self, location: str) -> None:
        """Removes files that this backend wrote; others aren't its to remove."""
        if not location.rstrip("/").startswith(self._home.rstrip("/") + "/"):
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path(location)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def _drop(self, name: str) -> None:
        """Drops a table or view, and files that are ours."""
        self._forget(name)
        old = self._stored(physical_name(name))
        if old is None:
            return
        full = f"{quoted(self.schema)}.{quoted(physical_name(name))}"
        self.spark.sql(f"DROP {'VIEW' if old['kind'] == 'VIEW' else 'TABLE'} IF EXISTS {full}")
        if old["location"]:
            self._delete_files(old["location"])

    def write_view(self, name: str, sql: str) -> None:
        """A persistent view, or a temporary one where it reads a temporary one."""
        full = f"{quoted(self.schema)}.{quoted(physical_name(name))}"
        with self._locks[name]:
            if not (self.spark.catalog.tableExists(full) and self.spark.catalog.getTable(full).tableType == "VIEW"):
                self._drop(name)
            try:
                self.spark.sql(f"CREATE OR REPLACE VIEW {full} AS {sql}")
            except Exception as e:
                if "INVALID_TEMP_OBJ_REFERENCE" not in str(e):
                    raise
                self.write_temporary(name, self.spark.sql(sql))

    def write_view_of(self, name: str, df: DataFrame, source: str) -> None:
        """A view over files with the casts of df; a name with dots is also registered for raw SQL."""
        columns = []
        plain = self.spark.sql(f"SELECT * FROM {source}").schema
        for f in plain:
            kind = df.schema[f.name].dataType
            c = quoted(f.name)
            text = f.dataType.simpleString() == "string"
            columns.append(c if kind == f.dataType else f"TRY_CAST({f'trim({c})' if text else c} AS {kind.simpleString().upper()}) AS {c}")
        self.write_view(name, f"SELECT {', '.join(columns)} FROM {source}")
        if physical_name(name) != name.lower():
            self.table(name).createOrReplaceTempView(quoted(name))

    def write_temporary(self, name: str, df: DataFrame) -> None:
        view = f"{physical_name(name)}__{physical_name(self.schema)}_temp"
        df.createOrReplaceTempView(view)
        self._temporary[name] = quoted(view)

    def write_incremental(self, name: str, df: DataFrame, key: list[str], full_refresh: bool = False, partition_by: list[str] | None = None) -> int:
        """Rows of df replace those of equal key. df is computed once, into files of its own, and checked there.

        A batch whose keys are all new is appended: of the table only the keys are read. Of a partitioned table
        only partitions that hold a row of the batch, or one that it replaces, are written; else all of it is.
        """
        if not key:
            raise BackendError(f"{name}: an incremental model needs a unique_key")
        location = self._new_location(f"{name}__batch", uuid.uuid4().hex[:12])
        try:
            df.write.parquet(location)
            batch = self.spark.read.schema(df.schema).parquet(location)
            real = batch.where(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in key))
            duplicate = real.groupBy(*key).count().where("count > 1").limit(1).collect()
            if duplicate:
                raise BackendError(f"{name}: the batch has rows of equal key {[duplicate[0][k] for k in key]}")
            if full_refresh or not self.exists(name):
                return self.write_table(name, batch, partition_by)
            return self._put(name, batch, real, key)
        finally:
            self._delete_files(location)

    def _put(self, name: str, batch: DataFrame, real: DataFrame, key: list[str]) -> int:
        old = self.table(name)
        stored = self._stored(physical_name(name))
        same = stored is not None and {c for c, _ in stored["columns"]} == {c.lower() for c in batch.columns}
        keys = real.select(*key)
        replaced = old.join(keys, key, "left_semi")
        full = self.fqn(name)
        total = lambda: self.table(name).count()
        if same and replaced.isEmpty():
            with self._locks[name]:
                batch.select(*old.columns).write.insertInto(full)
            self.spark.catalog.refreshTable(full)
            return total()
        parts = stored["partitions"] if stored else []
        if same and parts:
            touched = batch.select(*parts).unionByName(replaced.select(*parts)).distinct()
            location = self._new_location(f"{name}__touched", uuid.uuid4().hex[:12])
            try:
                on = [old[p].eqNullSafe(touched[p]) for p in parts]
                upsert(old.join(touched, on, "left_semi"), batch, key).select(*old.columns).write.parquet(location)
                own = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
                own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
                fresh = own.read.schema(old.schema).parquet(location)
                left = self.spark.read.schema(old.schema).parquet(location)
                gone = touched.join(left.select(*parts).distinct().alias("f"), [touched[p].eqNullSafe(F.col(f"f.{quoted(p)}")) for p in parts], "left_anti").collect()
                with self._locks[name]:
                    fresh.write.insertInto(full, overwrite=True)
                    for row in gone:  # all of whose rows moved
                        spec = ", ".join(f"{quoted(p)} = {_sql(row[p])}" for p in parts)
                        self.spark.sql(f"ALTER TABLE {full} DROP IF EXISTS PARTITION ({spec})")
                self.spark.catalog.refreshTable(full)
                return total()
            finally:
                self._delete_files(location)
        return self.write_table(name, upsert(old, batch, key), parts or None)

    # models

    def materialize(self, m: Model, sql: str, *, full_refresh: bool = False, parallelism: int = 1, continue_on_error: bool = False, schema: dict[str, dict[str, str]] | None = None) -> Materialized:
        if m.materialization == Materialization.EXECUTE:
            return self.execute(sql, parallelism, continue_on_error)
        text = self.translated(sql, schema)
        if m.materialization == Materialization.VIEW:
            self.write_view(m.name, text)
            return Materialized()
        return self.materialize_frame(m, self.spark.sql(text), full_refresh=full_refresh)

    def materialize_frame(self, m: Model, df: DataFrame, *, full_refresh: bool = False) -> Materialized:
        if m.materialization == Materialization.INCREMENTAL:
            return Materialized(self.write_incremental(m.name, df, m.unique_key, full_refresh, m.partition_by))
        if m.materialization == Materialization.EPHEMERAL:
            self.write_temporary(m.name, df)
            return Materialized()
        # a Python model's view would point at nothing once the run ends, so it is a table
        return Materialized(self.write_table(m.name, df, m.partition_by, m.cluster_by))

    def coerce(self, value: Any) -> DataFrame:
        """A Python model's result as a DataFrame: Spark, pandas or Arrow."""
        if value is None:
            raise BackendError("the model returned None")
        if isinstance(value, DataFrame):
            return value
        if type(value).__module__.startswith(("pandas", "pyarrow")):
            return self.spark.createDataFrame(value)
        if hasattr(value, "to_arrow"):
            return self.spark.createDataFrame(value.to_arrow())
        raise BackendError(f"can't use a {type(value).__name__} as a table")

    # scripts

    def execute(self, sql: str, parallelism: int = 1, continue_on_error: bool = False) -> Materialized:
        """Runs a script's statements, in order or as its graph allows; row_count is the number of statements.

        The graph keeps the order of writes to a table and of its readers before a rewrite. With continue_on_error
        failures are collected; else the first one ends the script.
        """
        if not isinstance(parallelism, int) or isinstance(parallelism, bool) or parallelism < 1:
            raise BackendError(f"parallelism has to be a whole number from 1, not {parallelism!r}")
        statements = split_statements(sql)
        if not statements:
            return Materialized(0)
        with Script(self) as script:
            return script.run(statements, parallelism, continue_on_error)


class Script(Backend):
    """A script's own session: its temporary tables and views, settings and USE are seen by its statements only."""

    def __init__(self, home: Backend):
        self.__dict__.update(home.__dict__)
        self.home = home
        self.spark = SparkSession(home.spark.sparkContext, home.spark._jsparkSession.cloneSession())
        #: what statements have changed; other sessions look at it anew
        self.changed: set[str] = set()
        #: temporary tables by lower-cased name: where their files are
        self.scratch: dict[str, str] = {}
        self.use()

    def __exit__(self, *_: Any) -> None:
        for location in self.scratch.values():
            self._delete_files(location)
        for full in self.changed:
            with contextlib.suppress(AnalysisException):  # it is gone
                self.home.spark.catalog.refreshTable(full)

    def fqn(self, name: str) -> str:
        return quoted(name) if name.lower() in self.scratch else super().fqn(name)

    def exists(self, name: str) -> bool:
        return name.lower() in self.scratch or super().exists(name)

    def write_table(self, name: str, df: DataFrame, partition_by: list[str] | None = None, cluster_by: list[str] | None = None) -> int:
        return self.write_scratch(name, df) if name.lower() in self.scratch else super().write_table(name, df, partition_by, cluster_by)

    def write_scratch(self, name: str, df: DataFrame) -> int:
        """A temporary table: files of its own and a view of this session."""
        location = self._new_location(f"{name}__temp", uuid.uuid4().hex[:12])
        df.write.parquet(location)
        self.spark.read.schema(df.schema).parquet(location).createOrReplaceTempView(quoted(name))
        old = self.scratch.get(name.lower())
        self.scratch[name.lower()] = location
        if old:
            self._delete_files(old)
        return 0

    def _drop(self, name: str) -> None:
        if name.lower() in self.scratch:
            self.spark.catalog.dropTempView(name)
            self._delete_files(self.scratch.pop(name.lower()))
        else:
            super()._drop(name)

    def run(self, statements: list[str], parallelism: int, continue_on_error: bool) -> Materialized:
        nodes = build_statement_dag(statements)
        layer = {i: k for k, part in enumerate(layers(nodes)) for i in part}
        errors: list[StatementError] = []

        def run(n: Node) -> None:
            try:
                self.statement(n.sql)
            except Exception as e:
                failure = StatementError(n.index, n.sql[:500], str(e), layer[n.index])
                if not continue_on_error:
                    raise BackendError(f"statement {n.index} (layer {failure.layer}, makes {n.output}): {e}") from e
                errors.append(failure)

        if parallelism == 1:
            for n in nodes:
                run(n)
        else:
            waiting, done, running = {n.index: set(n.after) for n in nodes}, set(), {}
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                while waiting or running:
                    for i in sorted(i for i, after in waiting.items() if after <= done):
                        running[pool.submit(run, nodes[i])] = i
                        del waiting[i]
                    finished, _ = wait(running, return_when=FIRST_COMPLETED)
                    for f in finished:
                        i = running.pop(f)
                        if (e := f.exception()) is not None:
                            for other in running:
                                other.cancel()
                            raise e
                        done.add(i)
        return Materialized(len(statements), sorted(errors, key=lambda e: e.index))

    def statement(self, sql: str) -> None:
        out = parse_output(sql)
        if out and self._short(out.name).lower() not in self.scratch:
            self.changed.add(f"{quoted(self.schema)}.{quoted(physical_name(self._short(out.name)))}")
        handler: Callable[[str, Output], None] | None = {"table": self._create, "view": self._create_view, "insert": self._insert, "update": self._update, "delete": self._delete, "merge": self._merge, "drop": self._drop_statement, "truncate": self._truncate}.get(out.kind) if out else None
        if handler:
            handler(sql, out)
        else:
            df = self.spark.sql(self.translated(sql))
            if re.match(r"(?i)\s*use\b", sql):
                self.schema = self.spark.catalog.currentDatabase()
                self._home = self.spark.catalog.getDatabase(self.schema).locationUri
            elif df.columns and not out:
                df.write.format("noop").mode("overwrite").save()  # a query runs, as it would elsewhere

    def _short(self, name: str) -> str:
        return name.split(".")[-1]

    def _create(self, sql: str, out: Output) -> None:
        name = self._short(out.name)
        if out.body is None:
            text = re.sub(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table", "CREATE TABLE", self.translated(sql))
            if out.replace:
                self._drop(name)
            whole = re.search(r"(?i),\s*primary\s+key\s*\(([^)]*)\)", text)
            single = re.search(r"(?i)[(,]\s*`?(\w+)`?\s+[^,]*?\bprimary\s+key", text)
            if whole or single:
                self._keys[name.lower()] = [c.strip(" `") for c in (whole or single)[1].split(",")]
                text = re.sub(r"(?i)\s+primary\s+key", "", text.replace(whole[0], "") if whole else text)
            if out.temporary:
                self.write_scratch(name, self.spark.createDataFrame([], text[text.index("(") + 1 : text.rindex(")")].replace("`", "")))
                return
            self.spark.sql(f"{text} USING parquet LOCATION '{self._new_location(name, uuid.uuid4().hex[:12])}'")
            return
        if not out.replace and self.exists(name):
            if out.if_not_exists:
                return
            raise BackendError(f"[TABLE_OR_VIEW_ALREADY_EXISTS] {name} already exists")
        df = self.spark.sql(self.translated(out.body))
        if out.temporary:  # a snapshot: later changes of what it reads don't show
            self.write_scratch(name, df)
        else:
            self.write_table(name, df)

    def _create_view(self, sql: str, out: Output) -> None:
        name, body = self._short(out.name), self.translated(out.body or "")
        if out.temporary:
            self.spark.sql(body).createOrReplaceTempView(quoted(name))
        elif not out.replace and self.exists(name):
            if not out.if_not_exists:
                raise BackendError(f"[TABLE_OR_VIEW_ALREADY_EXISTS] {name} already exists")
        else:
            self.write_view(name, body)

    def _insert(self, sql: str, out: Output) -> None:
        """INSERT, with the declared primary key kept: equal keys are an error, or replace, or are passed over."""
        m = re.match(r"(?is)\s*insert\s+(?:or\s+(replace|ignore)\s+)?into\s+(\S+?)\s*(?:\(([^()]*)\)\s*)?(?:by\s+name\s+)?((?:select|values|with|\().*)", sql)
        name = self._short(out.name)
        key = self._keys.get(name.lower())
        mode = (m[1] or "").lower() if m else ""
        if not m or not (mode or key or name.lower() in self.scratch):
            self.spark.sql(self.translated(sql))
            return
        if mode and not key:
            raise BackendError(f"{name} has no primary key, which INSERT OR {mode.upper()} needs")
        old = self.table(name)
        new = self.spark.sql(self.translated(m[4]))
        given = [c.strip().strip('"`') for c in m[3].split(",")] if m[3] else None
        by_name = given is None and {c.lower() for c in new.columns} == {c.lower() for c in old.columns}
        new = new if by_name else new.toDF(*(given or old.columns[: len(new.columns)]))
        have = {c.lower(): c for c in new.columns}
        new = new.select(*((F.col(quoted(have[f.name.lower()])) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema))
        location = self._new_location(f"{name}__rows", uuid.uuid4().hex[:12])
        new.withColumn("__nth", F.monotonically_increasing_id()).write.parquet(location)  # once, for check and insertion
        try:
            self._insert_rows(name, old, self.spark.read.parquet(location), key, mode)
        finally:
            self._delete_files(location)

    def _insert_rows(self, name: str, old: DataFrame, new: DataFrame, key: list[str] | None, mode: str) -> None:
        first = Window.partitionBy(*(key or ["__nth"])).orderBy("__nth")  # of rows of one key the first counts
        if key and mode == "ignore":
            new = new.withColumn("__of", F.row_number().over(first)).where("__of = 1").join(old.select(*key), key, "left_anti")
        elif key:
            if mode == "replace":
                new = new.withColumn("__of", F.row_number().over(first)).where("__of = 1")
            elif not new.groupBy(*key).count().where("count > 1").isEmpty() or not new.join(old.select(*key), key, "left_semi").isEmpty():
                raise BackendError(f"[DUPLICATE_KEY] {name}: a row violates the primary key ({', '.join(key)})")
        new = new.select(*old.columns)
        self.write_table(name, upsert(old, new, key) if mode == "replace" else old.unionByName(new))

    def _drop_statement(self, sql: str, out: Output) -> None:
        if self.exists(self._short(out.name)):
            self._drop(self._short(out.name))
        else:
            self.spark.sql(self.translated(sql))  # an error, or nothing with IF EXISTS

    def _truncate(self, sql: str, out: Output) -> None:
        name = self._short(out.name)
        self.write_table(name, self.table(name).limit(0))

    def _clauses(self, sql: str, *words: str) -> dict[str, str]:
        """The text behind each top-level keyword."""
        tokens, depth, out, now = scan(sql), 0, {}, None
        for t in tokens:
            if t.kind == "op":
                depth += (t.text == "(") - (t.text == ")")
            if not depth and t.kind == "word" and t.upper in words and t.upper not in out:
                now = t.upper
                out[now] = ""
            elif now:
                out[now] += t.text
        return {k: v.strip() for k, v in out.items()}

    def _update(self, sql: str, out: Output) -> None:
        name = self._short(out.name)
        part = self._clauses(sql, "UPDATE", "SET", "FROM", "WHERE")
        if "FROM" in part:
            raise BackendError("UPDATE ... FROM is not supported; use MERGE or a SELECT")
        target = part["UPDATE"].split()
        alias = target[-1] if len(target) > 1 else name
        changes = {k.name.lower(): v for k, v in assignments(part["SET"])}
        old = self.table(name)
        test = self.translated(part["WHERE"]) if part.get("WHERE") else "TRUE"
        columns = []
        for f in old.schema:
            c = f"{quoted(alias)}.{quoted(f.name)}"
            new = changes.get(f.name.lower())
            columns.append(f"CAST(CASE WHEN {test} THEN {self.translated(new)} ELSE {c} END AS {f.dataType.simpleString()}) AS {quoted(f.name)}" if new is not None else c)
        unknown = changes.keys() - {c.lower() for c in old.columns}
        if unknown:
            raise BackendError(f"[UNRESOLVED_COLUMN] {name} has no column {sorted(unknown)}")
        self.write_table(name, self.spark.sql(f"SELECT {', '.join(columns)} FROM {self.fqn(name)} AS {quoted(alias)}"))

    def _delete(self, sql: str, out: Output) -> None:
        name = self._short(out.name)
        test = self._clauses(sql, "WHERE").get("WHERE")
        keep = f"NOT coalesce({self.translated(test)}, FALSE)" if test else "FALSE"
        self.write_table(name, self.spark.sql(f"SELECT * FROM {self.fqn(name)} AS {quoted(name)} WHERE {keep}"))

    def _merge(self, sql: str, out: Output) -> None:
        """MERGE with UPDATE SET and INSERT branches, as a full outer join."""
        m = re.match(
            r"(?is)\s*merge\s+into\s+(?P<t>\S+)(?:\s+(?:as\s+)?(?P<ta>(?!using)\w+))?\s+using\s+(?P<s>\(.*?\)|\S+)(?:\s+(?:as\s+)?(?P<sa>(?!on\b)\w+))?\s+on\s+(?P<on>.*?)"
            r"(?:\s+when\s+matched\s+then\s+update\s+set\s+(?P<set>.*?))?(?:\s+when\s+not\s+matched\s+then\s+insert\s*(?:\((?P<cols>.*?)\)\s*values\s*\((?P<vals>.*)\)|\*))?\s*$",
            sql,
        )
        if not m:
            raise BackendError("this form of MERGE is not supported")
        name = self._short(out.name)
        ta, sa = m["ta"] or name, m["sa"] or m["s"].split(".")[-1]
        old = self.table(name)
        source = self.translated(m["s"]) if m["s"].startswith("(") else m["s"]
        columns = old.columns
        changes = {}
        if m["set"]:
            changes = {c.lower(): f"{sa}.{quoted(c)}" for c in columns} if m["set"].strip() == "*" else {k.name.lower(): v for k, v in assignments(m["set"])}
        new = {}
        if "not matched" in re.sub(r"\s+", " ", sql.lower()):
            new = dict(zip((c.strip().lower() for c in m["cols"].split(",")), (text_of(a).strip() for a in _commas(m["vals"])), strict=True)) if m["cols"] else {c.lower(): f"{sa}.{quoted(c)}" for c in columns}
        out_columns = []
        for f in old.schema:
            c = f.name.lower()
            updated, added = changes.get(c, f"{ta}.{quoted(f.name)}"), new.get(c, "NULL")
            out_columns.append(f"CAST(CASE WHEN {ta}.__t IS NULL THEN {added} WHEN {sa}.__s IS NULL THEN {ta}.{quoted(f.name)} ELSE {updated} END AS {f.dataType.simpleString()}) AS {quoted(f.name)}")
        on = self.translated(m["on"])
        if changes:
            rows = self.table(name).withColumn("__row", F.monotonically_increasing_id())
            rows.createOrReplaceTempView("__merge_target")
            many = self.spark.sql(f"SELECT {ta}.__row FROM __merge_target AS {ta} JOIN {source} AS {sa} ON {on} GROUP BY {ta}.__row HAVING count(*) > 1 LIMIT 1")
            if not many.isEmpty():
                raise BackendError(f"[MERGE_CARDINALITY_VIOLATION] {name}: several rows of the source match one of the target")
        text = (
            f"SELECT {', '.join(out_columns)} FROM (SELECT *, TRUE AS __t FROM {self.fqn(name)}) AS {ta} "
            f"FULL OUTER JOIN (SELECT *, TRUE AS __s FROM {source}) AS {sa} ON {on}"
            f"{'' if new else f' WHERE {ta}.__t IS NOT NULL'}"
        )
        self.write_table(name, self.spark.sql(text))


def _columns(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name.lower(), f.dataType.simpleString()) for f in schema]


def _sql(value: Any) -> str:
    if value is None:
        return "NULL"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _commas(text: str) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in scan(text):
        if t.kind == "op":
            depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def assignments(text: str) -> list[tuple[Token, str]]:
    """(column, expression) of a SET list."""
    out = []
    for part in _commas(text):
        at = code(part)
        eq = next((k for k, i in enumerate(at) if part[i].text == "="), None)
        if eq is None:
            raise BackendError(f"can't read SET {text_of(part).strip()}")
        out.append((part[at[eq - 1]], text_of(part[at[eq] + 1 :]).strip()))
    return out
