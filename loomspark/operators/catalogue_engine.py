"""Queries that run the engine: seeds, scripts, incremental models, state, selection, failures, history, imports."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..migrate import import_config, write_import
from ..model import BackendError, Column, Kind, Model
from ..observe import catalog, lineage
from ..observe.diagnostics import classify_error, run_diagnostics
from ..observe.history import read_runs, runs_frame
from ..observe.reliability import model_rows, nearest_rank, portfolio, summary
from ..plans.graph import Graph
from ..plans.runner import Runner, RunRequest
from ..plans.state import StateStore, fingerprint
from ..project import Project
from ..sources.inference import infer_types
from ..sources.seeds import discover, load
from ..sqlfront.dialect import problems, translate
from ..streaming.feed import upsert_stream
from . import data_tests
from .catalogue import _project, _schema, _seed, frame, table, views
from .materialize import Backend


def _ran(root: Path, spark: SparkSession, **options):
    report = Runner(root, spark).run(RunRequest(**{"history": False, **options}))
    if not report.ok:
        raise RuntimeError([(m.model.name, m.error) for m in report.models] + report.tests)
    return report


def _statuses(spark: SparkSession, report) -> DataFrame:
    return spark.createDataFrame([(m.model.name, str(m.status), m.skipped_reason) for m in report.models], "name string, status string, reason string")


# seeds


@frame("seed_csv", "SELECT n_regionkey AS region, COUNT(*) AS n, SUM(n_nationkey)::BIGINT AS total, MAX(n_name) AS last, MIN(CAST(n_nationkey AS VARCHAR)) AS code FROM nation GROUP BY n_regionkey")
def seed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _project({"models/by_region.sql": "SELECT region, COUNT(*) AS n, SUM(id) AS total, MAX(name) AS last, MIN(code) AS code FROM {{ ref('nations') }} GROUP BY region"}, "seed_csv")
    with (root / "loom.yaml").open("a") as f:
        f.write("seeds:\n  nations: {columns: [{name: code, type: VARCHAR}]}\n")
    (root / "seeds").mkdir()
    lines = [f"{r.n_nationkey},{r.n_name},{r.n_regionkey},{r.n_nationkey}" for r in table(spark, sf_dir, "nation").collect()]  # 25 rows
    (root / "seeds" / "nations.csv").write_text("id,name,region,code\n" + "\n".join(lines) + "\n")
    _ran(root, spark)
    _ran(root, spark, reuse_seeds=True)
    return spark.table(f"{_schema('seed_csv')}.by_region")


@frame(
    "seed_parquet_slices",
    """SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, MAX(CAST(ts AS DATE)) AS last, CAST(SUM(user_id) AS BIGINT) AS users FROM events GROUP BY event_type""",
)
def seed_parquet_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Path(tempfile.mkdtemp(prefix="loom-seeds-"))
    e = table(spark, sf_dir, "events")
    texts = e.select(*(F.col(c).cast("string") for c in ("event_id", "value", "user_id", "event_type")), F.col("ts").cast("date").cast("string").alias("day"))
    texts.repartition(3).write.parquet(str(root / "in" / "c-main" / "events"))
    backend = Backend(spark, _schema("slices"))
    load(backend, discover(root))
    return backend.sql("SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, MAX(day) AS last, SUM(user_id) AS users FROM " + backend.fqn("in.c-main.events") + " GROUP BY event_type")


@frame(
    "inferred_from_texts",
    """WITH t AS (SELECT CAST(ts AS VARCHAR) AS stamp, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(event_id AS VARCHAR) AS id FROM events)
SELECT 'stamp' AS name, CASE WHEN COUNT(TRY_CAST(stamp AS TIMESTAMP)) = COUNT(stamp) AND COUNT(TRY_CAST(stamp AS DOUBLE)) < COUNT(stamp) THEN 'TIMESTAMP' ELSE 'VARCHAR' END AS type FROM t
UNION ALL SELECT 'day', CASE WHEN COUNT(TRY_CAST(day AS DATE)) = COUNT(day) THEN 'DATE' ELSE 'VARCHAR' END FROM t
UNION ALL SELECT 'id', CASE WHEN COUNT(TRY_CAST(id AS BIGINT)) > 0 THEN 'DECIMAL(18,0)' END FROM t""",
)
def inferred_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    texts = spark.sql("SELECT date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS stamp, CAST(CAST(ts AS DATE) AS STRING) AS day, CAST(event_id AS STRING) AS id FROM events")
    return spark.createDataFrame(sorted(infer_types(texts, {"id": "DECIMAL(18,0)"}, sentinels=True).types.items()), "name string, type string")


# scripts


@frame(
    "scripts_with_temporary_tables",
    """SELECT 'low' AS side, c_nationkey AS k, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS total FROM customer WHERE c_acctbal < 3000 GROUP BY c_nationkey
UNION ALL SELECT 'high', c_nationkey, COUNT(*), ROUND(SUM(c_acctbal), 2) FROM customer WHERE c_acctbal >= 3000 AND c_nationkey <> 3 GROUP BY c_nationkey""",
)
def scripts_with_temporary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scripts at once, each with a table tmp of its own."""
    script = "CREATE TEMP TABLE tmp AS SELECT * FROM parquet.`{d}/customer.parquet` WHERE c_acctbal {test}; {more} CREATE OR REPLACE TABLE {name} AS SELECT '{name}' AS side, c_nationkey AS k, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS total FROM tmp GROUP BY c_nationkey"
    files = {f"models/run_{n}.sql": script.format(d=sf_dir, name=n, test=t, more=m) for n, t, m in (("low", "< 3000", ""), ("high", ">= 3000", "DELETE FROM tmp WHERE c_nationkey = 3;"))}
    files["models/schema.yml"] = "models:\n" + "".join(f"  - {{name: run_{n}, materialization: execute, config: {{parallelism: 2}}}}\n" for n in ("low", "high"))
    _ran(_project(files, "temporary"), spark, threads=2)
    schema = _schema("temporary")
    return spark.table(f"{schema}.low").unionByName(spark.table(f"{schema}.high"))


@frame("merge_conflict", "SELECT 'merge' AS statement, 'idempotence' AS bucket, COUNT(*) AS rows_left, ROUND(SUM(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'insert', 'idempotence', COUNT(*), ROUND(SUM(c_acctbal), 2) FROM customer")
def merge_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several matches, and a second row of a key, are errors that change nothing."""
    b = Backend(spark, _schema("conflict"))
    b.execute("CREATE OR REPLACE TABLE target (id BIGINT PRIMARY KEY, balance DOUBLE)")
    views(spark, sf_dir, "customer")
    b.execute("INSERT INTO target SELECT c_custkey, c_acctbal FROM customer")
    out = []
    for name, sql in (
        ("merge", "MERGE INTO target t USING (SELECT c_custkey % 10 AS id, 0.0 AS balance FROM customer) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET balance = s.balance"),
        ("insert", "INSERT INTO target SELECT c_custkey, 0 FROM customer WHERE c_custkey < 5"),
    ):
        try:
            b.execute(sql)
        except BackendError as e:
            left = b.table("target").agg(F.count(F.lit(1)), F.round(F.sum("balance"), 2)).first()
            out.append((name, str(classify_error(str(e)).bucket), *left))
    return spark.createDataFrame(out, "statement string, bucket string, rows_left long, total double")


@frame(
    "keyed_inserts",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'replaced' ELSE 'old' END AS state FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'added' FROM customer WHERE c_custkey % 2 = 1""",
)
def keyed_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT OR REPLACE and INSERT OR IGNORE, of a batch that repeats its keys."""
    b = Backend(spark, _schema("keyed"))
    views(spark, sf_dir, "customer")
    b.execute(
        """CREATE OR REPLACE TABLE t (id BIGINT PRIMARY KEY, state VARCHAR);
INSERT INTO t SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 2 = 0;
INSERT OR REPLACE INTO t SELECT c_custkey, 'replaced' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'replaced' FROM customer WHERE c_custkey % 8 = 0;
INSERT OR IGNORE INTO t SELECT c_custkey, 'added' FROM customer UNION ALL SELECT c_custkey, 'added' FROM customer"""
    )
    return b.table("t")


@frame("script_that_goes_on", "SELECT 1 AS index, 'conversion' AS bucket, (SELECT COUNT(*) FROM region WHERE r_regionkey > 1) AS n UNION ALL SELECT 3, 'missing_object', (SELECT COUNT(*) FROM region WHERE r_regionkey > 1)")
def script_that_goes_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Backend(spark, _schema("goes_on"))
    got = b.execute(f"CREATE OR REPLACE TABLE a AS {_seed(sf_dir, 'region')}; CREATE OR REPLACE TABLE b AS SELECT CAST(r_name AS INT) AS x FROM a; DELETE FROM a WHERE r_regionkey <= 1; CREATE OR REPLACE TABLE c AS SELECT * FROM never_there", 2, True)
    n = b.table("a").count()
    return spark.createDataFrame([(e.index, str(classify_error(e.error).bucket), n) for e in got.errors], "index int, bucket string, n long")


@frame("statement_graph", "SELECT * FROM (VALUES (0, 0, 'a'), (1, 1, 'l'), (2, 1, 'r'), (3, 2, 'j'), (4, 3, NULL)) AS t(statement, layer, makes)")
def statement_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sqlfront.script import build_statement_dag, layers

    nodes = build_statement_dag("CREATE TABLE a AS SELECT 1 AS x; CREATE TABLE l AS SELECT x FROM a; CREATE TABLE r AS SELECT x + 1 AS x FROM a; CREATE TABLE j AS SELECT l.x FROM l JOIN r ON l.x = r.x; DELETE FROM j WHERE x = 1")
    at = {i: k for k, part in enumerate(layers(nodes)) for i in part}
    return spark.createDataFrame([(n.index, at[n.index], n.output) for n in nodes], "statement int, layer int, makes string")


@frame("unreadable_sql", "SELECT * FROM (VALUES (0, FALSE), (1, TRUE), (2, TRUE), (3, FALSE)) AS t(statement, unreadable)")
def unreadable_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["SELECT a::INT FROM t QUALIFY row_number() OVER (ORDER BY a) = 1", "SELECT (1 FROM t", "SELECT regexp_replace(a, b, c) FROM t", "SELECT string_agg(a, ',' ORDER BY b) FROM t"]
    return spark.createDataFrame([(i, bool(problems(spark, t))) for i, t in enumerate(texts)], "statement int, unreadable boolean")


@frame(
    "repaired_through_ctes",
    """WITH t AS (SELECT event_id, CAST(value AS VARCHAR) AS v, ts FROM events)
SELECT event_id % 5 AS k, ROUND(SUM(TRY_CAST(v AS DOUBLE)), 4) AS total, COUNT(*) AS n FROM t WHERE TRY_CAST(v AS DOUBLE) > 10 GROUP BY 1""",
)
def repaired_through_ctes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    spark.sql("SELECT event_id, CAST(value AS STRING) AS v, ts FROM events").createOrReplaceTempView("texts_of_events")
    types = {"texts_of_events": {"event_id": "BIGINT", "v": "VARCHAR", "ts": "TIMESTAMP"}}
    return spark.sql(translate("WITH a AS (SELECT event_id, v AS w FROM texts_of_events), b AS (SELECT * FROM a) SELECT event_id % 5 AS k, ROUND(SUM(b.w), 4) AS total, COUNT(*) AS n FROM b WHERE b.w > 10.0 GROUP BY 1", "duckdb", types))


# incremental models and state


@frame(
    "incremental_partitions",
    """WITH b AS (SELECT event_id, event_type, value, 1 AS batch FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, CASE WHEN event_id % 8 = 1 THEN 'moved' ELSE event_type END, value, 2 FROM events WHERE event_type = 'click' AND event_id % 2 = 1),
l AS (SELECT event_id, event_type, value, batch FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY batch DESC) = 1)
SELECT event_type, batch, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM l GROUP BY event_type, batch""",
)
def incremental_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch replaces rows in one partition of many, and moves some to a new one."""
    e = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    b = Backend(spark, _schema("partitions"))
    b.write_incremental("p", e.where("event_id % 4 <> 0").withColumn("batch", F.lit(1)).select("event_id", "value", "batch", "event_type"), ["event_id"], full_refresh=True, partition_by=["event_type"])
    second = e.where("event_type = 'click' AND event_id % 2 = 1").withColumn("event_type", F.expr("CASE WHEN event_id % 8 = 1 THEN 'moved' ELSE event_type END"))
    b.write_incremental("p", second.withColumn("batch", F.lit(2)).select("event_id", "value", "batch", "event_type"), ["event_id"], partition_by=["event_type"])
    return b.table("p").groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@frame("incremental_append", "SELECT event_id % 3 AS batch, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of new keys only."""
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") % 3).alias("batch"))
    b = Backend(spark, _schema("appended"))
    for k in range(3):
        b.write_incremental("a", e.where(f"batch = {k}"), ["event_id"], full_refresh=k == 0)
    return b.table("a").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@frame("state_of_models", "SELECT 'latest' AS model_name, COUNT(*) AS row_count, CAST(MAX(o_orderkey) AS VARCHAR) AS watermark, TRUE AS marked, TRUE AS changes FROM orders WHERE o_orderkey % 3 <> 2")
def state_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {
        "models/latest.sql": "SELECT o_orderkey AS k, o_totalprice AS v FROM (" + _seed(sf_dir, "orders") + ") AS o WHERE o_orderkey % 3 = {{ var('part') }}",
        "models/schema.yml": "models: [{name: latest, materialization: incremental, unique_key: k, config: {watermark: k}}]\n",
    }
    root = _project(files, "state")
    _ran(root, spark, run_vars={"part": 0}, full_refresh=True)
    _ran(root, spark, run_vars={"part": 1})
    rows = StateStore(Backend(spark, _schema("state"))).all()
    a, b = (Model("m", Kind.SQL, sql=s) for s in ("SELECT 1", "SELECT 2"))
    return spark.createDataFrame([(r["model_name"], r["row_count"], r["watermark"], len(r["fingerprint"]) == 16, fingerprint(a) != fingerprint(b)) for r in rows], "model_name string, row_count long, watermark string, marked boolean, changes boolean")


@frame("stream_upserts", "SELECT user_id, MAX(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the events comes first; what comes late and is older changes nothing."""
    root = tempfile.mkdtemp(prefix="loom-stream-")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    b = Backend(spark, _schema("upserts"))
    b._drop("s")
    middle = e.agg(F.max("event_id")).first()[0] // 2
    for part in (f"event_id > {middle}", f"event_id <= {middle}"):
        e.where(part).write.mode("append").parquet(f"{root}/in")
        upsert_stream(spark.readStream.schema(e.schema).parquet(f"{root}/in"), b, "s", ["user_id"], "event_id", f"{root}/cp").awaitTermination()
    return b.table("s")


# selection, failures, switches

CHAIN = {
    "models/a.sql": "SELECT 1 AS x",
    "models/b.sql": "SELECT CAST('oops' AS INT) AS y, x FROM {{ ref('a') }}",
    "models/c.sql": "SELECT * FROM {{ ref('b') }}",
    "models/d.sql": "SELECT * FROM {{ ref('a') }}",
    "models/schema.yml": "models: [{name: d, tags: [mart], owner: ann, criticality: tier-1, pii: true}, {name: c, tags: [mart]}, {name: a, consumers: [board], docs: docs/a.md, columns: [{name: x, data_type: INTEGER, tests: [not_null]}]}]\n",
    "docs/a.md": "# a\n",
}


@frame("failed_and_skipped", "SELECT * FROM (VALUES ('a', 'success', NULL), ('b', 'failed', NULL), ('c', 'skipped', 'upstream_failure'), ('d', 'success', NULL)) AS t(name, status, reason)")
def failed_and_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, Runner(_project(CHAIN, "failing"), spark).run(RunRequest(history=False)))


@frame("disabled_and_skipped", "SELECT * FROM (VALUES ('a', 'success', NULL), ('b', 'disabled', NULL), ('c', 'skipped', 'upstream_disabled'), ('d', 'success', NULL)) AS t(name, status, reason)")
def disabled_and_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, Runner(_project(CHAIN, "disabling"), spark).run(RunRequest(history=False, disable=["b"])))


@frame("stopped_at_failure", "SELECT * FROM (VALUES ('a', 'success', NULL), ('b', 'failed', NULL), ('c', 'skipped', 'upstream_failure'), ('d', 'skipped', 'fail_fast')) AS t(name, status, reason)")
def stopped_at_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, Runner(_project(CHAIN, "stopping"), spark).run(RunRequest(history=False, fail_fast=True, threads=1)))


@frame("selected_models", "SELECT * FROM (VALUES ('+c', 'a,b,c'), ('b+', 'b,c'), ('tag:mart', 'c,d'), ('+tag:mart', 'a,b,c,d'), ('a', 'a'), ('+b+', 'a,b,c'), ('a -tag:mart', 'a')) AS t(selector, names)")
def selected_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(Project.load(_project(CHAIN, "selecting")).models)
    rows = [(s, ",".join(sorted(graph.select([s])))) for s in ("+c", "b+", "tag:mart", "+tag:mart", "a", "+b+")]
    rows.append(("a -tag:mart", ",".join(sorted(graph.apply(["a", "tag:mart"], ["tag:mart"]).models))))
    return spark.createDataFrame(rows, "selector string, names string")


@frame("planned_layers", "SELECT * FROM (VALUES ('a', 0, 'run', '', 'c,d'), ('b', 1, 'disabled', 'a', 'c'), ('c', 2, 'skipped', 'a,b', ''), ('d', 1, 'run', 'a', '')) AS t(name, layer, state, upstream, beyond)")
def planned_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _project(CHAIN, "planning")
    plan, graph = Runner(root).plan(RunRequest(disable=["b"])), Graph(Project.load(root).models)
    at = {n: i for i, layer in enumerate(plan.layers) for n in layer}
    state = lambda n: "disabled" if n in plan.disabled else "skipped" if n in plan.skipped else "run"
    return spark.createDataFrame([(n, at[n], state(n), ",".join(sorted(graph.upstream(n))), ",".join(sorted(graph.downstream(n) - {"b"}))) for n in graph.order()], "name string, layer int, state string, upstream string, beyond string")


@frame("catalogue_of_models", "SELECT * FROM (VALUES ('a', FALSE, 'b,c,d', 'x:INTEGER:not_null', 'docs/a.md', 1), ('b', FALSE, 'c', '', NULL, 1), ('c', FALSE, '', '', NULL, 1), ('d', TRUE, '', '', NULL, 1)) AS t(name, pii, would_break, columns, docs, events)")
def catalogue_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = Project.load(_project(CHAIN, "catalogued"))
    graph = Graph(project.models)
    pii, events = catalog.pii_models(graph), lineage.export("p", graph)
    rows = []
    for n in graph.order():
        c = catalog.contract(graph, n)
        columns = ";".join(f"{x['name']}:{x['data_type']}:{','.join(x['tests'])}" for x in c["columns"])
        rows.append((n, n in pii, ",".join(c["would_break"]), columns, catalog.docs(project, n)["source"], sum(e["job"]["name"] == n for e in events)))
    return spark.createDataFrame(rows, "name string, pii boolean, would_break string, columns string, docs string, events int")


@frame("lineage_of_a_run", "SELECT * FROM (VALUES ('a', 'COMPLETE'), ('a', 'START'), ('b', 'FAIL'), ('b', 'START'), ('d', 'COMPLETE'), ('d', 'START')) AS t(name, event)")
def lineage_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _project(CHAIN, "traced")
    with (root / "loom.yaml").open("a") as f:
        f.write("lineage: .loom/lineage.jsonl\n")
    Runner(root, spark).run(RunRequest(history=False))
    events = [json.loads(x) for x in (root / ".loom/lineage.jsonl").read_text().splitlines()]
    return spark.createDataFrame([(e["job"]["name"], e["eventType"]) for e in events], "name string, event string")


@frame("errors_of_a_run", "SELECT 'conversion' AS bucket, 'b' AS model, CAST(1 AS BIGINT) AS n, 'sentinel_string_to_typed' AS subcategory")
def errors_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _project(CHAIN, "diagnosed")
    Runner(root, spark).run(RunRequest())
    found = run_diagnostics(read_runs(root / ".loom/runs.jsonl")[0])
    return spark.createDataFrame([(e["bucket"], m, 1, e["subcategory"]) for m, errors in found["models"].items() for e in errors], "bucket string, model string, n long, subcategory string")


@frame("history_of_runs", "SELECT * FROM (VALUES ('a', CAST(2 AS BIGINT), 1.0, 'success'), ('b', 2, 0.0, 'failed'), ('c', 2, NULL, 'skipped'), ('d', 2, 1.0, 'success')) AS t(name, runs, success_rate, last_status)")
def history_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _project(CHAIN, "remembered")
    for _ in range(2):
        Runner(root, spark).run(RunRequest())
    project = Project.load(root)
    board = {x["model"]: x for x in portfolio(Graph(project.models), read_runs(root / ".loom/runs.jsonl"))}
    rows = [(r.name, r.runs, board[r.name]["success_rate"], r.last_status) for r in summary(model_rows(runs_frame(spark, f"file://{root}/.loom/runs.jsonl"))).collect()]  # a row for each model
    return spark.createDataFrame(rows, "name string, runs long, success_rate double, last_status string")


@frame(
    "run_percentiles",
    """WITH r AS (SELECT 'm' || CAST(o_custkey % 5 AS VARCHAR) AS name, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_totalprice) - 1 AS place, COUNT(*) OVER (PARTITION BY o_custkey % 5) AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT name, MAX(CASE WHEN place = round_even(0.5 * (n - 1), 0) THEN s END) AS p50, MAX(CASE WHEN place = round_even(0.95 * (n - 1), 0) THEN s END) AS p95, MAX(n) AS runs FROM r GROUP BY name""",
)
def run_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    rows = o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("name"), F.timestamp_seconds("o_orderkey").alias("started_at"), F.lit("success").alias("status"), F.col("o_totalprice").alias("elapsed_seconds"))
    return summary(rows).select("name", "p50", "p95", "runs")


@frame("nearest_ranks", "SELECT q, quantile_disc(o, 1) AS top, COUNT(*) AS n FROM (SELECT 1.0 AS q, o_totalprice AS o FROM orders) AS x GROUP BY q")
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [r[0] for r in table(spark, sf_dir, "orders").select("o_totalprice").orderBy(F.desc("o_totalprice")).limit(50).collect()]
    n = table(spark, sf_dir, "orders").count()
    return spark.createDataFrame([(1.0, nearest_rank(values, 1.0), n)], "q double, top double, n long")


# tests, settings, imports


@frame(
    "tests_with_errors",
    """SELECT 'o_custkey' AS name, 'unique' AS test, (SELECT COUNT(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1) AS d) AS failing UNION ALL SELECT 'o_custkey', 'odd', -1
UNION ALL SELECT 'gone', 'not_null', -1 UNION ALL SELECT 'o_orderstatus', 'accepted_values', (SELECT COUNT(*) FROM orders WHERE o_orderstatus <> 'O') UNION ALL SELECT 'large', 'large', (SELECT COUNT(*) FROM orders WHERE o_totalprice > 300000)""",
)
def tests_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..project import CustomTest

    b = Backend(spark, _schema("erring"))
    b.write_temporary("o", table(spark, sf_dir, "orders"))
    m = Model("o", Kind.SQL, columns=[Column("o_custkey", tests=["unique", "odd"]), Column("gone", tests=["not_null"]), Column("o_orderstatus", tests=[{"accepted_values": {"values": ["O", None]}}])])
    tests = data_tests.DataTests(b)
    found = [*tests.run_model(m), tests.run_custom(CustomTest("large", "SELECT * FROM {{ ref('o') }} WHERE o_totalprice > 300000;", ("o",)))]
    return spark.createDataFrame([(t.column or t.model, t.name, t.failing_rows) for t in found], "name string, test string, failing long")


@frame("profiles_and_variables", "SELECT 'base' AS profile, COUNT(*) AS n FROM orders WHERE o_totalprice >= 1000 UNION ALL SELECT 'prod', COUNT(*) FROM orders WHERE o_totalprice >= 50000 UNION ALL SELECT 'given', COUNT(*) FROM orders WHERE o_totalprice >= 200000")
def profiles_and_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _project({"models/counted.sql": "SELECT COUNT(*) AS n FROM (" + _seed(sf_dir, "orders") + ") AS o WHERE o_totalprice >= {{ var('least') }}"}, "profiled")
    with (root / "loom.yaml").open("a") as f:
        f.write("profiles:\n  prod: {vars: {least: 50000}, default_schema: loom_profiled_prod}\n")
    out = []
    for name, schema, options in (("base", _schema("profiled"), {}), ("prod", "loom_profiled_prod", {"profile": "prod"}), ("given", "loom_profiled_prod", {"profile": "prod", "run_vars": {"least": 200000}})):
        _ran(root, spark, **options)
        out.append((name, spark.table(f"{schema}.counted").first()[0]))
    return spark.createDataFrame(out, "profile string, n long")


@frame("python_results", "SELECT 'arrow' AS kind, COUNT(*) AS n, SUM(n_nationkey)::BIGINT AS total FROM nation UNION ALL SELECT 'pandas', COUNT(*), SUM(n_nationkey)::BIGINT FROM nation UNION ALL SELECT 'spark', COUNT(*), SUM(n_nationkey)::BIGINT FROM nation")
def python_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "from loomspark.model import transform\n\n" + "\n\n".join(f"@transform(depends_on=['nations'])\ndef of_{k}(ctx):\n    return ctx.ref('nations').select('n_nationkey'){call}" for k, call in (("spark", ""), ("pandas", ".toPandas()"), ("arrow", ".toArrow()")))
    _ran(_project({"models/nations.sql": _seed(sf_dir, "nation"), "models/frames.py": body}, "frames"), spark)
    parts = [spark.table(f"{_schema('frames')}.of_{k}").agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("total")) for k in ("arrow", "pandas", "spark")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@frame("imported_configuration", "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def imported_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {"parameters": {"blocks": [{"name": "B", "codes": [{"name": "Large", "script": [f"CREATE OR REPLACE TABLE large AS SELECT * FROM parquet.`{sf_dir}/orders.parquet` WHERE o_totalprice > 1000"]}, {"name": "Counted", "script": ["SELECT o_orderstatus AS status, COUNT(*) AS n FROM large GROUP BY o_orderstatus"]}]}]}}
    root = Path(tempfile.mkdtemp(prefix="loom-import-"))
    write_import(import_config(raw), root, _schema("imported"))
    with (root / "loom.yaml").open("a") as f:
        f.write(f"default_schema: {_schema('imported')}\n")
    # a script's tables are its own affair: the model that reads one says so
    (root / "models" / "counted.sql").write_text((root / "models" / "counted.sql").read_text().replace("{{ ref('large') }}", f"{_schema('imported')}.large") + "-- {{ ref('large') }}\n")
    report = Runner(root, spark).run(RunRequest(history=False))
    if not report.ok:
        raise RuntimeError([(m.model.name, m.error) for m in report.models])
    return spark.table(f"{_schema('imported')}.counted")
