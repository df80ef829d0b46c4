from __future__ import annotations

import json

import pytest

from loomspark.config import ProjectConfig, interpolate, load_dotenv, seed_overrides
from loomspark.model import BackendError, Model, Kind, ProjectError
from loomspark.observe import catalog
from loomspark.observe.diagnostics import Bucket, classify_error, run_diagnostics
from loomspark.observe.history import read_runs
from loomspark.observe.lineage import Emitter, export
from loomspark.observe.reliability import model_history, nearest_rank, portfolio, reliability
from loomspark.operators.data_tests import DataTests
from loomspark.operators.materialize import Backend, physical_name
from loomspark.plans.graph import Graph, GraphError
from loomspark.plans.runner import Runner, RunRequest
from loomspark.plans.state import StateStore
from loomspark.project import Project
from loomspark.web import App


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


BASIC = {
    "loom.yaml": "name: shop\ndefault_schema: shop_basic\nvars: {least: 100}\njinja: true\n",
    "seeds/orders.csv": "id,customer,amount,day\n1,a,50,2024-01-01\n2,b,200,2024-01-02\n3,a,500,2024-02-01\n",
    "models/big.sql": "SELECT * FROM {{ ref('orders') }} WHERE amount >= {{ var('least') }}",
    "models/totals.py": "from loomspark.model import transform\n\n@transform(depends_on=['big'], tags=['mart'])\ndef totals(ctx):\n    assert ctx.vars('least')\n    return ctx.ref('big').groupBy('customer').sum('amount').withColumnRenamed('sum(amount)', 'total')\n",
    "models/schema.yml": "models:\n  - name: big\n    materialization: ephemeral\n    owner: ann\n    criticality: tier-1\n    pii: true\n    consumers: [board]\n    columns:\n      - {name: id, tests: [not_null, unique]}\n      - {name: customer, tests: [{relationships: {to: shop_basic.orders, field: customer}}, {accepted_values: {values: [a, b]}}]}\n",
    "tests/positive.sql": "SELECT * FROM {{ ref('totals') }} WHERE total <= 0",
}


def test_run_with_tests_history_and_selection(spark, tmp_path):
    root = write(tmp_path, BASIC)
    events = []
    runner = Runner(root, spark, Emitter("shop", events.append))
    report = runner.run(RunRequest(test=True))
    assert report.ok and len(report.tests) == 5
    assert {r["customer"]: r["total"] for r in spark.table("shop_basic.totals").collect()} == {"a": 500, "b": 200}
    assert dict(spark.table("shop_basic.orders").dtypes)["amount"] == "bigint"
    run = read_runs(root / ".loom/runs.jsonl")[0]
    assert run["successes"] == 3 and json.dumps(run)
    assert [e["eventType"] for e in events if e["job"]["name"] == "totals"] == ["START", "COMPLETE"]
    assert runner.run(RunRequest(run_vars={"least": 400})).ok and spark.table("shop_basic.totals").count() == 1
    # an upstream that isn't selected is still resolved
    assert runner.run(RunRequest(select=["totals"])).ok
    assert runner.run(RunRequest(reuse_seeds=True)).ok
    with pytest.raises(GraphError):
        runner.run(RunRequest(select=["nothing"]))
    assert [m.model.name for m in runner.run(RunRequest(select=["tag:mart+"])).models] == ["totals"]


def test_failures_skips_and_disabled(spark, tmp_path):
    root = write(
        tmp_path,
        {
            "loom.yaml": "name: f\ndefault_schema: failing\n",
            "models/a.sql": "SELECT 1 AS x",
            "models/b.sql": "SELECT CAST('oops' AS INT) AS y, x FROM {{ ref('a') }}",
            "models/c.sql": "SELECT * FROM {{ ref('b') }}",
            "models/d.sql": "SELECT * FROM {{ ref('a') }}",
        },
    )
    got = {m.model.name: (m.status, m.skipped_reason) for m in Runner(root, spark).run(RunRequest()).models}
    assert got == {"a": ("success", None), "b": ("failed", None), "c": ("skipped", "upstream_failure"), "d": ("success", None)}
    report = Runner(root, spark).run(RunRequest(disable=["b"]))
    assert report.ok and {m.model.name: m.status for m in report.models}["c"] == "skipped"
    assert Runner(root, spark).run(RunRequest(enable_only=["a"])).ok
    with pytest.raises(ProjectError):
        Runner(root, spark).run(RunRequest(disable=["zzz"]))
    fast = Runner(root, spark).run(RunRequest(fail_fast=True, threads=1))
    assert len(fast.models) == 4 and not fast.ok
    plan = Runner(root).plan(RunRequest(disable=["b"]))
    assert plan.disabled == ["b"] and plan.skipped == ["c"] and plan.layers[0] == ["a"]


def test_incremental_state_and_full_refresh(spark, tmp_path):
    root = write(
        tmp_path,
        {
            "loom.yaml": "name: i\ndefault_schema: inc\njinja: true\nvars: {n: 2}\n",
            "models/m.sql": "SELECT range AS k, range * {{ var('n') }} AS v FROM range({{ var('n') }})",
            "models/schema.yml": "models: [{name: m, materialization: incremental, unique_key: k, config: {watermark: v}}]\n",
        },
    )
    Runner(root, spark).run(RunRequest())
    Runner(root, spark).run(RunRequest(run_vars={"n": 3}))
    assert sorted(map(tuple, spark.table("inc.m").collect())) == [(0, 0), (1, 3), (2, 6)]
    Runner(root, spark).run(RunRequest(run_vars={"n": 1}))
    assert spark.table("inc.m").count() == 3
    Runner(root, spark).run(RunRequest(run_vars={"n": 1}, full_refresh=True))
    assert spark.table("inc.m").count() == 1
    state = StateStore(Backend(spark, "inc")).get("m")
    assert state["row_count"] == 1 and len(state["fingerprint"]) == 16 and state["watermark"] == "0"


def test_upsert_edges(spark):
    b = Backend(spark, "edges")
    df = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    b.write_incremental("t", df, ["k"], full_refresh=True)
    b.write_incremental("t", spark.createDataFrame([("z", None), ("b", 1)], "v string, k int"), ["k"])
    assert sorted(map(str, (tuple(r) for r in b.table("t").select("k", "v").collect()))) == ["(1, 'b')", "(None, 'n')", "(None, 'z')"]
    with pytest.raises(BackendError):
        b.write_incremental("t", spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"])
    with pytest.raises(BackendError):
        b.write_incremental("t", df, [])
    b.write_table("t", b.table("t").where("k = 1"))  # reads what it replaces
    assert b.table("t").count() == 1
    assert physical_name("in.c-db.carts") != physical_name("in_c_db_carts")


def test_scripts(spark):
    b = Backend(spark, "scripts")
    diamond = "CREATE OR REPLACE TABLE a AS SELECT range AS x FROM range(3); CREATE OR REPLACE TABLE l AS SELECT x + 1 AS x FROM a; CREATE OR REPLACE TABLE r AS SELECT x + 2 AS x FROM a; CREATE OR REPLACE TABLE j AS SELECT l.x FROM l JOIN r ON l.x = r.x"
    for n in (1, 4):
        assert b.execute(diamond, n).row_count == 4
        assert sorted(r.x for r in b.table("j").collect()) == [2, 3]
    broken = "CREATE OR REPLACE TABLE p AS SELECT 1 AS x; CREATE OR REPLACE TABLE q AS SELECT CAST('oops' AS INT) AS x; CREATE OR REPLACE TABLE s AS SELECT 2 AS x"
    got = b.execute(broken, 2, continue_on_error=True)
    assert [e.index for e in got.errors] == [1] and b.exists("s")
    assert classify_error(got.errors[0].error).bucket is Bucket.CONVERSION
    with pytest.raises(BackendError, match="statement 1"):
        b.execute(broken)
    for bad in (0, "2", True):
        with pytest.raises(BackendError):
            b.execute(diamond, bad)
    assert b.execute(" -- nothing\n").row_count == 0
    b.execute("CREATE OR REPLACE TABLE t (k INT PRIMARY KEY, v VARCHAR); INSERT INTO t VALUES (1, 'a'), (2, NULL); UPDATE t SET v = 'n' WHERE v IS NULL; UPDATE t SET v = v || '!' WHERE k > 5 OR k = 1")
    assert sorted(map(tuple, b.table("t").collect())) == [(1, "a!"), (2, "n")]
    b.execute("INSERT OR REPLACE INTO t SELECT 2, 'new'; INSERT OR IGNORE INTO t SELECT 1, 'no'; DELETE FROM t WHERE v = 'zzz' OR k IS NULL")
    assert sorted(map(tuple, b.table("t").collect())) == [(1, "a!"), (2, "new")]
    b.execute("CREATE OR REPLACE TABLE s2 AS SELECT 2 AS k, 'm' AS v UNION ALL SELECT 3, 'i'; MERGE INTO t USING s2 s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)")
    assert sorted(map(tuple, b.table("t").collect())) == [(1, "a!"), (2, "m"), (3, "i")]
    with pytest.raises(BackendError):
        b.execute("CREATE TABLE t AS SELECT 1")
    b.execute("TRUNCATE TABLE t; INSERT INTO t VALUES (9, 'z'); DROP TABLE IF EXISTS s2; DROP TABLE IF EXISTS never")
    assert [tuple(r) for r in b.table("t").collect()] == [(9, "z")] and not b.exists("s2")
    with pytest.raises(BackendError):
        b.execute("DROP TABLE never")


def test_files_that_another_session_left_are_no_hindrance(spark):
    b = Backend(spark, "orphans")
    home = spark.catalog.getDatabase("orphans").locationUri
    spark.range(3).write.parquet(f"{home}/t")
    assert b.write_table("t", spark.range(5).toDF("a")) == 5 and b.write_table("t", b.table("t").where("a > 2")) == 2
    assert spark.read.parquet(f"{home}/t").count() == 3 and b.table("t").count() == 2


def test_views_and_python_results(spark, tmp_path):
    root = write(
        tmp_path,
        {
            "loom.yaml": "name: v\ndefault_schema: viewed\n",
            "models/base.sql": "SELECT range AS id, range % 2 AS part FROM range(4)",
            "models/v.sql": "SELECT id * 2 AS d FROM {{ ref('base') }}",
            "models/over_temp.sql": "SELECT id FROM {{ ref('temp') }}",
            "models/temp.sql": "SELECT id FROM {{ ref('base') }} WHERE id > 1",
            "models/p.py": "import pandas as pd\nfrom loomspark.model import transform\n\n@transform(materialization='view')\ndef p(ctx):\n    return pd.DataFrame({'a': [1, 2]})\n\n@transform()\ndef nothing(ctx):\n    return None\n\n@transform()\ndef sneaky(ctx):\n    return ctx.ref('base')\n",
            "models/schema.yml": "models: [{name: v, materialization: view}, {name: over_temp, materialization: view}, {name: temp, materialization: ephemeral}, {name: base, partition_by: [part]}]\n",
        },
    )
    got = {m.model.name: m for m in Runner(root, spark).run(RunRequest()).models}
    assert got["v"].status == got["p"].status == got["over_temp"].status == "success"
    assert got["base"].row_count == 4 and got["p"].row_count == 2
    assert got["nothing"].status == got["sneaky"].status == "failed" and "depends_on" in got["sneaky"].error


def test_data_test_errors(spark):
    b = Backend(spark, "dt")
    b.write_table("t", spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "k int, s string"))
    from loomspark.model import Column

    m = Model("t", Kind.SQL, columns=[Column("k", tests=["unique", "odd"]), Column("s", tests=["not_null", {"accepted_values": {"values": ["x", None]}}]), Column("gone", tests=["not_null"])])
    got = {(t.column, t.name): (t.passed, t.failing_rows) for t in DataTests(b).run_model(m)}
    assert got == {("k", "unique"): (False, 1), ("k", "odd"): (False, -1), ("s", "not_null"): (False, 1), ("s", "accepted_values"): (False, 1), ("gone", "not_null"): (False, -1)}


def test_config(tmp_path, monkeypatch):
    root = write(tmp_path, {"loom.yaml": "name: ${N:-x}\nvars: {a: 1, b: 2}\nconnections:\n  one: {type: spark, path: data/w}\n  two: {type: spark}\nprofile: two\nprofiles:\n  dev:\n    vars: {b: 3}\n    default_schema: dev\n", ".env": "# c\nexport LOOM_T='q'\n"})
    c = ProjectConfig.from_file(root, "dev")
    assert (c.name, c.vars, c.default_schema, c.active_profile) == ("x", {"a": 1, "b": 3}, "dev", "dev")
    assert ProjectConfig.from_file(root).connection().name == "two"
    assert c.resolved(c.connection("one"))["path"] == str(root / "data/w")
    for bad in (lambda: ProjectConfig.from_file(root, "nope"), lambda: c.connection("nope"), lambda: interpolate("${NOT_SET_ANYWHERE}"), lambda: ProjectConfig.from_file(root / "gone")):
        with pytest.raises(ProjectError):
            bad()
    env = {}
    load_dotenv(root / ".env", env)
    assert env == {"LOOM_T": "q"}
    assert seed_overrides({"s": {"columns": [{"name": "a", "data_type": "BIGINT"}, {"name": "b", "type": "DATE"}]}, "t": {"c": "DOUBLE"}}) == {"s": {"a": "BIGINT", "b": "DATE"}, "t": {"c": "DOUBLE"}}


def test_graph():
    g = Graph([Model("a", Kind.SQL), Model("b", Kind.SQL, depends_on=["a"]), Model("c", Kind.SQL, depends_on=["a", "b"], tags=["t"])])
    assert g.layers() == [["a"], ["b"], ["c"]] and g.select(["+b"]) == {"a", "b"} and g.select(["b+"]) == {"b", "c"} and g.select(["+tag:t"]) == {"a", "b", "c"}
    assert "->" in g.dot() and g.apply((), ["c"]).order() == ["a", "b"]
    for bad in ([Model("a", Kind.SQL), Model("a", Kind.SQL)], [Model("a", Kind.SQL, depends_on=["z"])], [Model("a", Kind.SQL, depends_on=["b"]), Model("b", Kind.SQL, depends_on=["a"])]):
        with pytest.raises(GraphError):
            Graph(bad)


def test_observation(spark, tmp_path):
    root = write(tmp_path, {**BASIC, "loom.yaml": BASIC["loom.yaml"].replace("shop_basic", "shop_obs").replace("shop", "shop", 1), "models/schema.yml": BASIC["models/schema.yml"].replace("shop_basic", "shop_obs")})
    Runner(root, spark).run(RunRequest())
    p = Project.load(root)
    g = Graph(p.models)
    runs = read_runs(root / p.config.history)
    assert catalog.pii_models(g) == {"big", "totals"} and catalog.contract(g, "orders")["would_break"] == ["big", "totals"]
    assert len(export("shop", g)) == 3 and len(catalog.manifest(p, g)["edges"]) == 2
    assert {x["model"]: x["last_status"] for x in portfolio(g, runs)}["big"] == "success"
    assert reliability(g, runs)["tiers"]["tier-1"]["7d"] == 1.0 and model_history(runs, "big")["success_rate"] == 1.0
    assert nearest_rank([1, 2, 3, 4], 0.5) == 3 and nearest_rank([], 0.5) is None
    app = App(root)
    for path in ("/api/project", "/api/project/config", "/api/project/readme", "/api/project/git", "/api/manifest", "/api/manifest/openlineage", "/api/seeds", "/api/portfolio", "/api/reliability", "/api/llm-knowledge", "/api/models/big", "/api/models/big/contract", "/api/models/big/docs", "/api/models/big/history?limit=1", "/api/runs?limit=5", f"/api/runs/{runs[0]['run_id']}", f"/api/runs/{runs[0]['run_id']}/diagnostics", "/"):
        assert app.get(path)[0] == 200, path
    for path in ("/api/models/none", "/api/runs/none", "/api/none", "/assets/../loom.yaml"):
        assert app.get(path)[0] == 404, path


@pytest.mark.parametrize(
    ("text", "bucket"),
    [
        ("[CAST_INVALID_INPUT] The value 'x' of the type \"STRING\" cannot be cast to \"INT\" because it is malformed.", Bucket.CONVERSION),
        ("[DATATYPE_MISMATCH.BINARY_OP_DIFF_TYPES] Cannot resolve (\"INT\" and \"DATE\")", Bucket.TYPE_MISMATCH),
        ("[UNRESOLVED_ROUTINE] Cannot resolve routine `nope` on search path", Bucket.FUNCTION_SIGNATURE),
        ("[MERGE_CARDINALITY_VIOLATION] t: several rows of the source match one of the target", Bucket.IDEMPOTENCE),
        ("[TABLE_OR_VIEW_NOT_FOUND] The table or view `foo` cannot be found.", Bucket.MISSING_OBJECT),
        ("[PARSE_SYNTAX_ERROR] Syntax error at or near 'QUALIFY'.", Bucket.PARSER),
        ("something odd", Bucket.OTHER),
    ],
)
def test_classifier(text, bucket):
    assert classify_error(text).bucket is bucket
    assert run_diagnostics({"models": [{"name": "m", "error": text}]})["buckets"] == {str(bucket): 1}
