"""Queries over what surrounds the engine: command line, HTTP, tools, settings, imports, reliability."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools
from ..config import ProjectConfig
from ..migrate import import_tree, validate_tree
from ..model import BackendError, Governance, Kind, Model
from ..observe.reliability import model_history, reliability
from ..plans.graph import Graph
from ..plans.runner import Runner, RunRequest, script_stats
from ..web import App
from .catalogue import _project, _schema, _seed, frame, table
from .materialize import Backend

SHOP = {
    "seeds/codes.csv": "code,n\nCZ,1\nDE,2\n",
    "models/totals.sql": "SELECT SUM(n) AS n FROM {{ ref('codes') }}",
    "models/script.sql": "CREATE OR REPLACE TABLE a AS SELECT 1 AS x; CREATE OR REPLACE TABLE b AS SELECT x FROM a; CREATE OR REPLACE TABLE c AS SELECT x FROM a; CREATE OR REPLACE TABLE d AS SELECT b.x FROM b JOIN c ON b.x = c.x",
    "models/schema.yml": "models: [{name: totals, columns: [{name: n, tests: [not_null]}]}, {name: script, materialization: execute, config: {parallelism: 2}}]\n",
    "README.md": "# shop\n",
}


@frame(
    "command_line",
    "SELECT * FROM (VALUES ('compile', 0), ('compile --dot', 0), ('run --dry-run', 0), ('run --test', 0), ('test', 0), ('docs', 0), ('diagnostics', 0), ('run --select none', 2), ('sql translate', 0), ('sql split', 0), ('init', 1)) AS t(command, code)",
)
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..cli import main

    root = _project(SHOP, "command_line")
    (root / "s.sql").write_text("CREATE TABLE a AS SELECT 1 AS x; DELETE FROM a WHERE x = 1")
    at = ["--project", str(root)]
    rest = {"sql translate": [str(root / "s.sql")], "sql split": [str(root / "s.sql"), "--output", str(root / "out")], "docs": ["--output", str(root / "target")]}
    rows = []
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        for command in ("compile", "compile --dot", "run --dry-run", "run --test", "test", "docs", "diagnostics", "run --select none", "sql translate", "sql split"):
            rows.append((command, main([*command.split(), *rest.get(command, []), *at])))
        rows.append(("init", main(["init", str(root)])))
    return spark.createDataFrame(rows, "command string, code int")


@frame(
    "http_routes",
    """SELECT * FROM (VALUES ('/', 200), ('/api/project', 200), ('/api/project/config', 200), ('/api/project/readme', 200), ('/api/project/git', 200), ('/api/manifest', 200), ('/api/manifest/openlineage', 200), ('/api/seeds', 200),
('/api/portfolio', 200), ('/api/reliability', 200), ('/api/llm-knowledge', 200), ('/api/models/totals', 200), ('/api/models/totals/contract', 200), ('/api/models/totals/docs', 200), ('/api/models/totals/history?limit=1', 200),
('/api/runs?limit=2', 200), ('/api/models/none', 404), ('/api/runs/none', 404), ('/assets/../loom.yaml', 404)) AS t(route, status)""",
)
def http_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _project(SHOP, "http_routes")
    Runner(root, spark).run(RunRequest())
    app = App(root)
    models = ("", "/contract", "/docs", "/history?limit=1")
    paths = ["/", *(f"/api/{p}" for p in ("project", "project/config", "project/readme", "project/git", "manifest", "manifest/openlineage", "seeds", "portfolio", "reliability", "llm-knowledge"))]
    paths += [*(f"/api/models/totals{m}" for m in models), "/api/runs?limit=2", "/api/models/none", "/api/runs/none", "/assets/../loom.yaml"]
    return spark.createDataFrame([(p, app.get(p)[0]) for p in paths], "route string, status int")


@frame("agent_tools", "SELECT * FROM (VALUES ('models', 'codes,script,totals'), ('compiled', 'TRUE'), ('ran', 'codes:success,totals:success'), ('translated', 'SELECT CAST(a AS STRING)'), ('downstream', 'totals'), ('edges', '1')) AS t(tool, result)")
def agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = str(_project(SHOP, "agent_tools"))
    ran = tools.run_subgraph(root, ["+totals"], spark)
    rows = [
        ("models", ",".join(sorted(m["name"] for m in tools.list_models(root)))),
        ("compiled", str("`codes`" in tools.compile_sql(root, "totals")).upper()),
        ("ran", ",".join(sorted(f"{m['name']}:{m['status']}" for m in ran["models"]))),
        ("translated", tools.translate_sql("SELECT a::VARCHAR")),
        ("downstream", ",".join(tools.explain_model(root, "codes")["downstream"])),
        ("edges", str(Graph(Runner(root).load(RunRequest())[0].models).dot().count("->"))),
    ]
    return spark.createDataFrame(rows, "tool string, result string")


@frame("script_statistics", "SELECT 4 AS statements, 3 AS layers, 2 AS widest, '1,2,1' AS sizes, 2 AS parallelism")
def script_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = script_stats(Model("script", Kind.SQL, sql=SHOP["models/script.sql"], config={"parallelism": 2}))
    return spark.createDataFrame([(s.statements, s.layers, s.widest, ",".join(map(str, s.sizes)), s.parallelism)], "statements int, layers int, widest int, sizes string, parallelism int")


@frame("checked_parallelism", "SELECT * FROM (VALUES ('0', TRUE), ('two', TRUE), ('True', TRUE), ('1', FALSE), ('3', FALSE)) AS t(value, refused)")
def checked_parallelism(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, rows = Backend(spark, _schema("parallelism")), []
    for value in (0, "two", True, 1, 3):
        try:
            refused = b.execute("-- nothing to do\n", value).row_count != 0
        except BackendError:
            refused = True
        rows.append((str(value), refused))
    return spark.createDataFrame(rows, "value string, refused boolean")


@frame("settings", "SELECT * FROM (VALUES ('name', 'from_env'), ('fallback', 'plain'), ('profile', 'dev'), ('schema', 'dev_schema'), ('variable', '3'), ('connection', 'two'), ('path', 'TRUE'), ('missing', 'refused')) AS t(setting, value)")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import interpolate, load_dotenv
    from ..model import ProjectError

    root = Path(tempfile.mkdtemp(prefix="loom-settings-"))
    text = "name: ${LOOM_TEST_NAME}\nvars: {a: 1, b: '${LOOM_TEST_NONE:-plain}'}\nconnections:\n  one: {type: spark}\n  two: {type: spark, path: data/w}\nprofile: two\nprofiles:\n  dev: {vars: {a: 3}, default_schema: dev_schema}\n"
    (root / "loom.yaml").write_text(text)
    (root / ".env").write_text("# names\nexport LOOM_TEST_NAME='from_env'\n")
    env: dict[str, str] = {}
    load_dotenv(root / ".env", env)
    c = ProjectConfig.from_file(root, "dev", env)
    try:
        missing = interpolate("${LOOM_TEST_NONE}", env)
    except ProjectError:
        missing = "refused"
    path = c.resolved(c.connection("two"))["path"] == str(root / "data/w")
    chosen = ProjectConfig.from_file(root, None, env).connection().name
    rows = [("name", c.name), ("fallback", c.vars["b"]), ("profile", c.active_profile), ("schema", c.default_schema), ("variable", str(c.vars["a"])), ("connection", chosen), ("path", str(path).upper()), ("missing", missing)]
    return spark.createDataFrame(rows, "setting string, value string")


@frame("sanitized_models", "SELECT o_orderstatus AS status, COUNT(*) AS n, MAX(o_orderkey) AS top FROM orders WHERE o_custkey > 20 GROUP BY o_orderstatus")
def sanitized_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose text columns are compared as numbers is rewritten in place, and then runs."""
    from ..cli import main

    files = {
        "models/texts.sql": "SELECT o_orderstatus AS status, CAST(o_custkey AS STRING) AS customer, o_orderkey AS k FROM " + _seed(sf_dir, "orders")[len("SELECT * FROM ") :],
        "models/counted.sql": "SELECT status, COUNT(*) AS n, MAX(k) AS top FROM {{ ref('texts') }} AS texts WHERE texts.customer > 20 GROUP BY status",
        "models/schema.yml": "models: [{name: texts, columns: [{name: status, data_type: VARCHAR}, {name: customer, data_type: VARCHAR}, {name: k, data_type: BIGINT}]}, {name: counted, config: {harmonize: true}}]\n",
    }
    root = _project(files, "sanitized")
    with contextlib.redirect_stdout(io.StringIO()):
        assert main(["sql", "sanitize", "--project", str(root), "--dry-run"]) == 0
    report = Runner(root, spark).run(RunRequest(history=False))
    if not report.ok:
        raise RuntimeError([(m.model.name, m.error) for m in report.models])
    return spark.table(f"{_schema('sanitized')}.counted")


@frame("imported_tree", "SELECT r_name AS region, COUNT(*) AS n, 1 AS issues FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def imported_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pulled tree of tables, one of which is missing, and a transformation over them."""
    root = Path(tempfile.mkdtemp(prefix="loom-tree-"))
    for name in ("nation", "region"):
        table(spark, sf_dir, name).coalesce(1).write.parquet(str(root / "tables" / "in-c-geo" / name))
    script = ['CREATE OR REPLACE TABLE by_region AS SELECT r_name AS region, COUNT(*) AS n FROM "in.c-geo.nation" JOIN "in.c-geo.region" ON n_regionkey = r_regionkey GROUP BY r_name']
    raw = {"parameters": {"blocks": [{"name": "B", "codes": [{"name": "One", "script": script}]}]}, "storage": {"input": {"tables": [{"source": f"in.c-geo.{n}", "destination": n} for n in ("nation", "region", "gone")]}}}
    (root / "c.json").write_text(json.dumps(raw))
    issues = validate_tree(root / "tables", root / "c.json")
    import_tree(root / "tables", root / "c.json", root / "project", _schema("tree"))
    with (root / "project" / "loom.yaml").open("a") as f:
        f.write(f"default_schema: {_schema('tree')}\n")
    report = Runner(root / "project", spark).run(RunRequest(history=False))
    if not report.ok:
        raise RuntimeError([(m.model.name, m.error) for m in report.models])
    return spark.table(f"{_schema('tree')}.by_region").withColumn("issues", F.lit(len(issues)))


@frame(
    "reliability_of_tiers",
    """WITH r AS (SELECT CASE WHEN n_regionkey < 2 THEN 'tier-1' ELSE 'tier-2' END AS tier, CASE WHEN n_nationkey % 4 = 0 THEN 0.0 ELSE 1.0 END AS ok, n_nationkey FROM nation),
m AS (SELECT tier, ok, CAST(n_nationkey AS DOUBLE) AS s, row_number() OVER (PARTITION BY tier, ok ORDER BY n_nationkey) - 1 AS place, COUNT(*) OVER (PARTITION BY tier, ok) AS n FROM r)
SELECT tier, ROUND(AVG(ok), 6) AS attained, MAX(CASE WHEN ok = 1 AND place = round_even(0.95 * (n - 1), 0) THEN s END) AS p95, MAX(CASE WHEN ok = 1 AND place = round_even(0.5 * (n - 1), 0) THEN s END) AS p50 FROM m GROUP BY tier""",
)
def reliability_of_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each nation, of a model of the first or the second tier."""
    now = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)
    graph = Graph([Model(f"m{t}", Kind.SQL, governance=Governance(criticality=f"tier-{t}")) for t in (1, 2)])
    runs = []
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        m = {"name": "m1" if r.n_regionkey < 2 else "m2", "status": "failed" if r.n_nationkey % 4 == 0 else "success", "elapsed_seconds": float(r.n_nationkey)}
        runs.append({"run_id": str(r.n_nationkey), "started_at": (now - dt.timedelta(hours=r.n_nationkey)).isoformat(), "models": [m]})
    found = reliability(graph, runs, now=now)
    slow = {x["model"]: x["p95"] for x in found["slowest"]}
    rows = [(f"tier-{t}", round(found["tiers"][f"tier-{t}"]["7d"], 6), slow[f"m{t}"], model_history(runs, f"m{t}", 100)["p50"]) for t in (1, 2)]
    return spark.createDataFrame(rows, "tier string, attained double, p95 double, p50 double")
