from __future__ import annotations

import json

from loomspark import migrate, tools
from loomspark.cli import main


def test_project_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "shop")
    assert main(["init", root, "--with-examples"]) == 0 and main(["init", root]) == 1
    capsys.readouterr()
    assert main(["compile", "--project", root, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["order"] == ["stg_users", "users_by_month"]
    assert main(["compile", "--project", root, "--dot"]) == 0 and "digraph" in capsys.readouterr().out
    assert main(["run", "--project", root, "--dry-run"]) == 0
    capsys.readouterr()
    assert main(["run", "--project", root, "--test", "--json"]) == 0
    run = json.loads(capsys.readouterr().out)
    assert run["ok"] and len(run["tests"]) == 2
    assert main(["test", "--project", root]) == 0
    assert main(["docs", "--project", root, "--output", f"{root}/target"]) == 0
    assert main(["run", "--project", root, "--select", "none"]) == 2
    (tmp_path / "shop" / "models" / "bad.sql").write_text("SELECT * FROM nowhere")
    assert main(["run", "--project", root]) == 1
    capsys.readouterr()
    assert main(["diagnostics", "--project", root]) == 0
    assert json.loads(capsys.readouterr().out)["buckets"] == {"missing_object": 1}


def test_sql_and_imports(tmp_path, capsys):
    script = tmp_path / "s.sql"
    script.write_text("CREATE TABLE a AS SELECT CAST(1 AS VARCHAR) x; CREATE TABLE b AS SELECT x FROM a; DELETE FROM b WHERE x = '1'")
    assert main(["sql", "translate", str(script)]) == 0 and "STRING" in capsys.readouterr().out
    assert main(["sql", "split", str(script), "--output", str(tmp_path / "m")]) == 0
    assert "ref('b')" in (tmp_path / "m" / "_residual.sql").read_text() and "ref('a')" in (tmp_path / "m" / "b.sql").read_text()
    raw = {"parameters": {"blocks": [{"name": "B", "codes": [{"name": "One", "script": ["CREATE TABLE o AS SELECT * FROM carts"]}, {"name": "One", "script": ["SELECT * FROM one"]}]}]}, "storage": {"input": {"tables": [{"source": "in.c-shop.carts", "destination": "carts"}]}}}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    found = migrate.import_config(raw)
    assert set(found.models) == {"one", "b__one"} and "ref('in.c-shop.carts')" in found.models["one"] and "ref('one')" in found.models["b__one"]
    assert main(["import", "config", str(tmp_path / "c.json"), "--output", str(tmp_path / "i")]) == 0
    assert main(["import", "tree", str(tmp_path / "c.json"), "--tables", str(tmp_path), "--validate"]) == 1
    (tmp_path / "in-c-shop" / "carts").mkdir(parents=True)
    assert migrate.import_tree(tmp_path, tmp_path / "c.json", tmp_path / "t", "t").issues == []
    assert (tmp_path / "t" / "seeds" / "in.c-shop.carts").is_dir()


def test_tools(spark, tmp_path):
    root = str(tmp_path / "p")
    main(["init", root, "--with-examples"])
    assert len(tools.list_models(root)) == 2 and "`main`.`stg_users`" in tools.compile_sql(root, "users_by_month")
    assert tools.run_subgraph(root, ["+users_by_month"], spark)["ok"] and tools.explain_model(root, "stg_users")["downstream"] == ["users_by_month"]
    assert tools.translate_sql("SELECT a::TEXT") == "SELECT CAST(a AS STRING)"


def test_sanitize(tmp_path, capsys):
    main(["init", str(tmp_path / "q")])
    model = tmp_path / "q" / "models" / "m.sql"
    model.write_text("SELECT CAST(1 AS VARCHAR) AS x\n")
    assert main(["sql", "sanitize", "--project", str(tmp_path / "q"), "--dry-run"]) == 0 and "VARCHAR" in model.read_text()
    assert main(["sql", "sanitize", "--project", str(tmp_path / "q")]) == 0 and "STRING" in model.read_text()
