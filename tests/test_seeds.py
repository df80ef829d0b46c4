from __future__ import annotations

import pandas as pd

from loomspark.functions import exact_quantiles, quantile_codes
from loomspark.operators.materialize import Backend
from loomspark.sources.inference import detect_sentinels, infer_types, typed
from loomspark.sources.seeds import discover, load, read_seed, schemas


def test_inference(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-02", "2024-01-02 10:00:00", "x", None), (" 22 ", "2", "2024-02-03", "2024-01-02", "", None), (None, "1e3", None, None, "z", None)], "a string, b string, c string, d string, e string, f string")
    found = infer_types(df)
    assert found.types == {"a": "BIGINT", "b": "DOUBLE", "c": "DATE", "d": "TIMESTAMP", "e": "VARCHAR", "f": "VARCHAR"} and found.mode == "full"
    assert infer_types(df, {"a": "DECIMAL(18,2)"}).types["a"] == "DECIMAL(18,2)"
    assert dict(typed(df, found.types).dtypes) == {"a": "bigint", "b": "double", "c": "date", "d": "timestamp", "e": "string", "f": "string"}
    assert infer_types(df, full_scan_rows=1).mode == "sampled"
    assert infer_types(spark.createDataFrame([("1.0d",), ("2026",)], "a string")).types == {"a": "VARCHAR"}


def test_inference_looks_at_every_row(spark, tmp_path):
    n = 1_100_000
    df = spark.range(n).selectExpr("CASE WHEN id % 100000 = 99 THEN 'x' ELSE CAST(id AS STRING) END AS a", "'word' AS b")
    found = infer_types(df)
    assert found.mode == "full" and found.rows == n and found.types == {"a": "VARCHAR", "b": "VARCHAR"}
    assert found.failures["a"]["BIGINT"] == 11 and found.failures["b"]["DOUBLE"] == n
    df.write.parquet(f"{tmp_path}/big")
    table, found = read_seed(spark, discover(tmp_path)[0])
    assert found.mode == "full" and table.where("a = 'x'").count() == 11


def test_sentinels(spark):
    df = spark.createDataFrame([("",), ("",), ("a",), ("b",), ("c",), (None,)], "role string")
    assert detect_sentinels(df, ["role"])["role"].shares == {"": 0.4}


def test_seeds(spark, tmp_path):
    (tmp_path / "in-c-db" / "carts").mkdir(parents=True)
    for i in range(2):
        pd.DataFrame({"id": [f"{i}"], "amount": ["1.5"], "note": ["x"]}).to_parquet(tmp_path / "in-c-db" / "carts" / f"{i}.parquet")
    (tmp_path / "codes.csv").write_text("code,n\nCZ,1\nDE,2\n")
    seeds = discover(tmp_path, {"codes": {"n": "VARCHAR"}})
    assert [s.name for s in seeds] == ["codes", "in-c-db.carts"]
    b = Backend(spark, "seeded")
    assert load(b, seeds) == {"codes": 2, "in-c-db.carts": None}
    assert dict(b.table("in-c-db.carts").dtypes) == {"id": "bigint", "amount": "double", "note": "string"}
    assert spark.sql("SELECT count(*) FROM `in-c-db.carts`").first()[0] == 2
    assert dict(b.table("codes").dtypes)["n"] == "string"
    assert read_seed(spark, seeds[0])[1] is None
    cache = tmp_path / "cache.json"
    assert schemas(spark, seeds, cache) == schemas(spark, seeds, cache) == {"codes": {"n": "VARCHAR"}, "in-c-db.carts": {"id": "VARCHAR", "amount": "VARCHAR", "note": "VARCHAR"}}


def test_quantile_codes_are_pandas(spark):
    for values in ([1, 2, 3, 4, 5, 6, 7], [1, 1, 1, 1, 9], [5, 5, 5], [0.5, 2, 2, 2, 3, 8, 9, 9]):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = sorted((r.x, r.x_code) for r in quantile_codes(df, {"x": "x_code"}).collect())
        if len(set(values)) == 1:
            assert {c for _, c in got} == {3}
        else:
            want = pd.qcut(pd.Series(sorted(map(float, values))), 5, labels=False, duplicates="drop") + 1
            assert [c for _, c in got] == want.tolist()


def test_quantiles_of_what_no_task_can_sort(spark):
    for values in (range(500), [1.0] * 300 + [2.0] * 100 + [7.5], [x * x % 97 for x in range(400)]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        want = pd.Series([float(v) for v in values]).quantile([0, 0.2, 0.5, 0.99, 1]).tolist()
        got = exact_quantiles(df, ["x"], [0, 0.2, 0.5, 0.99, 1], at_once=20)[0]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
    assert exact_quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5]) == [[]]
