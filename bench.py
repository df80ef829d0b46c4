"""Times the catalogue's queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from loomspark.operators.catalogue import QUERIES
from loomspark.plans.runner import Runner, RunRequest
from loomspark.sqlfront.refs import render_refs


ROWS = 1_000_000
THREE = {
    "generated": f"SELECT id, id % 1000 AS bucket, (id * 7919) % 100003 AS amount FROM range({ROWS})",
    "bucketed": "SELECT bucket, count(*) AS n, sum(amount) AS total FROM {{ ref('generated') }} GROUP BY bucket",
    "top": "SELECT * FROM {{ ref('bucketed') }} ORDER BY total DESC, bucket LIMIT 10",
}


def three_models(spark: SparkSession, home: str) -> dict[str, float]:
    """Seconds of three models as a project and as the same statements issued directly; and of eight models one or four at a time."""
    root = Path(home) / "three"
    wide = Path(home) / "wide"
    for folder, models in ((root, THREE), (wide, {f"w{i}": f"SELECT id % {10 + i} AS k, sum(id) AS s FROM range({ROWS}) GROUP BY 1" for i in range(8)})):
        (folder / "models").mkdir(parents=True)
        (folder / "loom.yaml").write_text(f"name: {folder.name}\ndialect: spark\ndefault_schema: bench_{folder.name}\n")
        for name, sql in models.items():
            (folder / "models" / f"{name}.sql").write_text(sql)
    spark.sql("CREATE DATABASE IF NOT EXISTS bench_direct")

    def direct() -> None:
        for name, sql in THREE.items():
            spark.sql(f"DROP TABLE IF EXISTS bench_direct.{name}")
            spark.sql(f"CREATE TABLE bench_direct.{name} USING parquet AS {render_refs(sql, lambda n: 'bench_direct.' + n)}")

    run = lambda at, threads: Runner(at, spark).run(RunRequest(threads=threads, history=False))
    timed = {"three_models_project": lambda: run(root, 4), "three_models_direct": direct, "eight_models_1_thread": lambda: run(wide, 1), "eight_models_4_threads": lambda: run(wide, 4)}
    times: dict[str, list[float]] = {name: [] for name in timed}
    for _ in range(6):  # in turn, so that all are as warm; the first round doesn't count
        for name, do in timed.items():
            began = time.perf_counter()
            do()
            times[name].append(time.perf_counter() - began)
    return {name: round(statistics.median(t[1:]), 4) for name, t in times.items()}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    home = tempfile.mkdtemp(prefix="loom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", home + "/warehouse")
        .config("spark.checkpoint.dir", f"file://{home}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {}
    for name, q in QUERIES.items():
        times = []
        for _ in range(3):
            began = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        queries[name] = round(statistics.median(times), 4)
    engine = three_models(spark, home)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "sum of warm medians over the catalogue", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "engine": engine, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
