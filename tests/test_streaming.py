from __future__ import annotations

from loomspark.operators.materialize import Backend
from loomspark.streaming.feed import sessions, upsert_stream, windowed


def test_upserts_from_a_stream(spark, tmp_path):
    b = Backend(spark, "streamed")
    src = str(tmp_path / "in")
    for rows in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 5), (3, "e", 1)]):
        spark.createDataFrame(rows, "k int, v string, t int").write.mode("append").parquet(src)
        stream = spark.readStream.schema("k int, v string, t int").parquet(src)
        upsert_stream(stream, b, "s", ["k"], "t", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.v) for r in b.table("s").collect()) == [(1, "b"), (2, "d"), (3, "e")]


def test_windows_and_sessions(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:10:00', 'a', 1.0D), (TIMESTAMP'2024-01-01 00:50:00', 'a', 2.0D), (TIMESTAMP'2024-01-01 01:05:00', 'a', 4.0D) AS t(ts, k, v)")
    assert sorted((r.n, r.total) for r in windowed(df, "ts", ["k"], "v").collect()) == [(1, 4.0), (2, 3.0)]
    assert len(windowed(df, "ts", ["k"], "v", slide="30 minutes").collect()) == 4
    assert sorted(r.n for r in sessions(df, "ts", ["k"]).collect()) == [1, 2]
