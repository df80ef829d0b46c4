"""A stream into a keyed table, and windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.materialize import Backend


def latest(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows of equal key the last by `order`."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last())
    return batch.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def not_older(batch: DataFrame, stored: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of the batch that the stored row of their key, if any, isn't newer than."""
    known = stored.select(*key, F.col(order).alias("__stored"))
    return batch.join(known, key, "left").where(F.col("__stored").isNull() | (F.col(order) >= F.col("__stored"))).drop("__stored")


def upsert_stream(stream: DataFrame, backend: Backend, table: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps of each key the row that is last by `order`, however late others come; a batch that is repeated changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rows = latest(batch, key, order)
        if backend.exists(table):
            rows = not_older(rows, backend.table(table), key, order)
        backend.write_incremental(table, rows.select(*batch.columns), key)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, by: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window; rows later than `late` are dropped by the watermark."""
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each key parted where they pause for `gap`."""
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
