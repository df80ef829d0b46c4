"""Shared plumbing: input columns, cut lineage, gapless numbering, Arrow text access."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: `[\x20\x09-\x0D]`, the white space of all word definitions here.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(docs: DataFrame) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh local one where it is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loomspark-")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loom-{tag}-{uuid.uuid4().hex}"


#: Folders of cut() that are still there.
_made: list[str] = []


@contextmanager
def tidy(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what cut() writes inside, but for the tables that the caller puts into the list."""
    before, keep = set(_made), []
    yield keep
    kept = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
    for path in [p for p in _made if p not in before and p.rpartition("/")[2] not in kept]:
        delete(spark, path)
        _made.remove(path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def until_exit(spark: SparkSession, path: str) -> None:
    """A folder that is there already goes when the driver ends, if nobody has deleted it before."""
    store, at = _at(spark, path)
    store.deleteOnExit(at)


def delete(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def cut(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs only the current step.

    release: wait until Spark's cleaner has deleted the shuffle files behind df, where the next step needs their room.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    _made.append(path)
    del df
    for _ in range(3 if release else 1):
        gc.collect()  # Python's handles of plans go first,
        spark.sparkContext._jvm.System.gc()  # then the plans; the cleaner follows in its own thread
        if release:
            time.sleep(0.7)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files behind a table made by cut()."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(docs: DataFrame) -> int:
    """Bytes behind docs: as stored, by Spark's statistics of the files, where it has some; else its texts are measured."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 52 else docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


#: Rows of a bucket that gapless() numbers in one task, about.
BUCKET_ROWS = 100_000


def gapless(df: DataFrame, name: str, groups: list[str], order: list[Column], lead: Column | None = None, buckets: int = 64) -> DataFrame:
    """Adds a long column that numbers the rows of each group from 0 without gaps.

    No task sees a whole group: rows are numbered within hash buckets of a group, and bucket sizes (a group and lead has
    `buckets` of them, or more where buckets would exceed BUCKET_ROWS rows) are summed up to give each bucket its first
    number. `lead` (int) sorts before the bucket. df is read twice and its rows are counted, so it must be a table.
    """
    buckets = max(buckets, -(-df.count() // BUCKET_ROWS))
    lead = F.lit(0) if lead is None else lead
    df = df.withColumn("_lead", lead).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*groups, "_lead", "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_lead", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = Window.partitionBy(*(df[k] for k in keys)).orderBy(*order)
    # every row has its bucket; a left join, so that only the buckets can be broadcast, never the rows
    out = df.withColumn("_at", F.row_number().over(at)).alias("l").join(first.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
    return out.select(*(F.col(f"l.{c}") for c in df.columns if c not in ("_lead", "_bucket")), (F.col("r._first") + F.col("l._at") - 1).alias(name))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, UTF-8 bytes) of about `limit` bytes at most, or of one longer row; null counts as empty."""
    for batch in batches:
        a = batch.column(batch.schema.get_field_index(column))
        if a.null_count:
            a = pc.fill_null(a, b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
        wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
        n = len(a)
        if not n:
            continue
        offsets = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
        data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
            at = to
