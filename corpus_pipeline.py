"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns the columns of
documents, but for the last, which returns packed pieces. run() writes each stage's rows to the shared folder and deletes
what the stage needed on the way. Rows are dropped singly: one that shares its doc_id with another keeps its own verdict.
An empty table passes all stages and gives no piece; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from loomspark.llm.common import cut, drop, tidy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5. Null and empty texts score what no feature at all means, and stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(docs, labels, keep=tuple(docs.columns), name="__score")
    return found.where("__score < 0.5").drop("__score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the smallest doc_id. Rows without doc_id stay; of rows equal in doc_id and
    text one stays."""
    gone = exact_dedup.exact_dedup(docs).where("NOT kept").select("doc_id", F.col("text_sha256").alias("__sha"))
    rows = docs.withColumn("__sha", F.sha2(exact_dedup.normalised(docs), 256)).join(gone, ["doc_id", "__sha"], "left_anti")
    twice = cut(rows.where("doc_id IS NOT NULL").groupBy("doc_id", "__sha").count().where("count > 1").drop("count"), "twice")
    if not twice.isEmpty():
        once = rows.join(twice, ["doc_id", "__sha"]).dropDuplicates(["doc_id", "__sha"])
        rows = rows.join(twice, ["doc_id", "__sha"], "left_anti").unionByName(once)
    return rows.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (0.8 or more on five words) one row, that with the smallest doc_id.

    Rows without doc_id stay. Where rows repeat a doc_id, each takes part by itself, under a number made of doc_id and text.
    """
    rows, key = docs, "doc_id"
    twice = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("__twice")), "twice")
    if not twice.isEmpty():
        key = "__own"
        own = F.when(F.col("__twice"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
        rows = docs.join(twice, "doc_id", "left").withColumn(key, own).drop("__twice")
    found = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws, a row for each run of them; a row without words stays."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their token ids, sequence and offset; a null or empty text is the end token alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learning, minhashes and tokenisation have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sf_dir's documents after all stages; what a stage wrote is deleted once the next has written its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with tidy(spark) as keep:
            docs = cut(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
