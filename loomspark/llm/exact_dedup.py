"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive runs of bytes of the normalised text: a round takes the next bytes as radix digit,
counts each (group, digit) with map-side combining and joins the counts back. A document alone in its group leaves the
table, one whose text ended inside the digit is in a finished group of equals, and only the others carry their remaining
bytes on. Digits grow by FACTOR a round, so a text of n bytes takes log(n) rounds. Equality is that of the bytes along
the path: no digest decides anything. Rounds are written to the shared folder, so a lost executor repeats one round.

A prefix or text that a third of all rows share stays spread out: counts combine before the shuffle, and the join's
large side is one that adaptive execution can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, whole_text

FIRST, FACTOR = 48, 16


def normalised(docs: DataFrame):
    return F.regexp_replace(whole_text(docs), f"{SPACE}+", " ")


def exact_dedup(docs: DataFrame, first: int = FIRST, factor: int = FACTOR) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty. Of equal
    texts the smallest doc_id stays. A row without doc_id stays and joins no group (keep_id null, group_size 1). Rows
    that repeat a doc_id with an equal text count singly and share their verdict. A text of any length stays in the JVM.
    Other columns are ignored; an empty table gives no row.
    """
    text = normalised(docs)
    rows = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.lit(None).cast("binary").alias("grp"), text.cast("binary").alias("rest"))
    own = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}
    done = [rows.where("doc_id IS NULL").select("doc_id", "text_sha256", *(c.alias(k) for k, c in own.items()))]
    rows, width = rows.where("doc_id IS NOT NULL"), first
    while True:
        chunk = F.substring("rest", 1, width)
        least = "doc_id" if "row" not in rows.columns else "row"
        groups = (
            rows.groupBy("grp", chunk.alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("m"), F.min(least).alias("g"))
            .where("n > 1")
            .withColumnRenamed("grp", "of")
        )
        # a table of its own, so that the join can split a hot group; merged at every size, so that small tables show what large ones cost
        groups = cut(groups, "groups").hint("merge")
        left = rows.withColumn("digit", chunk).alias("l")
        on = (F.col("l.grp").eqNullSafe(F.col("of")) if "row" not in rows.columns else F.col("l.grp") == F.col("of")) & (F.col("l.digit") == groups["digit"])
        out = left.join(groups, on, "left").withColumn("goes_on", F.col("n").isNotNull() & (F.length("l.digit") == width))
        out = out.select(
            "doc_id",
            "text_sha256",
            F.coalesce("m", "doc_id").alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"),
            F.when(F.col("goes_on"), F.col("l.digit") if least == "doc_id" else F.col("g").cast("string").cast("binary")).alias("grp"),
            F.when(F.col("goes_on"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.monotonically_increasing_id().alias("row"),
        )
        out = cut(out, "radix", release=True)
        done.append(out.where("grp IS NULL").select("doc_id", "text_sha256", *own))
        rows = out.where("grp IS NOT NULL").select("doc_id", "text_sha256", "grp", "rest", "row")
        if rows.isEmpty():
            break
        width *= factor
    found = reduce(DataFrame.unionAll, done)
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN min(doc_id) OVER (PARTITION BY t) END AS keep_id,
       CASE WHEN doc_id IS NULL THEN 1 ELSE count(doc_id) OVER (PARTITION BY t) END AS group_size,
       doc_id IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
