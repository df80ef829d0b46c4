"""Sharding by balanced label propagation.

Shards start equal in rows. A round counts each link's documents by shard (combined before the shuffle), lets every linked
document ask for the shard where most of its neighbours are, and grants requests by the number of neighbours there
until a shard's quota is full; whoever is over the quota goes, link by link, to the shards that have room. Every round
ends with counts that differ by one at most, so cut links fall while sizes stay even. Rounds end when the links cut fall by
less than STILL of what they were, or at `rounds`. Text never moves: only ids, sizes and digests of the link do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, drop, gapless, whole_text


#: A round that cuts no fewer links than this share of the last one's less is the last.
STILL = 0.02


def counted(state: DataFrame) -> DataFrame:
    """(link, shard, n): how many documents of each link are in each shard."""
    return state.where("link IS NOT NULL").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))


def wishes(state: DataFrame) -> DataFrame:
    """(link, want, near, cut): the shard that holds most of a link, how many of it, and the pairs of the link that shards part."""
    of = counted(state).groupBy("link").agg(F.sum("n").alias("m"), F.sum(F.col("n").cast("double") * F.col("n")).alias("within"), F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("b"))
    return of.where("m > 1").select("link", (-F.col("b.s")).alias("want"), F.col("b.n").alias("near"), ((F.col("m").cast("double") * F.col("m") - F.col("within")) / 2).alias("cut"))


def propagate(nodes: DataFrame, n_shards: int, rounds: int = 4) -> DataFrame:
    """nodes (doc_id, link, and others) with an int column shard: 0 to n_shards - 1, counts at most one apart.

    Documents with the same non-null link are linked. Null or repeated doc_ids are allowed; each row is placed.
    """
    order = [F.col("doc_id"), F.col("link")]
    state = gapless(nodes, "_no", [], order).withColumn("shard", F.pmod(F.col("_no"), F.lit(n_shards)).cast("int")).drop("_no")
    state = cut(state.select(*nodes.columns, "shard"), "shards")
    total = state.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    of = F.array(*(F.lit(q) for q in quota))
    parted = None
    for _ in range(rounds):
        old = state
        best = cut(wishes(state), "best")  # a table of its own, so that the join can split a hot link
        now = best.agg(F.coalesce(F.sum("cut"), F.lit(0.0))).first()[0]
        if not now or parted is not None and now > parted * (1 - STILL):
            drop(best)
            break
        parted = now
        asked = state.join(best.drop("cut"), "link", "left").withColumn("want", F.coalesce("want", "shard")).withColumn("near", F.coalesce("near", F.lit(0)))
        asked = cut(asked.select(*nodes.columns, "shard", "want", "near"), "asked")
        # by neighbours there (in powers of two), those already there first
        rank = F.lit(129) - F.when(F.col("near") > 0, 2 * F.floor(F.log2("near")) + 2 + (F.col("want") == F.col("shard")).cast("int")).otherwise(0)
        placed = cut(gapless(asked, "_no", ["want"], order, lead=rank.cast("int"), buckets=64), "placed")
        room = {r["want"]: r["n"] for r in placed.groupBy("want").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = [max(0, q - room.get(s, 0)) for s, q in enumerate(quota)]
        ends, at = [], 0
        for x in free:
            at += x
            ends.append(at)
        fits = F.col("_no") < F.element_at(of, F.col("want") + 1)
        over = gapless(placed.where(~fits).drop("_no"), "_over", [], [F.col("link"), F.col("doc_id")])
        to = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("_over"))).cast("int")
        state = placed.where(fits).select(*nodes.columns, F.col("want").alias("shard")).unionByName(over.select(*nodes.columns, to.alias("shard")))
        state = cut(state, "shards")
        for x in (old, best, asked, placed):
            drop(x)
    return state


def shard_documents(docs: DataFrame, n_shards: int = 24, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, beside, apart of every row of docs; equal texts are linked.

    A null text has size 8, crc32 0 and no link. Law `rows`: counts of shards are at most one apart. beside and apart: linked
    documents in the same shard and in others, so that half the sum of apart is the number of links cut. Null and repeated
    doc_ids are placed as any row, texts of any length stay where they are, other columns are ignored, and an empty table
    gives no row.
    """
    nodes = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(whole_text(docs).cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("link"),
    )
    placed = propagate(cut(nodes, "nodes"), n_shards, rounds)
    here = counted(placed)
    of = here.withColumn("m", F.sum("n").over(Window.partitionBy("link"))).where("m > 1")  # a link has a row for each shard
    of = cut(of.select("link", "shard", (F.col("n") - 1).alias("beside"), (F.col("m") - F.col("n")).alias("apart")), "linked")
    out = gapless(placed, "slot", ["shard"], [F.col("doc_id"), F.col("link")]).join(of, ["link", "shard"], "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("beside", none).alias("beside"), F.coalesce("apart", none).alias("apart"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
