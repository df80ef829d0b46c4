"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, form a stream that is cut into blocks of BLOCK words. The mix consists of
output shards of SLOTS slots. Each slot of a shard draws its source by the targets' shares, so that a shard's counts are
multinomial. A source's drawn slots are numbered; those beyond its target are given back, and what it lacks fills shards at
the end, so that targets are met whatever the draws were. A source's n-th slot maps to a block by a pseudorandom permutation
of the block indices, a keyed Feistel network of its own for each pass over the source; slots and documents then meet by
(source, block). mix() tells what each document gives, mixed() gives the words themselves.

Sources are a table from the start to the end: what reaches the driver is two sums a round of sharing out.
"""

from __future__ import annotations

from math import isclose

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BUCKET_ROWS, SPACE, WORD, cut, documents, gapless, partitions, whole_text

BLOCK, SLOTS, BUCKETS, SEED = 128, 1024, 1024, 11
WEIGHTS = (3, 1, 2)
MOST = 2  # passes over a source
#: Cells of the unit interval that slots and sources meet by, at least; more where there are more sources.
CELLS = 1 << 12
#: Cells up to which they are broadcast, with a source each or two: some megabytes.
BROADCAST_CELLS = 1 << 15
#: Rounds of the network; places outside that a slot steps over before it is left to the next look.
ROUNDS, STEPS = 4, 64
#: A word with the gap behind it, the first also with the one before it: all of them make up the text.
WORD_AND_GAP = f"(?:^{SPACE}+)?{WORD}{SPACE}*"


def level(sources: DataFrame, share: float, most: int) -> float:
    """What a source takes for each unit of weight, where it isn't stopped at `most` times its size. sources: n, weight."""
    total, weight = sources.agg(F.sum("n"), F.sum("weight")).first()
    if not total:
        return 0.0
    unit = float(share * total / weight)
    while True:
        stopped = F.lit(unit) * F.col("weight") >= F.lit(most) * F.col("n")
        full, weight = sources.agg(F.sum(F.when(stopped, F.col("n"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not weight:
            return unit
        now = float((share * total - most * (full or 0)) / weight)
        if now <= unit or isclose(now, unit, rel_tol=1e-12):
            return unit
        unit = now


def numbered(spark: SparkSession, names: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the number of each row in the order of a column, nulls last: sorted by ranges, and numbered from the ranges' sizes."""
    rows = cut(names.orderBy(F.col(column).asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    at = F.col("_id").bitwiseAND((1 << 33) - 1)
    return rows.join(sizes, part == F.col("_part")).withColumn(name, F.col("_first") + at).drop("_id", "_part", "_first")


def targets(docs: DataFrame, share: float, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(i, src, n, weight, target) of each source of docs (source, size); weights repeat in the order of the sources, null last.

    Together the targets are `share` of all sizes. One stops at `most` times its source's size; the excess is shared anew
    among the others by weight.
    """
    per = docs.groupBy(F.col("source").alias("src")).agg(F.sum("size").alias("n"))
    sources = numbered(docs.sparkSession, per, "src", "i")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    sources = cut(sources.withColumn("weight", weight), "sources")
    unit = level(sources, share, most)
    return sources.withColumn("target", F.least(F.lit(unit) * F.col("weight"), (F.lit(most) * F.col("n")).cast("double")))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x among 0 to n - 1 by a pseudorandom permutation of the key, for n up to 2**52 or so.

    A Feistel network over pairs of digits below the root of n, rounded up, permutes a few places more than n; a place
    outside is mapped again. Where STEPS such steps don't lead back in, the result is n or more, and maps on from there.
    """
    root = F.ceil(F.sqrt(n.cast("double")))
    side = root + F.when(root * root < n, 1).otherwise(0)

    def network(y: Column) -> Column:
        pair = F.struct(F.floor(y / side).cast("long").alias("a"), F.pmod(y, side).cast("long").alias("b"))
        for k in range(ROUNDS):
            # an array of one, so that a round's pair is computed once
            turn = lambda p, k=k: F.struct(p["b"].alias("a"), F.pmod(p["a"] + F.pmod(F.xxhash64(p["b"], F.lit(k), *key), side), side).alias("b"))
            pair = F.transform(F.array(pair), turn)[0]
        return F.transform(F.array(pair), lambda p: p["a"] * side + p["b"])[0]

    again = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), y, lambda z, _: F.when(z < n, z).otherwise(network(z)))
    return F.transform(F.array(network(x)), lambda y: F.when(y < n, y).otherwise(again(y)))[0]


def blocks_of(slots: DataFrame, seed: int, most: int = MOST) -> DataFrame:
    """Adds the block of each slot (i, slot, blocks); slot n is in pass n div blocks, and each pass holds every block once."""
    key = (F.lit(seed), F.col("i"), F.floor(F.col("slot") / F.col("blocks")))
    found = cut(slots.withColumn("block", permuted(F.pmod("slot", "blocks"), F.col("blocks"), *key)), "slots")
    inside, done = F.col("block") < F.col("blocks"), []
    while not found.where(~inside).isEmpty():  # hardly ever: STEPS places outside, one after the other
        done.append(found.where(inside))
        found = cut(found.where(~inside).withColumn("block", permuted(F.col("block"), F.col("blocks"), *key)), "slots")
    for more in done:
        found = found.unionByName(more)
    return found.where(inside)


def _drawn(sources: DataFrame, seed: int, slots: int) -> DataFrame:
    """(i, slot, blocks, shard): the slots of each source (i, want, blocks), numbered, want of them."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    shards = total // slots  # those that are drawn in full
    # each source has a part of the unit interval, in the order of the sources
    some = sources.where("want > 0")
    cells = max(CELLS, sources.count())
    w = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.col("i") / BUCKET_ROWS)  # no task sums up more sources than that
    before = some.groupBy(group.alias("group")).agg(F.sum("want").alias("s")).select("group", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("base"))
    own = Window.partitionBy("group").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    parts = some.withColumn("group", group).withColumn("low", F.coalesce(F.sum("want").over(own), F.lit(0))).join(before, "group")
    parts = parts.select("i", (F.col("low") + F.col("base")).alias("low"), (F.col("low") + F.col("base") + F.col("want")).alias("high"))
    cell = lambda x: F.floor(F.col(x) / F.lit(max(1, total)) * cells).cast("int")
    parts = parts.withColumn("cell", F.explode(F.sequence(cell("low"), F.least(cell("high"), F.lit(cells - 1)))))
    draws = spark.range(0, shards, 1, max(1, min(partitions(spark), shards))).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("k"))
    draws = draws.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "shard", "k"), F.lit(max(1, total))))
    # Spark takes exploded rows for few: the side to build is named, and broadcast only where it is known to be small
    parts = F.broadcast(parts) if cells <= BROADCAST_CELLS else parts.hint("shuffle_hash")
    draws = draws.withColumn("cell", cell("u")).join(parts, "cell").where("low <= u AND u < high")
    draws = cut(draws.select("i", "shard", "k"), "draws")
    slot = gapless(draws, "slot", ["i"], [F.col("shard"), F.col("k")])
    kept = slot.join(some.select("i", "want", "blocks"), "i").where("slot < want").select("i", "slot", "blocks", "shard")
    # what the draws left a source short of
    got = draws.groupBy("i").agg(F.count(F.lit(1)).alias("got"))
    short = some.join(got, "i", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < want")
    step = F.explode(F.sequence(F.floor(F.col("got") / slots), F.floor((F.col("want") - 1) / slots)))
    short = short.withColumn("step", step).withColumn("slot", F.explode(F.sequence(F.greatest("got", F.col("step") * slots), F.least("want", (F.col("step") + 1) * slots) - 1)))
    return kept.unionByName(short.select("i", "slot", "blocks", (F.lit(shards) + F.pmod(F.xxhash64(F.lit(seed), "i", "step"), F.lit(max(1, shards // 64)))).alias("shard")))


def _draw(docs: DataFrame, share: float, weights, seed: int, block: int, slots: int, key: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents' places in the streams (a table), and the part of each that lies in a drawn block: i, at, to, first, words,
    times, shards. Both hold the columns of key, which tell apart rows of one doc_id and size.
    """
    # (source, bucket, doc_id) orders the stream; rows that tie are alike
    d = docs.select("doc_id", *key, F.col("source").cast("string").alias("source"), F.regexp_count(whole_text(docs), F.lit(WORD)).cast("long").alias("size"))
    d = cut(d, "sizes")
    buckets = max(BUCKETS, -(-d.count() // BUCKET_ROWS))
    d = d.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets)).cast("int"))
    sources = targets(d, share, weights).withColumn("blocks", F.ceil(F.col("n") / block))
    want = F.when(F.col("n") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("n")).cast("long"), MOST * F.col("blocks"))).otherwise(0)
    sources = cut(sources.withColumn("want", want.cast("long")), "targets")
    drawn = blocks_of(_drawn(sources, seed, slots), seed)
    times = drawn.groupBy("i", "block").agg(F.count(F.lit(1)).alias("times"), F.collect_set("shard").alias("shards")).hint("merge")  # MOST at most; a table that grows with the input

    # documents' places in their streams
    rows = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    first = first.join(sources.select("i", "src", F.col("n").alias("source_size"), "target"), F.col("s").eqNullSafe(F.col("src"))).drop("src")
    w = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = d.withColumn("upto", F.sum("size").over(w)).join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.select("doc_id", *key, "source", "size", "source_size", "target", "i", (F.col("first") + F.col("upto") - F.col("size")).alias("at"), (F.col("first") + F.col("upto")).alias("to"))
    placed = cut(placed, "placed")
    parts = placed.where("size > 0").select(
        *key, "i", "at", "to", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("to") - 1) / block))).alias("block")
    )
    first = F.greatest(F.col("at"), F.col("block") * block)
    words = F.least(F.col("to"), (F.col("block") + 1) * block) - first
    return placed, parts.join(times, ["i", "block"]).select(*key, "i", "at", "to", "block", (first - F.col("at")).alias("first"), words.alias("words"), "times", "shards")


def mix(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, seed: int = SEED, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of every row of docs (and source).

    Words are `[^\\x20\\x09-\\x0D]+`, null text none. Null is a source of its own, the last. shards: how many output shards a
    document's words go to. A document of no words has taken 0. The result depends on the rows and the seed only, not on
    partitions. Other columns are ignored; an empty table gives no row.
    """
    placed, parts = _draw(docs, share, weights, seed, block, slots)
    taken = parts.groupBy("i", "at", "to").agg(F.sum(F.col("words") * F.col("times")).alias("got"), F.size(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("in"))
    got = placed.join(taken.withColumnRenamed("to", "t_to").hint("merge"), ["i", "at"], "left").where("t_to IS NULL OR t_to = to OR size = 0")
    whole = lambda c: F.when(F.col("size") > 0, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return got.select("doc_id", "source", "size", "source_size", "target", whole("got").alias("taken"), whole("in").alias("shards"))


def mixed(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, seed: int = SEED, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """The words that mix() counts: for each pass, one row with the columns of docs for each run of drawn words of a document.

    text is the run with the gaps between and behind its words, n_chars (if there) its length; the other columns are the
    document's. A document of no words, which no block can hold, stays once as it is. An empty table gives no row.
    """
    # numbers that are written hold for both reads
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__text", F.xxhash64("text")), "rows")
    placed, parts = _draw(rows, share, weights, seed, block, slots, ("__text", "__row"))
    runs = placed.where("size = 0").select("__row", F.lit(None).cast("array<struct<first: int, words: int>>").alias("__runs"))
    each = parts.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    each = each.withColumn("run", F.col("block") - F.row_number().over(Window.partitionBy("__row", "turn").orderBy("block")))
    each = each.groupBy("__row", "turn", "run").agg(F.min("first").cast("int").alias("first"), F.sum("words").cast("int").alias("words"))
    runs = runs.unionByName(each.groupBy("__row").agg(F.collect_list(F.struct("first", "words")).alias("__runs")))
    joined = rows.drop("__text").join(runs.hint("merge"), "__row")  # a table that grows with the input
    # an array of one, so that the words of a text are looked for once and not for each run
    words = F.array(F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0)))
    cuts = F.transform(words, lambda w: F.transform("__runs", lambda r: F.array_join(F.slice(w, r["first"] + 1, r["words"]), "")))[0]
    out = joined.withColumn("__cut", F.explode(F.when(F.col("__runs").isNull(), F.array("text")).otherwise(cuts)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length("__cut")).cast(kind))
    return out.withColumn("text", F.col("__cut")).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shards")
