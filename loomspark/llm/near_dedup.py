"""MinHash near-duplicates with tensored banding.

Two collections of sketches, each of HASHES minhashes, are computed; every pair of a left and a right sketch is the key of
one table, so n sketches a side make n * n tables for 2 * n * HASHES minhashes, the square root of what separate tables
take. Documents whose shingle sets have one digest are one node, once a comparison of the sets has confirmed it. A sketch that
nobody else has is dropped before pairs are formed. Buckets meet at their smallest id, so what moves is one row for each
(smallest id, member), not for each pair; the members of such a group are then compared on their full shingle sets, in blocks
bounded in shingles and bytes so that no task holds more, and a large group first sheds what links to its smallest id
directly. Only links that join something are put out.

A pair at similarity x shares no table with probability about 2 * (1 - x**HASHES)**n. The number of sketches follows from
the threshold, so that a pair there is lost once in 3,000 times at most: 12 at 0.85, 17 at 0.80.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, partitions, text_chunks
from .components import components
from .texthash import LOWER, NOT_SPACE, mixed, shingle_hashes, word_bounds, word_hashes

WORDS, PERCENT = 5, 80
#: Minhashes of a sketch; share of pairs at the threshold that all tables may miss.
HASHES, MISSED = 4, 1 / 3000
#: Weight of a block, of which a task holds two: the larger of shingles and an eighth of the bytes.
BLOCK = 1_000_000


def sketch_count(percent: int) -> int:
    """Sketches a side, so that a pair at the threshold is missed with probability MISSED at most."""
    alike = (percent / 100) ** HASHES
    return 1 if alike >= 1 else max(1, ceil(log(MISSED / 2) / log(1 - alike)))


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(31))
    drawn = random.integers(0, 1 << 63, (2 * n * HASHES, 2), dtype=np.uint64)
    return drawn[:, 0], drawn[:, 1] * np.uint64(2) + np.uint64(1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; fewer words are one shingle, no words none."""
    low = LOWER[data]
    starts, ends, doc = word_bounds(low, offsets, NOT_SPACE)
    words = word_hashes(low, starts, ends)
    shingles = shingle_hashes(words, k)
    at = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        else:  # hashes of runs of other lengths are other values
            out.append(shingle_hashes(words[a:b], b - a) + np.uint64(b - a) if b > a else words[:0])
    return out


def sketches(k: int, count: int):
    """Rows (doc_id, text) to (doc_id, n, weight, digest in two parts, sketches)."""
    xor, odd = hash_functions(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, data in text_chunks(batches):
            sets = shingle_sets(offsets, data, k)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            flat = np.concatenate([sets[i] for i in some] or [np.zeros(0, np.uint64)])
            at = np.concatenate([[0], np.cumsum(n[some])])[:-1].astype(np.int64)
            keys = np.zeros((len(n), 2 * count), np.uint64)
            one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                for s in range(2 * count):
                    for h in range(s * HASHES, s * HASHES + HASHES):
                        keys[some, s] = mixed(keys[some, s] + np.minimum.reduceat((flat ^ xor[h]) * odd[h], at) + np.uint64(s))
                one[some] = np.add.reduceat(mixed(flat), at)
                two[some] = np.add.reduceat(mixed(flat ^ xor[0]), at)
            weight = np.maximum(n, np.diff(offsets) // 8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 2 * count, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.array(weight), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["doc_id", "n", "weight", "one", "two", "sketches"]
            )

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, joined: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between left and right members that join two groups of `joined` (a union-find, changed here)."""

    def root(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([sets[i] for i in right])
    owner = np.repeat(right, n[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for a in left:
        lo, hi = np.searchsorted(flat, sets[a], "left"), np.searchsorted(flat, sets[a], "right")
        m = hi - lo
        total = int(m.sum())
        if not total:
            continue
        at = np.repeat(hi - np.cumsum(m), m) + np.arange(total)
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (n[a] + n - both)) & (both > 0))
        for b in near:
            if root(int(a)) != root(int(b)):
                joined[root(int(a))] = root(int(b))
                out.append((int(a), int(b)))
    return out


def compare_blocks(k: int, percent: int):
    """Rows (lead, i, j, id, is_left, is_right, with_lead, text), sorted by block, to links."""

    def block(rows: list[tuple]) -> list[tuple[int, int]]:
        texts = [r[7] for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        sets = shingle_sets(offsets, np.frombuffer(b"".join(texts), np.uint8), k)
        joined = list(range(len(rows)))
        for r in (near := [x for x, row in enumerate(rows) if row[6]]):
            joined[r] = near[0]
        left, right = (np.array([x for x, row in enumerate(rows) if row[c] and len(sets[x])], np.int64) for c in (4, 5))
        if not len(left) or not len(right):
            return []
        return [(rows[a][3], rows[b][3]) for a, b in links_within(sets, left, right, joined, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []
        for b in batches:
            for row, text in zip(zip(*(c.to_pylist() for c in b.columns[:7]), strict=True), b.column(7), strict=True):
                if held and held[0][:3] != row[:3]:
                    out += block(held)
                    held = []
                held.append((*row, text.as_py()))
        if held:
            out += block(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def star_links(k: int, percent: int):
    """Rows (lead, id, weight, lead's text, text) to (lead, id, weight, is linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            leads, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            got = []
            for i, lead in enumerate(leads):
                x, y = b.column(3)[i].as_py(), b.column(4)[i].as_py()
                if x == y:
                    got.append(True)
                    continue
                if last[0] != lead:
                    last = lead, shingle_sets(np.array([0, len(x)]), np.frombuffer(x, np.uint8), k)[0]
                got.append(linked(last[1], shingle_sets(np.array([0, len(y)]), np.frombuffer(y, np.uint8), k)[0], percent))
            yield pa.RecordBatch.from_arrays([pa.array(leads, pa.int64()), pa.array(ids, pa.int64()), b.column(2), pa.array(got, pa.bool_())], names=["lead", "id", "weight", "near"])

    return run


STAR = "lead long, id long, weight long, near boolean"


def confirmed(texts: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(lead, id): members of groups of one digest whose sets equal their lead's. The rest are nodes of their own."""
    groups = table.groupBy("one", "two", "n").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # a table of its own, so that the join can split a hot group; merged at every size, so that small tables show what large ones cost
    groups = cut(groups, "groups").hint("merge")
    members = cut(table.join(groups, ["one", "two", "n"]).where("doc_id <> lead").select("lead", F.col("doc_id").alias("id"), "weight").distinct(), "copies")
    both = members.join(texts, "id").join(texts.select(F.col("id").alias("lead"), F.col("text").alias("lead_text")), "lead")
    tested = both.select("lead", "id", "weight", "lead_text", "text").mapInArrow(star_links(k, 100), STAR)
    return cut(tested.groupBy("lead", "id").agg(F.min("near").alias("near")).where("near").select("lead", "id"), "same")


def links(texts: DataFrame, table: DataFrame, same: DataFrame, percent: int, k: int, block: int) -> DataFrame:
    """Edges (a, b) between documents of different shingle sets; their components are those of all links found."""
    spark, count = texts.sparkSession, sketch_count(percent)
    nodes = table.join(same.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "weight", "sketches")
    nodes = cut(nodes.dropDuplicates(["id", "sketches"]), "nodes")
    each = nodes.select("id", "weight", F.posexplode("sketches").alias("s", "v"))
    often = each.groupBy("s", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # counts are tables of their own, so that the joins with them can split hot keys; merged alike at every size
    often = cut(often, "often").hint("merge")
    kept = each.join(often, ["s", "v"]).groupBy("id").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("s", "v")).alias("k"))
    side = lambda left: F.filter("k", lambda x: (x["s"] < count) == F.lit(left))
    kept = cut(kept.select("id", "weight", side(True).alias("l"), side(False).alias("r")).where("size(l) > 0 AND size(r) > 0"), "sketches")
    keys = kept.select("id", "weight", F.explode("l").alias("x"), "r").select("id", "weight", "x", F.explode("r").alias("y")).select("id", "weight", F.xxhash64("x", "y").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lead")).where("c > 1").drop("c")
    buckets = cut(buckets, "buckets").hint("merge")
    members = cut(keys.join(buckets, "key").select("lead", "id", "weight").distinct(), "members")

    # texts of all members, once
    texts = cut(texts.join(members.select("id").distinct(), "id", "left_semi"), "texts")

    sizes = members.groupBy("lead").agg(F.sum("weight").alias("of"))
    large = members.join(sizes.where(F.col("of") > block), "lead")
    small = members.join(sizes.where(F.col("of") <= block), "lead").select(
        "lead", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.lit(True).alias("is_left"), F.lit(True).alias("is_right"), F.lit(False).alias("with_lead")
    )
    pairs = large.select("lead", "id", "weight").join(texts, "id").join(texts.select(F.col("id").alias("lead"), F.col("text").alias("lead_text")), "lead")
    star = cut(pairs.select("lead", "id", "weight", "lead_text", "text").mapInArrow(star_links(k, percent), STAR), "star")

    # a grid for each large group: those not linked with its lead by blocks, against all by blocks
    near = star.groupBy("lead", "id").agg(F.max("weight").alias("weight"), F.max("near").alias("near"))
    total = near.groupBy("lead").agg(F.sum("weight").alias("of"), F.sum(F.when(F.col("near"), 0).otherwise(F.col("weight"))).alias("rest"))
    star = near.join(total, "lead").where("rest > 0")
    many = lambda c: F.ceil(F.col(c) / block).cast("int")
    own = lambda c: F.pmod(F.xxhash64("id"), many(c)).cast("int")
    as_right = star.select("lead", F.explode(F.sequence(F.lit(0), many("rest") - 1)).alias("i"), own("of").alias("j"), "id", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"), F.col("near").alias("with_lead"))
    as_left = star.where("NOT near").select("lead", own("rest").alias("i"), F.explode(F.sequence(F.lit(0), many("of") - 1)).alias("j"), "id", F.lit(True).alias("is_left"), F.lit(False).alias("is_right"), F.col("near").alias("with_lead"))
    grid = small.unionByName(as_right).unionByName(as_left)
    # exploded rows look fewer than they are: merged, lest they be broadcast
    grid = grid.hint("merge").join(texts, "id").select("lead", "i", "j", "id", "is_left", "is_right", "with_lead", "text")
    grid = grid.repartition(partitions(spark), "lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    found = grid.mapInArrow(compare_blocks(k, percent), "a long, b long")
    return found.unionByName(near.where("near AND lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of distinct shingles of `words`
    lower-cased (A-Z) words; fewer words are one shingle, and texts without words (null, empty) are linked with
    nothing. A component's smallest doc_id is kept. Rows without doc_id link with nothing and are kept, with
    component_id null; rows that repeat a doc_id are one node, which links where one of its texts does. Candidates come
    from minhashes: a pair at the threshold is missed by all tables once in 3,000 times, one above it less often. A task
    holds two blocks, or the longest text. Other columns are ignored; an empty table gives no row.
    """
    table = docs.select("doc_id", "text").mapInArrow(sketches(words, sketch_count(percent)), "doc_id long, n long, weight long, one long, two long, sketches array<long>")
    table = cut(table, "minhash")
    full = table.where("n > 0 AND doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    same = confirmed(texts, full, words)
    edges = links(texts, full, same, percent, words, block).unionByName(same.select(F.col("lead").alias("a"), F.col("id").alias("b")))
    found = components(edges)
    out = table.join(found, table["doc_id"] == found["id"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) WHERE d.doc_id IS NOT NULL
UNION ALL SELECT NULL, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) END, NULL, TRUE
FROM d WHERE doc_id IS NULL
"""
