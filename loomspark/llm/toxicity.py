"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word features is trained from confirmed toxic examples and unlabelled text. Its risk is
that of the positives, weighed by the class prior, plus what the unlabelled risk as negatives exceeds the share that
the positives in it account for; where that excess turns negative, which only overfitting does, the step goes the
other way (the non-negative correction). Features are words and beginnings of words; those that positives hold more
often than unlabelled text, beyond chance, are selected. Scoring is a lookup of hashes over whole texts.

Training looks at no more than POSITIVES confirmed and UNLABELLED other texts, taken by the smallest hashes of their ids;
these bounds are parameters. How often unlabelled text holds a feature is counted over all rows outside the held-out fold, and
all else runs over every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, text_chunks
from .texthash import ALNUM, LOWER, mixed, word_bounds, word_hashes

POSITIVES, UNLABELLED = 4000, 20_000
FOLDS, HELD_OUT = 5, 0
#: Features kept; lengths in bytes of beginnings of words. A feature's number is 32 bits of its hash.
KEPT, BEGINNINGS = 4096, (4, 5, 6)
#: Positives that hold a feature, and how far beyond chance (in standard deviations) they hold it more often.
LEAST, LIFT = 5, 4
NEAR_BEST = 0.95
STEPS, RATE, DECAY, BETA, GAMMA = 400, 0.05, 1e-4, 0.0, 1.0


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and numbers of the features of each word, with repetitions."""
    low = LOWER[data]
    starts, ends, doc = word_bounds(low, offsets, ALNUM)
    out = [word_hashes(low, starts, ends)]
    docs = [doc]
    for n in BEGINNINGS:
        longer = ends - starts > n
        out.append(mixed(word_hashes(low, starts[longer], starts[longer] + n) + np.uint64(n)))
        docs.append(doc[longer])
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(32)).astype(np.uint32)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, positive, features): the distinct features of each text."""
    for rows, offsets, data in text_chunks(batches):
        doc, number = features(offsets, data)
        key = np.unique(doc << 32 | number)
        at = np.searchsorted(key, np.arange(len(offsets)) << 32)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(key.astype(np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["positive", "features"])


def counted(candidates: np.ndarray):
    """(feature, texts that hold it) of a task's rows, and their number as feature -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(1 << 16, bool)
        some[candidates >> np.uint32(16)] = True
        n, rows_seen = np.zeros(len(candidates), np.int64), 0
        for _, offsets, data in text_chunks(batches, column="text"):
            doc, number = features(offsets, data)
            hit = some[number >> np.uint32(16)]
            doc, number = doc[hit], number[hit]
            at = np.minimum(np.searchsorted(candidates, number), max(0, len(candidates) - 1))
            hit = candidates[at] == number if len(candidates) else np.zeros(0, bool)
            key = np.unique(doc[hit] * max(1, len(candidates)) + at[hit])
            n += np.bincount(key % max(1, len(candidates)), minlength=len(candidates))
            rows_seen += len(offsets) - 1
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int64()), pa.array([rows_seen, *n[held].tolist()], pa.int64())], names=["at", "n"])

    return run


def select(found: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features (sorted) that positives hold more often than unlabelled texts, beyond chance; sorted."""
    share = (in_p + in_u) / max(1, n_p + n_u)
    lift = (in_p / max(1, n_p) - in_u / max(1, n_u)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    best = np.flatnonzero(lift > LIFT)
    return np.sort(found[best[np.argsort(-lift[best], kind="stable")[:KEPT]]])


def train(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], prior: float, kept: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features kept (sorted) and bias, by non-negative PU learning with the sigmoid loss.

    texts: parts with the features of their texts, the text each belongs to, and which texts are positive.
    """
    positive = np.concatenate([np.zeros(0, bool), *(p for _, _, p in texts)])
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not len(kept) or not n_p or not n_u:
        return np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    columns, rows, first = [], [], 0
    for n, d, p in texts:
        at = np.minimum(np.searchsorted(kept, n), len(kept) - 1)
        hit = kept[at] == n
        columns.append(at[hit])
        rows.append(d[hit] + first)
        first += len(p)
    column, row = np.concatenate(columns), np.concatenate(rows)
    w, b = np.zeros(len(kept)), -1.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    scale = np.where(positive, 1 / n_p, 1 / n_u)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[column], len(positive)) + b
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = s * (1 - s)  # loss of label 1 is 1 - s, of label 0 is s
        negative = float((s * scale)[~positive].sum()) - prior * float((s * scale)[positive].sum())
        sign_p, sign_n = (1.0, 1.0) if negative >= -BETA else (0.0, -GAMMA)
        g = np.where(positive, -prior * sign_p - sign_n * prior, sign_n) * scale * slope
        grad = np.append(np.bincount(column, g[row], len(kept)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b) - boundary(np.bincount(row, w[column], len(positive)) + b, positive, prior)


def boundary(z: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """Where to part texts by z: as low as both of two tests allow.

    Unlabelled texts above are no more than the share that positives in them account for, so that none is thought to be
    negative; and the squared share of positives above over the share of unlabelled texts above, which stands in for
    the F measure, is within NEAR_BEST of its maximum.
    """
    at = np.unique(z)
    above = lambda x: 1 - np.searchsorted(np.sort(x), at, "left") / len(x)
    p, u = above(z[positive]), above(z[~positive])
    worth = p**2 / np.maximum(u, 1 / (~positive).sum())
    good = np.flatnonzero((u <= prior * p) & (worth >= NEAR_BEST * worth.max()))
    k = int(good[0]) if len(good) else int(np.argmax(worth))
    return float((at[k] + at[k - 1]) / 2) if k else float(at[0]) - 1.0


def train_rows(prior: float, kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for b in batches:
            n = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            positive = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            texts.append((b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.repeat(np.arange(len(n), dtype=np.int32), n), positive))
        w, bias = train(texts, prior, kept)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["weights", "bias"])

    return run


def fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from rows outside the held-out fold. The prior is the toxic share of the labelled rows there."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(fold() != HELD_OUT).where("toxic IS NOT NULL")
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.9, max(0.001, toxic / n)) if n else 0.05
    by = F.xxhash64(F.lit(5), "doc_id")
    p = known.where("toxic = 1").select("doc_id").distinct().orderBy(by, "doc_id").limit(positives).withColumn("positive", F.lit(True))
    u = docs.select("doc_id").where(fold() != HELD_OUT).orderBy(by, "doc_id").limit(unlabelled).distinct().withColumn("positive", F.lit(False))
    chosen = F.broadcast(p.unionByName(u))  # at most positives + unlabelled ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("positive", "text").mapInArrow(feature_rows, "positive boolean, features array<int>")
    rows = cut(rows, "features")
    # candidates: as many as the bounded sample of positives has
    held = rows.where("positive").select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).collect()
    found, in_p = np.array([r["f"] for r in held], np.int64).astype(np.uint32), np.array([r["n"] for r in held], np.int64)
    order = np.argsort(found)
    found, in_p = found[order], in_p[order]
    background = docs.where(fold() != HELD_OUT).select("text").mapInArrow(counted(found), "at long, n long")
    in_u, n_u = np.zeros(len(found), np.int64), 0
    for at, n in background.groupBy("at").agg(F.sum("n").alias("n")).collect():
        if at < 0:
            n_u = n
        else:
            in_u[at] = n
    kept = select(found, in_p, in_u, rows.where("positive").count(), n_u)
    model = rows.coalesce(1).mapInArrow(train_rows(prior, kept), "weights array<double>, bias double").first()
    return kept, np.array(model["weights"], np.float64), model["bias"]


def score_batches(kept: np.ndarray, weights: np.ndarray, bias: float, names: list[str], name: str):
    """Adds the score to the named columns."""
    some = np.zeros(1 << 16, bool)  # by the first bits: most features are none of those kept
    some[kept >> np.uint32(16)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, data in text_chunks(batches):
            doc, number = features(offsets, data)
            hit = some[number >> np.uint32(16)]
            doc, number = doc[hit], number[hit]
            z = np.full(len(offsets) - 1, bias)
            if len(kept):
                at = np.minimum(np.searchsorted(kept, number), len(kept) - 1)
                hit = kept[at] == number
                key = np.unique(doc[hit] * len(kept) + at[hit])
                z = z + np.bincount(key // len(kept), weights[key % len(kept)], len(offsets) - 1)
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(score)], names=[*names, name])

    return run


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "score", **bounds) -> DataFrame:
    """The columns `keep` of every row of docs, with the score (0 to 1) of the whole text as `name`.

    Null counts as empty; an empty text scores what no feature at all means. Labels of the held-out fold, and doc_id,
    lang and source, never enter a score. Repeated and null doc_ids are scored as any row. Without labels, every text
    scores the prior 0.05. Texts are read whole, of any length; an empty table gives no row.
    """
    from pyspark.sql import types as T

    model = fit(docs, labels, **bounds)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(score_batches(*model, list(keep), name), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold() == HELD_OUT, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
