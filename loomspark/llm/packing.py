"""Packing by minimum bin slack.

Documents are tokenised where they lie and cut into full windows and one remainder each. Only the histogram of the
remainders' lengths (one number for each length below the window) reaches the driver. There, for each kind of window, a
subset-sum dynamic program over a bitset finds the multiset of lengths that comes closest to the capacity; backtracking
gives its counts, and the window is repeated as often as the histogram allows, so the plan has a few thousand entries
for any number of documents. Pieces then find their sequence from their length and their rank among equal lengths, a
gapless number that no task needs the whole group for.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, text_chunks
from .texthash import chunk_hashes, word_bounds, word_chunks

WINDOW, END = 2048, 1
#: Distinct words that a worker keeps the ids of; more, and it starts anew. Longer words than KEPT_LENGTH bytes aren't kept.
KEPT_WORDS, KEPT_LENGTH = 1_500_000, 256
#: Pieces handed on at once, of at most a window each.
ROWS = 500
#: What surely parts words for the tokenizer.
NOT_GAP = np.ones(256, bool)
NOT_GAP[[0x20, 0x09, 0x0A, 0x0D]] = False


class WordIds:
    """Ids of the words between gaps, by a tokenizer that never joins across them.

    Words are looked up by 64-bit hashes, in sorted arrays, and compared byte by byte with the word kept there: one of
    another spelling goes to the tokenizer itself. Else the tokenizer sees each word once in a worker's life.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self._reset()

    def _reset(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: of each word: ids' place and number, bytes' place (in numbers of eight) and length
        self.words = np.zeros((1 << 16, 4), np.int32)
        self.flat, self.used = np.zeros(1 << 17, np.uint32), 0
        self.bytes, self.filled = np.zeros(1 << 17, np.uint64), 0

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return n, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum()))

    @staticmethod
    def _put(store: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        while used + len(new) > len(store):
            store = np.concatenate([store, np.zeros_like(store)])
        store[used : used + len(new)] = new
        return store

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n, new = self._ids([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        chunks, at = word_chunks(data, starts, ends)
        rows = np.stack([self.used + np.cumsum(n) - n, n, self.filled + at[:-1], ends - starts], 1)
        first = len(self.keys)
        self.words = self._put(self.words, first, rows)
        self.flat, self.used = self._put(self.flat, self.used, new), self.used + len(new)
        self.bytes, self.filled = self._put(self.bytes, self.filled, chunks), self.filled + len(chunks)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.codes = np.insert(self.codes, where, np.arange(first, first + len(n), dtype=np.int32))

    def _kept(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of self.words for the words, and which of the words they really are."""
        if not len(starts):
            return self.words[:0], np.zeros(0, bool)
        chunks, at = word_chunks(data, starts, ends)
        keys, example, which = np.unique(chunk_hashes(chunks, at, ends - starts), return_index=True, return_inverse=True)
        if len(self.keys) > self.kept:
            self._reset()
        where = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[where] != keys
        new[where == len(self.keys)] = True
        if new.any():
            self._learn(keys[new], data, starts[example[new]], ends[example[new]])
            where = np.searchsorted(self.keys, keys)
        rows = self.words[self.codes[where][which]]
        place = np.repeat(rows[:, 2].astype(np.int64) - at[:-1], np.diff(at)) + np.arange(at[-1])
        same = np.logical_and.reduceat(self.bytes[np.minimum(place, self.filled - 1)] == chunks, at[:-1])
        return rows, same & (rows[:, 3] == ends - starts)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin and end."""
        starts, ends, doc = word_bounds(data, offsets, NOT_GAP)
        place, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(ends - starts <= KEPT_LENGTH)
        own = ends - starts > KEPT_LENGTH
        rows, same = self._kept(data, starts[short], ends[short])
        place[short], n[short] = rows[:, 0], rows[:, 1]
        own[short[~same]] = True
        flat = self.flat
        if own.any():
            n[own], more = self._ids([data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            place[own] = self.used + np.cumsum(n[own]) - n[own]
            flat = np.concatenate([flat[: self.used], more])
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(place - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(doc, np.arange(len(offsets)))]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, nth long"


def pieces(path: str, window: int):
    """Pieces of documents, with the task and the number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = word_ids(path), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for b, offsets, data in text_chunks(batches):
            every, at = words.encode(offsets, data)
            for doc, a, z in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = np.append(every[a:z], np.uint32(END)).astype("<u4", copy=False)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    rows.append((doc, start, n, piece.tobytes(), len(ids), part, int(seen[n])))
                    seen[n] += 1
                    if len(rows) >= ROWS:
                        yield batch()
        if rows:
            yield batch()

    return run


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, by counts, whose sum comes closest to capacity from below; it holds the largest length."""
    largest = max(counts)
    need, room = {largest: 1}, capacity - largest
    left = counts | {largest: counts[largest] - 1}
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in left.items() if n and x <= room), reverse=True):
        n, k = min(left[length], room // length), 1
        while n:  # binary splitting of the count
            k = min(k, n)
            steps.append((length, k, reach))
            reach = (reach | reach << (length * k)) & mask
            n, k = n - k, k * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            need[length] = need.get(length, 0) + k
    return need


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length rows (first rank, count in a window, first sequence, offset), by rank."""
    left, ranks, out, sequence = {k: n for k, n in histogram.items() if n}, dict.fromkeys(histogram, 0), {k: [] for k in histogram}, 0
    while left:
        need = fill(left, capacity)
        times = min(left[k] // n for k, n in need.items())
        offset = 0
        for k in sorted(need, reverse=True):
            out[k].append((ranks[k], need[k], sequence, offset))
            ranks[k] += need[k] * times
            offset += k * need[k]
            left[k] -= need[k] * times
            if not left[k]:
                del left[k]
        sequence += times
    return {k: np.array(v, np.int64).reshape(-1, 4) for k, v in out.items()}


PLAN = "length long, entries array<struct<rank: long, count: long, sequence: long, offset: long>>"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset; ids are little-endian 32-bit numbers.

    tokenizer: path of a `tokenizers` file whose pieces never span a space or newline. A null or empty text is the id 1
    alone; a text of any length is cut into windows. Repeated and null doc_ids are packed as any row. Other columns are
    ignored, and an empty table gives no piece.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    t = cut(docs.select("doc_id", "text").mapInArrow(pieces(str(tokenizer), window), PIECES), "pieces")
    counts = cut(t.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a table of its own: its size is known, and Spark broadcasts it as long as it is small, so that ids stay where they are
    first = cut(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    entries = [(k, [tuple(map(int, e)) for e in v]) for k, v in plan(histogram, window).items()]
    found = t.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    # a row for each length below the window, with its share of at most `window` kinds of sequences: bounded, whatever the input
    found = found.join(F.broadcast(spark.createDataFrame(entries, PLAN)), "length")
    entry = F.element_at(F.filter("entries", lambda e: e["rank"] <= F.col("rank")), -1)
    since = F.col("rank") - F.col("e.rank")
    found = found.withColumn("e", entry).withColumn("sequence_id", F.col("e.sequence") + F.floor(since / F.col("e.count")))
    found = found.withColumn("offset", F.col("e.offset") + since % F.col("e.count") * F.col("length"))
    return found.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
