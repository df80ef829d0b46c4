"""Suffix-array dedup by a distributed, common-prefix-aware merge sort.

The suffixes sorted are those that start at anchors (see `passages`), each cut to one window and followed by what stands
before the anchor, backwards. Runs of documents sort their own and exchange them front-coded: the length of the prefix
shared with the one before, and the rest. A shard merges its runs with a loser tree whose entries carry how much
they share with the last string put out: of two entries, the one that shares more is smaller without a look at
the strings, and where both share the same, comparison starts after it. The merge yields the common prefixes of
neighbours, hence, for each window offset, groups of suffixes that agree to the right; ranks of the left parts split
these into groups of equal windows, whose smallest document is what decides.

Whole suffixes of documents are never sorted: nothing depends on what lies beyond a window, and a window is found at
every anchor that it holds, so the sparse sort loses no match and moves 2 in 36 positions instead of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .passages import NONE, Chunk, Kind, pack, removed_spans, spans_of, unpack
from .texthash import mixed

MOST = np.iinfo(np.int64).max


class BytesChunk(Chunk):
    data: np.ndarray


class LoserTree:
    """Merges sorted runs of strings of one length; lcps[r][i] is what strings[r][i] shares with the one before it."""

    def __init__(self, strings: list[list[bytes]], lcps: list[list[int]], width: int):
        self.strings, self.lcps, self.width = strings, lcps, width
        self.at = [0] * len(strings)
        self.head: list[bytes | None] = [s[0] if s else None for s in strings]
        self.shared = [0] * len(strings)
        self.n = 1
        while self.n < max(1, len(strings)):
            self.n *= 2
        self.head += [None] * (self.n - len(strings))
        self.shared += [0] * (self.n - len(strings))
        self.losers = [0] * self.n
        winners = list(range(self.n))
        first = self.n
        while first > 1:
            first //= 2
            winners = [self._play(first + i, winners[2 * i], winners[2 * i + 1]) for i in range(first)]
        self.best = winners[0]

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at the node and then shares with the winner what is noted."""
        head, shared = self.head, self.shared
        x, y = head[a], head[b]
        if x is None:
            a, b = b, a
        elif y is not None:
            n = shared[a]
            if n < shared[b]:
                a, b = b, a
            elif n == shared[b]:
                p, q = x[n:], y[n:]
                if p == q:
                    n = self.width
                else:
                    if p > q:
                        a, b = b, a
                    while x[n] == y[n]:
                        n += 1
                shared[b] = n
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(run, string, what it shares with the one before), in order."""
        head, shared, at, losers, n = self.head, self.shared, self.at, self.losers, self.n
        best = self.best
        while (top := head[best]) is not None:
            yield best, top, shared[best]
            at[best] += 1
            i, run = at[best], self.strings[best]
            if i < len(run):
                head[best], shared[best] = run[i], self.lcps[best][i]
            else:
                head[best] = None
            node = (n + best) // 2
            while node:
                best = self._play(node, best, losers[node])
                node //= 2


def front_coded(rows: np.ndarray) -> bytes:
    """Sorted distinct rows of bytes as shared prefixes and rests."""
    differs = rows[1:] != rows[:-1]
    shared = np.concatenate([[0], np.argmax(differs, axis=1)]).astype(np.uint8)
    return pack(shared, rows[np.arange(rows.shape[1]) >= shared[:, None]])


def decoded(blob: bytes, width: int) -> tuple[list[bytes], list[int]]:
    shared, rest = unpack(blob, "u1", "u1")
    rest, out, before, at = rest.tobytes(), [], b"", 0
    shared = shared.tolist()
    for n in shared:
        to = at + width - n
        before = before[:n] + rest[at:to]
        out.append(before)
        at = to
    return out, shared


class Bytes(Kind):
    within = False

    def __init__(self, window: int = 50, gram: int = 16):
        if not 16 <= gram <= window < 64:
            raise ValueError("grams are 16 bytes here, and a window has less than 64")
        self.window, self.gram = window, gram
        self.width = window + self.left + 2

    def chunk(self, offsets: np.ndarray, data: np.ndarray) -> BytesChunk:
        grams = np.full(len(data), NONE)
        n = len(data) - self.gram + 1
        if n > 0:
            eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
            h = mixed(mixed(eight[:n]) * np.uint64(0x9E3779B97F4A7C15) + eight[8 : 8 + n])
            h[h == NONE] = 0
            grams[:n] = h
            last = np.maximum(offsets[1:, None] - np.arange(1, self.gram), offsets[:-1, None]).ravel()
            short = np.repeat(offsets[1:] > offsets[:-1], self.gram - 1)
            keep = np.repeat(offsets[1:] - offsets[:-1] >= self.gram, self.gram - 1)
            grams[last[short & keep]] = NONE
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a < self.gram:
                    grams[a:b] = NONE
        c = BytesChunk(grams, offsets, offsets[1:] - offsets[:-1])
        c.data = data
        return c

    def pieces(self, c: BytesChunk, anchors: np.ndarray, la: np.ndarray, ra: np.ndarray) -> np.ndarray:
        out = np.zeros((len(anchors), self.width), np.uint8)
        if not len(anchors):
            return out
        right, left = np.arange(self.window), np.arange(self.left)
        out[:, : self.window] = np.where(right < ra[:, None], c.data[np.minimum(anchors[:, None] + right, len(c.data) - 1)], 0)
        out[:, self.window : -2] = np.where(left < la[:, None], c.data[np.maximum(anchors[:, None] - 1 - left, 0)], 0)
        out[:, -2], out[:, -1] = la, ra
        return out

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        # the last byte is never 0, so numpy's comparison, which ignores trailing zeros, is exact
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{self.width}").ravel(), kind="stable")
        s = rows[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])
        nth = np.empty(len(rows), np.int64)
        nth[order] = np.cumsum(new) - 1
        return nth, order[new], front_coded(s[new])

    def solve(self, runs: list[tuple[bytes, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        strings, lcps = zip(*(decoded(r[0], self.width) for r in runs), strict=True)
        of: list[list[int]] = [[] for _ in runs]
        merged, shared = [], []
        for run, string, n in LoserTree(list(strings), list(lcps), self.width):
            if not merged or n < self.width:
                merged.append(string)
                shared.append(n)
            of[run].append(len(merged) - 1)
        rows = np.frombuffer(b"".join(merged), np.uint8).reshape(-1, self.width)
        shared_, n = np.array(shared, np.int64), len(rows)
        entry, doc = np.concatenate([np.array(x, np.int64) for x in of]), np.concatenate([r[1] for r in runs])
        first = np.full(n, MOST)
        np.minimum.at(first, entry, doc)
        la, ra = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
        left = np.ascontiguousarray(rows[:, self.window : -2])
        # left parts end in zeros behind la bytes; only offsets within la are asked for
        if self.left:
            order = np.argsort(left.view(f"S{self.left}").ravel(), kind="stable")
            differs = left[order][1:] != left[order][:-1]
            agree = np.concatenate([[0], np.where(differs.any(axis=1), np.argmax(differs, axis=1), self.left)])
        bits = np.zeros(len(entry), np.uint64)
        for o in range(self.left + 1):
            valid = np.flatnonzero((la >= o) & (ra >= self.window - o))
            if not len(valid):
                continue
            key = np.cumsum(shared_ < self.window - o) * np.int64(n + 1)
            if o:
                part = np.empty(n, np.int64)
                part[order] = np.cumsum(agree < o)
                key = key + part
            key = key[valid]
            by = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
            least = np.full(n, MOST)
            least[valid[by]] = np.repeat(np.minimum.reduceat(first[valid[by]], at), np.diff(np.append(at, len(by))))
            bits |= (least[entry] < doc).astype(np.uint64) << np.uint64(o)
        return np.split(bits, np.cumsum([len(x) for x in of])[:-1])


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    ends = np.concatenate([[0], spans[:, 1]]).tolist()
    starts = np.append(spans[:, 0], len(text)).tolist()
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def cut_out(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data, s = (text.as_py() or "").encode(), spans_of(spans.as_py())
                kept = kept_bytes(data, s)
                rows.append((doc, len(data), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs, and the kept bytes if asked for.

    Each byte covered by a string of `window` bytes that also starts in a document with a smaller doc_id is removed;
    strings are judged on the input, and matches don't cross documents. Null counts as empty. A row without doc_id is
    kept whole and removes nothing; rows that repeat a doc_id are one document and remove nothing from each other. A
    task holds one shard's pieces, or the longest text. Other columns are ignored; an empty table gives no row.
    """
    spans = removed_spans(docs, Bytes(window))
    rows = docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut_out(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.s = w.s WHERE f.m < w.doc_id),
n AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
k AS (SELECT doc_id, a AS upto, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS start FROM p
      UNION ALL SELECT doc_id, NULL, max(b) FROM p GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (coalesce(upto, length(h) // 2) - start)), '' ORDER BY start) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
x AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
"""
