"""Substring dedup with compressed FM-indexes of the pieces of each shard.

Shards hold the pieces of text around repeated anchors (see `passages`), each distinct piece once. A shard's pieces are split
by their anchor into groups of about 5,000, and each group has an index: the pieces, as symbols for words, are
concatenated; their suffixes are sorted by doubling, and what stays is the Burrows-Wheeler transform as a wavelet matrix of
packed bits with block counts, and every SAMPLE-th place of the suffix array. The documents' windows stream
through the index that has their anchor: backward search extends all of them at once, a symbol a step from their last word, as
long as more than one place is left. The lengths so reached are the windows' matching statistics: how many words from
the window's end occur elsewhere. Those at the threshold, a whole window, are reported with their interval, whose places are
located by steps along the transform to the next sampled one; the earliest decides.

Windows are routed by anchors and not sent to every shard: a window that occurs in two documents has the same anchor in
both, so no other index could hold it, and a document is read by as many indexes as it has repeated anchors instead of
by all. Equal pieces within one run of documents are told by a sort before any index sees them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .passages import NONE, Chunk, Kind, pack, removed_spans, spans_of, unpack
from .texthash import NOT_SPACE, mixed, shingle_hashes, word_bounds, word_hashes


class WaveletMatrix:
    """Rank over a sequence of small integers, one packed bit vector with block counts for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        s = sequence
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (s >> shift & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
            blocks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32)
            self.levels.append((shift, words, blocks, len(s) - int(bits.sum())))
            s = np.concatenate([s[~bits], s[bits]])
        self.start = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, words, blocks, zeros in self.levels:
            word = at >> 6
            ones = blocks[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros(len(at), np.int64)
        for shift, words, blocks, zeros in self.levels:
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = blocks[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            one = (words[word] >> bit & np.uint64(1)).astype(bool)
            out |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position."""
        return self._walk(symbol, at) - self.start[symbol]


def sorted_suffixes(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of text in the order of the suffixes that start there; the last symbol is the smallest and occurs once."""
    n, bits = len(text), max(1, int(symbols - 1).bit_length())
    have = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(have, text.dtype)])
    for i in range(have):
        key = key << bits | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        k = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], k[1:] != k[:-1]]))
        if rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = rank[have:]
        key, have = rank * np.int64(n + 1) + after, have * 2


class FMIndex:
    """An index of a text that ends in its smallest symbol, which occurs once, by its Burrows-Wheeler transform.

    Of the suffix array only the places that are multiples of SAMPLE stay, found by the rank of packed bits.
    """

    SAMPLE = 8

    def __init__(self, text: np.ndarray, symbols: int):
        places = sorted_suffixes(text, symbols)
        self.n = len(text)
        self.bwt = WaveletMatrix(text[places - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        sampled = places % self.SAMPLE == 0
        packed = np.packbits(sampled, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
        self.blocks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.places = places[sampled].astype(np.int32 if len(text) < 1 << 31 else np.int64)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, now = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            word, bit = now >> 6, (now & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            nth = self.blocks[word[hit]] + np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.places[nth] + steps[left[hit]]
            left, now = left[~hit], now[~hit]
            if len(left):
                symbol = self.bwt.access(now)
                now = self.before[symbol] + self.bwt.rank(symbol, now)
                steps[left] += 1
        return out

    def search(self, patterns, count: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the queries, capped at `length`, and the interval of each at the length it reached.

        patterns(queries, i) gives the i-th symbol of each query, from 0; a query's statistic is the length of its
        longest end that occurs more than once.
        """
        reached = np.zeros(count, np.int64)
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        q = np.arange(count)
        for i in range(length - 1, -1, -1):
            c = patterns(q, i)
            if i == length - 1:
                a, b = self.before[c], self.before[c + 1]
            else:
                both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([low[q], high[q]]))
                a, b = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            more = b - a > 1
            q = q[more]
            if not len(q):
                break
            low[q], high[q], reached[q] = a[more], b[more], length - i
        return reached, low, high


class WordsChunk(Chunk):
    words: np.ndarray


class Words(Kind):
    within = True
    #: pieces of an index, about
    block = 5000

    def __init__(self, window: int = 20, gram: int = 5):
        if not 1 <= gram <= window < 64:
            raise ValueError("a window has less than 64 words")
        self.window, self.gram = window, gram

    def chunk(self, offsets: np.ndarray, data: np.ndarray) -> WordsChunk:
        starts, ends, doc = word_bounds(data, offsets, NOT_SPACE)
        words = word_hashes(data, starts, ends)
        words[words == 0] = 1
        grams = np.full(len(words), NONE)
        n = len(words) - self.gram + 1
        if n > 0:
            h = shingle_hashes(words, self.gram)
            h[h == NONE] = 0
            grams[:n] = np.where(doc[:n] == doc[self.gram - 1 :], h, NONE)
        at = np.searchsorted(doc, np.arange(len(offsets)))
        c = WordsChunk(grams, at, at[1:] - at[:-1])
        c.words = words
        return c

    def pieces(self, c: WordsChunk, anchors: np.ndarray, la: np.ndarray, ra: np.ndarray) -> np.ndarray:
        width = self.left + self.window
        out = np.zeros((len(anchors), width + 2), np.uint64)
        if not len(anchors):
            return out
        place = np.arange(-self.left, self.window)
        inside = (place >= -la[:, None]) & (place < ra[:, None])
        out[:, :width] = np.where(inside, c.words[np.clip(anchors[:, None] + place, 0, len(c.words) - 1)], 0)
        out[:, -2], out[:, -1] = la, ra
        return out

    def earliest(self, rows: np.ndarray, la: np.ndarray, ra: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Earliest place of each piece's windows, by offset, among all of the index."""
        width = self.left + self.window
        names, symbols = np.unique(np.append(rows.ravel(), 0), return_inverse=True)  # 0 stands outside of pieces
        rows = symbols[:-1].reshape(rows.shape).astype(np.int32) + 1
        text = np.ones((len(rows), width + 1), np.int32)
        text[:, :width] = rows
        index = FMIndex(np.append(text.ravel(), np.int32(0)), len(names) + 1)
        offsets = np.arange(self.left + 1)
        row, offset = np.nonzero((la[:, None] >= offsets) & (ra[:, None] >= self.window - offsets))
        reached, low, high = index.search(lambda q, i: rows[row[q], self.left - offset[q] + i], len(row), self.window)
        out = first[:, None] - offsets  # of a window that is in no other piece
        q = np.flatnonzero(reached == self.window)
        if len(q):
            lows, which, inverse = np.unique(low[q], return_index=True, return_inverse=True)
            wide = high[q][which] - lows
            ends = np.cumsum(wide)
            piece, at = np.divmod(index.locate(np.repeat(lows - ends + wide, wide) + np.arange(ends[-1])), width + 1)
            # places in the documents; what an interval holds starts within a document
            out[row[q], offset[q]] = np.minimum.reduceat(first[piece] - self.left + at, ends - wide)[inverse]
        return out

    @staticmethod
    def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row among the distinct ones and an example of each, compared in full."""
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = mixed(h + rows[:, j].astype(np.uint64))
        order = np.argsort(h, kind="stable")
        s = rows[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])
        nth = np.empty(len(rows), np.int64)
        nth[order] = np.cumsum(new) - 1
        return nth, order[new]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        nth, example = self.distinct(rows)
        kept = rows[example]
        names, codes = np.unique(kept[:, :-2], return_inverse=True)
        codes = codes.ravel().astype(np.uint16 if len(names) < 1 << 16 else np.uint32)
        return nth, example, pack(names, codes, kept[:, -2].astype(np.uint8), kept[:, -1].astype(np.uint8))

    def solve(self, runs: list[tuple[bytes, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        width, parts = self.left + self.window, []
        for blob, _, _ in runs:
            parts.append(unpack(blob, "u8", "u", "u1", "u1"))
        names = np.unique(np.concatenate([np.zeros(1, np.uint64), *(p[0] for p in parts)]))  # 0 is what stands outside
        rows = np.concatenate([np.searchsorted(names, p[0])[p[1]].reshape(-1, width) for p in parts]).astype(np.int32)
        entry, example = self.distinct(rows)
        la, ra = (np.concatenate([p[i] for p in parts]).astype(np.int64)[example] for i in (2, 3))
        rows = rows[example]
        ids, doc = np.unique(np.concatenate([r[1] for r in runs]), return_inverse=True)
        at = np.concatenate([r[2] for r in runs])
        own = (doc.astype(np.int64) << 40) | at  # an anchor's place, in order
        first = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(first, entry, own)

        # only pieces of one anchor share windows: small indexes, each of some anchors, stay in a processor's cache
        group = np.zeros(len(rows), np.uint64)
        for k in range(self.left, self.left + self.gram):
            group = mixed(group + rows[:, k].astype(np.uint64))
        group = (group % np.uint64(len(rows) // self.block + 1)).astype(np.int64)
        least = np.zeros((len(rows), self.left + 1), np.int64)
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            least[part] = self.earliest(rows[part], la[part], ra[part], first[part])
        bits = np.zeros(len(entry), np.uint64)
        for o in range(self.left + 1):
            bits |= (least[entry, o] < own - o).astype(np.uint64) << np.uint64(o)
        return np.split(bits, np.cumsum([len(r[1]) for r in runs])[:-1])


def cut_out(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words, s = (text.as_py() or "").encode().split(), spans_of(spans.as_py())
                n, gone = len(words), int((s[:, 1] - s[:, 0]).sum())
                if len(s):
                    between = zip([0, *s[:, 1].tolist()], [*s[:, 0].tolist(), n], strict=True)
                    words = [w for a, b in between for w in words[a:b]]
                kept = b" ".join(words)
                rows.append((doc, n, gone, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            if rows:
                kinds, names = [pa.int64()] * 3 + [pa.string(), pa.binary()], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    return run


def window_dedup(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs, and the kept words if asked for.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; null text has none. Each word covered by a window of `window` words whose
    sequence also starts earlier (in a smaller doc_id, or in the same document before) is removed; windows are
    judged on the input. Words are told apart by 64-bit hashes of all their bytes. A row without doc_id is kept whole and
    removes nothing; rows that repeat a doc_id are one document. A task holds one shard's pieces, or the longest text. Other
    columns are ignored; an empty table gives no row.
    """
    spans = removed_spans(docs, Words(window))
    rows = docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut_out(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM documents),
w AS (SELECT doc_id, i, array_to_string(v[i + 1:i + 20], ' ') AS s FROM (SELECT doc_id, v, unnest(range(0, len(v) - 19)) AS i FROM d)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w),
r AS (SELECT doc_id, i FROM o WHERE nth > 1),
n AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 20 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 20 AS b FROM g GROUP BY doc_id, k),
k AS (SELECT doc_id, a AS upto, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS start FROM p
      UNION ALL SELECT doc_id, NULL, max(b) FROM p GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(array_to_string(v[start + 1:coalesce(upto, len(v))], ' '), ' ' ORDER BY start) FILTER (coalesce(upto, len(v)) > start) AS kept
      FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
x AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed FROM p GROUP BY doc_id)
SELECT d.doc_id, len(v) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(CASE WHEN x.doc_id IS NULL THEN array_to_string(v, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
"""
