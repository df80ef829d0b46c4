"""Repeated passages: which windows of WINDOW units (bytes or words) occur earlier elsewhere.

Windows are reached through anchors: a position whose GRAM units hash lowest in some window around it. Equal windows
hold the same anchor at the same offset, so nothing is lost and about 2 in WINDOW positions move instead of all.

1. Anchors' hashes go to shards by hash, once for each run of documents and hash; a shard tells the documents which of
   them occur more than once.
2. Each repeated anchor gives a piece: all windows that hold it. A run of documents keeps one copy of equal pieces, with
   its first place, and writes them by shard, along with where they occur, to the shared folder.
3. A shard combines the runs' pieces by the method of the operator (`Kind.solve`) and tells, for each run's piece
   and each window in it, whether it occurs before the run's first place: a bit.
4. Runs turn bits into removed intervals; what occurs in a run after the first place is removed in any case.

A passage that a third of all documents hold costs a shard one piece for each run, not one for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, input_bytes, partitions, text_chunks

#: Anchors of a run in step 1; pieces and bytes of text of a run in step 2, which ends with the document that exceeds them.
ANCHORS, PIECES, RUN_BYTES = 300_000, 100_000, 16 << 20
#: Bytes of input (as stored) for each shard: what a shard combines stays the same as the input grows.
SHARD_BYTES = 8 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; equal bytes of all numbers stand together, which small ones gain by."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        out += [np.array([len(a), a.itemsize], np.int64).tobytes(), raw.T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays, of these kinds; `u` alone is an unsigned integer of the size that was packed."""
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for kind in kinds:
        n, size = np.frombuffer(data, np.int64, 2, at).tolist()
        raw = np.frombuffer(data, np.uint8, n * size, at + 16).reshape(size, n)
        out.append(np.ascontiguousarray(raw.T).view(kind if kind != "u" else f"u{size}").ravel())
        at += 16 + n * size
    return out


def sliding(a: np.ndarray, w: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over each w neighbours a[i : i + w]."""
    m, have = a, 1
    while have * 2 <= w:
        m = take(m[:-have], m[have:])
        have *= 2
    return take(m[: len(m) - (w - have)], m[w - have :]) if have < w else m


@dataclass
class Chunk:
    """Units of some documents: hash of the gram at each (NONE where it would leave the document), first unit of each document."""

    grams: np.ndarray
    at: np.ndarray
    units: np.ndarray
    #: lowest hash in the window that starts at each unit, once anchors() has been called
    low: np.ndarray | None = None


class Kind:
    """What differs between bytes and words."""

    window: int
    gram: int
    #: whether a repetition within one document counts
    within: bool

    @property
    def left(self) -> int:
        return self.window - self.gram

    def chunk(self, offsets: np.ndarray, data: np.ndarray) -> Chunk:
        raise NotImplementedError

    def anchors(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Positions and documents of the anchors."""
        w = self.window - self.gram + 1
        if len(c.grams) < w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = c.low = sliding(c.grams, w, np.minimum)
        high = sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
        found = np.flatnonzero((high == c.grams) & (c.grams != NONE))
        doc = np.searchsorted(c.at, found, "right") - 1
        long_enough = (c.at[1:] - c.at[:-1])[doc] >= self.window
        return found[long_enough], doc[long_enough]

    def reach(self, c: Chunk, anchors: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units before the anchor, and from it on, that windows cover whose lowest hash is the anchor's; (-1, 0) if none are.

        Those windows start at neighbouring places. Where equal hashes share a window, it counts for each of them.
        """
        w = self.window - self.gram + 1
        start = anchors[:, None] - np.arange(w)
        inside = (start >= c.at[doc][:, None]) & (start + self.window <= c.at[doc + 1][:, None])
        own = inside & (c.low[np.clip(start, 0, len(c.low) - 1)] == c.grams[anchors][:, None])
        some = own.any(axis=1)
        return np.where(some, w - 1 - np.argmax(own[:, ::-1], axis=1), -1), np.where(some, self.window - np.argmax(own, axis=1), 0)

    def pieces(self, c: Chunk, anchors: np.ndarray, la: np.ndarray, ra: np.ndarray) -> np.ndarray:
        """A row for each anchor: the la units before it and ra units from it on, and these two numbers."""
        raise NotImplementedError

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Number of each row among the distinct ones, an example of each, and the distinct ones as bytes."""
        raise NotImplementedError

    def solve(self, runs: list[tuple[bytes, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For each run (pieces, document and position of the first place of each) a bit mask of each piece."""
        raise NotImplementedError

    def windows(self, la: np.ndarray, ra: np.ndarray) -> np.ndarray:
        """Bit o: the window that starts o units before the anchor lies in the document."""
        mask = np.zeros(len(la), np.uint64)
        for o in range(self.left + 1):
            mask |= ((la >= o) & (ra >= self.window - o)).astype(np.uint64) << np.uint64(o)
        return mask


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    d = doc.view(np.uint64)
    return ((d ^ d >> np.uint64(9) ^ d >> np.uint64(21)).view(np.int64) % buckets).astype(np.int64)


def bucket_column(doc: Column, buckets: int) -> Column:
    """The same of a column."""
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 9)).bitwiseXOR(F.shiftrightunsigned(doc, 21)), F.lit(buckets).cast("long"))


def told(doc: np.ndarray, value: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Buckets of documents, and for each a blob of what its documents are told."""
    bucket = bucket_of(doc, buckets)
    order = np.lexsort((doc, bucket))
    doc, value, bucket = doc[order], value[order], bucket[order]
    at = np.flatnonzero(np.concatenate([[True], np.diff(bucket) > 0])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(at, len(doc))[1:]
    return bucket[at].tolist(), [pack(steps(doc[a:b]), value[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]


def send_anchors(kind: Kind, shards: int, buckets: int):
    """Step 1 at the documents: (shard, blob). Shard -1 - bucket has what repeats within the run, for that bucket's documents."""

    def flush(h: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = (shard_of(h, shards).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        key, ids = key[order], ids[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        if kind.within:
            many = np.bincount(group) > 1
        else:
            first = ids[np.flatnonzero(new)]
            many = np.zeros(len(first), bool)
            many[group[ids != first[group]]] = True
        here = many[group]
        at, blobs = told(ids[here], (key[here] & np.uint64(0xFFFFFFFF)).astype(np.uint32), buckets)
        at = [-1 - k for k in at]
        one = new & ~here
        of = (key >> np.uint64(32)).astype(np.int64)
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        starts = new & here
        for s in np.unique(of):
            a, b = np.searchsorted(of, [s, s + 1])
            mine = one[a:b]
            names, nth = np.unique(ids[a:b][mine], return_inverse=True)
            at.append(int(s))
            blobs.append(pack(steps(low[a:b][mine]), names, nth.astype(np.uint32), steps(low[a:b][starts[a:b]])))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, n = [], [], 0
        for rows, offsets, data in text_chunks(batches):
            c = kind.chunk(offsets, data)
            at, doc = kind.anchors(c)
            hashes.append(c.grams[at])
            ids.append(rows.column(0).to_numpy(zero_copy_only=False)[doc])
            n += len(at)
            if n >= ANCHORS:
                yield from flush(np.concatenate(hashes), np.concatenate(ids))
                hashes, ids, n = [], [], 0
        if n:
            yield from flush(np.concatenate(hashes), np.concatenate(ids))

    return run


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, together for each value of it."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def repeated(buckets: int):
    """Step 1 at the shards: rows (shard, blob), sorted by shard, to (bucket, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_key(batches):
            if shard < 0:
                at, blobs = [-1 - shard] * len(rows), [r[1] for r in rows]
            else:
                parts = [unpack(r[1], "u4", "i8", "u4", "u4") for r in rows]
                for part in parts:
                    part[0], part[3] = np.cumsum(part[0], dtype=np.uint32), np.cumsum(part[3], dtype=np.uint32)
                every = np.concatenate([x for p in parts for x in (p[0], np.unique(p[3]))])
                value, count = np.unique(every, return_counts=True)
                often = value[count > 1]
                if not len(often):
                    continue
                docs, values = [], []
                for low, names, nth, _ in parts:
                    place = np.minimum(np.searchsorted(often, low), len(often) - 1)
                    hit = often[place] == low
                    docs.append(names[nth[hit]])
                    values.append(low[hit])
                at, blobs = told(np.concatenate(docs), np.concatenate(values), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first as it is; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def with_told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunks of the documents that were told something, and a test of (ids, values) for what they were told.

    Rows (doc_id, text, bucket, blob) are sorted by bucket, those with a blob first.
    """
    key, parts, known = None, [], None

    def wanted(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        d = np.searchsorted(known[0], ids)
        return np.isin(d.astype(np.uint64) << np.uint64(32) | values, known[1])

    for b in batches:
        bucket, is_blob = b.column(2).to_numpy(zero_copy_only=False), b.column(3).is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(is_blob.astype(np.int8)) != 0), [True]])) if len(bucket) else []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if bucket[a] != key:
                key, parts, known = bucket[a], [], None
            if is_blob[a]:
                parts += [unpack(x.as_py(), "i8", "u4") for x in b.column(3).slice(a, z - a)]
                continue
            if not parts:
                continue
            if known is None:
                ids = [np.cumsum(p[0]) for p in parts]
                names, nth = np.unique(np.concatenate(ids), return_inverse=True)
                known = names, np.unique(nth.astype(np.uint64) << np.uint64(32) | np.concatenate([p[1] for p in parts]))
            for rows, offsets, data in text_chunks(iter([b.slice(a, z - a).filter(pc.is_in(b.column(0).slice(a, z - a), pa.array(known[0])))])):
                yield rows, offsets, data, wanted


def make_runs(kind: Kind, shards: int):
    """Step 2: rows (run, shard, pieces, first_doc, first_at, places); shard -1 has the run's documents."""

    def flush(run: int, ids: np.ndarray, units: np.ndarray, rows: np.ndarray, doc: np.ndarray, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        out = [(run, -1, None, pack(ids, units))]
        of = shard_of(h, shards)
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if not len(part):
                continue
            nth, example, blob = kind.encode(rows[part])
            d, p = ids[doc[part]], at[part]
            by = np.lexsort((p, d, nth))
            first = by[np.flatnonzero(np.concatenate([[True], np.diff(nth[by]) > 0]))]
            la, ra = rows[part][example][:, -2].astype(np.int64), rows[part][example][:, -1].astype(np.int64)
            first_at = p[first].astype(np.int64) * kind.within  # else it is not asked for
            firsts = pack(d[first].astype(np.int64), first_at)
            places = pack(nth.astype(np.uint32), steps(doc[part].astype(np.int64)), steps(p.astype(np.int64)), kind.windows(la, ra), d[first].astype(np.int64), first_at)
            out.append((run, int(of[part[0]]), np.array([len(blob)], np.int64).tobytes() + blob + firsts, places))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["run", "shard", "pieces", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, pieces, size, docs = [], 0, 0, 0

        def flushed() -> pa.RecordBatch:
            ids, units, rows, doc, at, h = (np.concatenate(x) for x in zip(*held, strict=True))
            return flush(number, ids, units, rows, doc, at, h)

        for rows, offsets, data, wanted in with_told(batches):
            c = kind.chunk(offsets, data)
            at, doc = kind.anchors(c)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            hit = wanted(ids[doc], (c.grams[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            at, doc = at[hit], doc[hit]
            if len(at):
                la, ra = kind.reach(c, at, doc)
                hit = la >= 0
                at, doc, la, ra = at[hit], doc[hit], la[hit], ra[hit]
            else:
                la = ra = at
            held.append((ids, c.at[1:] - c.at[:-1], kind.pieces(c, at, la, ra), doc + docs, at - c.at[doc], c.grams[at]))
            pieces, size, docs = pieces + len(at), size + int(offsets[-1]), docs + len(offsets) - 1
            if pieces >= PIECES or size >= RUN_BYTES:
                yield flushed()
                number += 1
                held, pieces, size, docs = [], 0, 0, 0
        if held:
            yield flushed()

    return run


def solve_shards(kind: Kind):
    """Step 3: rows (shard, run, pieces) sorted by shard to (run, shard, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_key(batches):
            runs = []
            for _, _, data in rows:
                end = 8 + int(np.frombuffer(data, np.int64, 1)[0])
                runs.append((data[8:end], *unpack(data[end:], "i8", "i8")))
            bits = kind.solve(runs)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array([pack(b.astype(np.uint64)) for b in bits], pa.binary())], names=["run", "shard", "bits"])

    return run


def removed(kind: Kind):
    """Step 4: rows (run, shard, places, bits) sorted by run to (doc_id, spans); spans: starts and ends in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            bits = {r[1]: unpack(r[3], "u8")[0] for r in rows if r[3] is not None}
            ids, units = unpack(next(r[2] for r in rows if r[1] == -1), "i8", "i8")
            base = np.concatenate([[0], np.cumsum(units)])
            flags = np.zeros(int(base[-1]) + 1, bool)
            for _, shard, places, _ in rows:
                if shard == -1 or places is None:
                    continue
                nth, doc, at, valid, first_doc, first_at = unpack(places, "u4", "i8", "i8", "u8", "i8", "i8")
                doc, at = np.cumsum(doc), np.cumsum(at)
                later = ids[doc] > first_doc[nth]
                if kind.within:
                    later |= (ids[doc] == first_doc[nth]) & (at > first_at[nth])
                mask = np.where(later, valid[nth], bits[shard][nth] & valid[nth])
                start = base[doc] + at
                for o in range(kind.left + 1):
                    flags[start[(mask >> np.uint64(o) & np.uint64(1)).astype(bool)] - o] = True
            found = np.flatnonzero(flags)
            if not len(found):
                continue
            doc = np.searchsorted(base, found, "right") - 1
            new = np.concatenate([[True], (np.diff(found) > kind.window) | (np.diff(doc) > 0)])
            starts = found[new]
            ends = found[np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)] + kind.window
            doc = doc[new]
            spans = np.stack([starts - base[doc], ends - base[doc]], 1)
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(doc) > 0]))
            ids_out = ids[doc[cuts]]
            blobs = [s.astype("<i8").tobytes() for s in np.split(spans, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "spans"])

    return run


def _runs(docs: DataFrame, kind: Kind, shards: int) -> DataFrame:
    """Steps 1 and 2: (run, shard, pieces, places)."""
    buckets = 2 * shards
    sent = docs.mapInArrow(send_anchors(kind, shards, buckets), "shard long, blob binary")
    sent = sent.repartition(shards, "shard").sortWithinPartitions("shard")
    values = sent.mapInArrow(repeated(buckets), "bucket long, blob binary")
    rows = docs.select("doc_id", "text", bucket_column(F.col("doc_id"), buckets).alias("bucket"), F.lit(None).cast("binary").alias("blob"))
    rows = rows.unionByName(values, allowMissingColumns=True).repartition(shards, "bucket")
    rows = rows.sortWithinPartitions("bucket", F.col("blob").isNull()).select("doc_id", "text", "bucket", "blob")
    return rows.mapInArrow(make_runs(kind, shards), "run long, shard long, pieces binary, places binary")


def removed_spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, spans) of the documents that lose something; spans are pairs of int64, in order, not touching.

    Rows without doc_id take no part. Rows that repeat a doc_id are one document, whose spans are those of all of them.
    There are at least as many shards as the session's shuffle partitions, and one for each SHARD_BYTES of input.
    """
    shards = max(partitions(docs.sparkSession), -(-input_bytes(docs) // SHARD_BYTES))
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = cut(_runs(docs, kind, shards), "runs", release=True)
    pieces = runs.where("shard >= 0").select("shard", "run", "pieces").repartition(shards, "shard").sortWithinPartitions("shard")
    bits = pieces.mapInArrow(solve_shards(kind), "run long, shard long, bits binary")
    both = runs.select("run", "shard", "places", F.lit(None).cast("binary").alias("bits")).unionByName(bits.withColumn("places", F.lit(None).cast("binary")))
    both = both.repartition(shards, "run").sortWithinPartitions("run")
    spans = cut(both.mapInArrow(removed(kind), "doc_id long, spans binary"), "spans", release=True)
    drop(runs)
    # rows that repeat a doc_id may lie in two runs; joins with the documents are merged alike at every size
    return spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")).hint("merge")


def spans_of(value) -> np.ndarray:
    """The spans of a document, (n, 2), merged over its rows."""
    if not value:
        return np.zeros((0, 2), np.int64)
    parts = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in value]
    if len(parts) == 1:
        return parts[0]
    every = np.concatenate(parts)
    every = every[np.argsort(every[:, 0], kind="stable")]
    ends = np.maximum.accumulate(every[:, 1])
    new = np.concatenate([[True], every[1:, 0] > ends[:-1]])
    return np.stack([every[new, 0], ends[np.append(np.flatnonzero(new)[1:] - 1, len(every) - 1)]], 1)
