"""Media columns: payloads in archives, written and read by ranges of bytes.

A payload is stored losslessly as an 8-bit greyscale PNG, 64 samples a row. Writers put the pictures into ZIP archives of
about ARCHIVE bytes in one folder, under names that no other attempt uses, and a manifest of the attempts that Spark took
names those that count. The data source `loom_archive` reads the manifest (or lists a folder that has none), plans partitions
over byte ranges of the archives, and its readers take the members that start in their range: they stream payload batches
through Arrow and fetch each member by its offset, again and by itself when a read or its checksum fails. All access goes
through pyarrow's file systems, so the folder may be in any store that these open.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import documents, new_path, until_exit

WIDTH = 64
ARCHIVE, RANGE, BATCH, TRIES = 32 << 20, 16 << 20, 4 << 20, 3
#: Partitions that a scan plans, about.
RANGES = 100_000
MANIFEST = "_manifest"
MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 5) -> bytes:
    """Payload padded with zeros to rows of 64 samples; its own length is kept in a private chunk."""
    samples = np.frombuffer(padded(payload), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"loNg", struct.pack(">Q", len(payload))) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """(samples, length before padding) of a picture made by encode_png; ValueError if it is damaged."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        found[kind] = found.get(kind, b"") + body
        at += 12 + n
    width, height = struct.unpack(">II", found[b"IHDR"][:8])
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are written here")
    return lines[:, 1:].tobytes(), struct.unpack(">Q", found[b"loNg"])[0]


def features(samples: bytes) -> str:
    """Sum, sum of squares, largest step between neighbours and number of distinct samples: exact integers."""
    a = np.frombuffer(samples, np.uint8).astype(np.int64)
    step = int(np.abs(np.diff(a)).max()) if len(a) > 1 else 0
    return f"sum={a.sum()};sq={(a * a).sum()};step={step};kinds={len(np.unique(a))}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> int:
    """Stores every row's text; returns the number of members.

    A task that runs again writes archives of its own, whatever order its rows come in; only those of the attempt whose
    rows Spark took are in the manifest, and the rest are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        here = TaskContext.get()
        out, done = None, []

        def close() -> None:
            out[1].close()
            size = out[0].tell()
            out[0].close()
            done.append((out[2], size, out[4]))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    name = f"part-{here.partitionId():07d}-{len(done):05d}-{here.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zip"
                    stream = store.open_output_stream(f"{root}/{name}")
                    out = [stream, zipfile.ZipFile(stream, "w"), name, 0, 0]
                picture = encode_png((text.as_py() or "").encode())
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # rows that repeat an id
                    out[1].writestr(zipfile.ZipInfo("null" if doc is None else str(doc)), picture)
                out[3] += len(picture)
                out[4] += 1
                if out[3] >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "bytes", "members"])

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    docs.select("doc_id", "text").mapInArrow(run, "archive string, bytes long, members long").write.parquet(f"{folder}/{MANIFEST}")
    until_exit(docs.sparkSession, folder)
    return sum(n for _, _, n in manifest(folder))


def manifest(folder: str) -> list[tuple[str, int, int]]:
    """(archive, bytes, members) of a folder's archives, by name; members are -1 where only a listing tells of them."""
    store, root = fs.FileSystem.from_uri(folder)
    listed = store.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True))
    parts = [x.path for x in listed if x.path.endswith(".parquet")]
    if parts:
        tables = [pq.read_table(store.open_input_file(p)) for p in parts]
        return sorted(row for t in tables for row in zip(*(t.column(c).to_pylist() for c in ("archive", "bytes", "members")), strict=True))
    found = store.get_file_info(fs.FileSelector(root))
    return sorted((x.base_name, x.size, -1) for x in found if x.path.endswith(".zip"))


class Range(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


def fetch(f, offset: int, n: int, crc: int) -> bytes:
    """A stored member by the offset of its local header."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member here")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(offset + 30 + name + extra)
    data = f.read(n)
    if len(data) != n or zlib.crc32(data) != crc:
        raise ValueError("checksum differs")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range, self.batch, self.tries = (int(options.get(k, d)) for k, d in (("rangebytes", RANGE), ("batchbytes", BATCH), ("tries", TRIES)))

    def partitions(self) -> list[Range]:
        """Byte ranges of all archives, longer ones where there would be more than RANGES of them."""
        _, root = fs.FileSystem.from_uri(self.folder)
        files = manifest(self.folder)
        step = max(self.range, -(-sum(n for _, n, _ in files) // RANGES))
        return [Range(f"{root}/{name}", at, min(at + step, n)) for name, n, _ in files for at in range(0, n, step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        rows: list[tuple] = []
        size = 0
        f = store.open_input_file(partition.path)
        with zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if partition.first <= m.header_offset < partition.end]
        for m in members:
            data, error, tries = None, None, 0
            while data is None and tries < self.tries:
                tries += 1
                try:
                    if f.closed:
                        f = store.open_input_file(partition.path)
                    data = fetch(f, m.header_offset, m.file_size, m.CRC)
                except (OSError, ValueError) as e:  # this member again, on a new handle
                    error = f"{type(e).__name__}: {e}"
                    f.close()
            rows.append((partition.path.rpartition("/")[2], m.filename, m.header_offset, data, None if data is not None else error, tries))
            size += len(data or b"")
            if size >= self.batch:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"archive": pa.string(), "member": pa.string(), "offset": pa.int64(), "payload": pa.binary(), "error": pa.string(), "tries": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class ArchiveSource(DataSource):
    """spark.read.format("loom_archive").load(folder); options rangeBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "loom_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, payload binary, error string, tries int"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for name, data, error in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            doc, data = None if name == "null" else int(name), data.as_py()
            if data is None:
                rows.append((doc, *[None] * 7, error))
                continue
            try:
                samples, n = decode_png(data)
            except (ValueError, KeyError, zlib.error, struct.error) as e:
                rows.append((doc, *[None] * 7, f"{type(e).__name__}: {e}"))
                continue
            rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features(samples), None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("loom_archive").options(**options).load(folder)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text and describes what is read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, error.

    Null counts as empty, which is 64 zeros. A member that can't be read after all tries, or isn't a picture, has its error
    and nulls otherwise, and the rest of its archive is read. Null and repeated doc_ids are members like others; a task
    holds a batch of payloads or the longest text. Other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "archives")
    write_archives(docs, folder)
    return read_archives(spark, folder).select("member", "payload", "error").mapInArrow(described, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
