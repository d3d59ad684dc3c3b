"""Media columns: content-addressed payloads in tar shards.

Each payload is stored as an 8-bit grey PNG of a fixed width, named by the
SHA-256 of its bytes, in a tar shard of the task that holds the row; rows carry
digest, shard, offset and length.  A second pass fills the metadata columns by a
range read of the image's first 33 bytes, and the features by one of the whole
member.  Equal payloads of a shard share one member.

No stage shuffles.  The first pass has a side effect, so its rows are a written
table in the shared folder; a task that runs again writes shards under new
names, and its rows point to those.  Shards close at ``shard_mb``, so a task
holds one payload and one open file whatever its input.  A reader caches its
last members only, by bytes.

Defined results: a null text is empty and becomes one row of padding; equal
texts give equal values wherever they are stored; an empty table gives an empty
index and no shard; repeated rows have an index row each; other columns are
dropped, so clashing names are harmless.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir

WIDTH = 192
STRETCH = 16 << 20  # bytes of a shard that one task reads back
PNG = b"\x89PNG\r\n\x1a\n"

INDEX = "doc_id {id}, n_bytes long, digest string, shard string, offset long, length long"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    return data + b" " * (max(1, -(-len(data) // unit)) * unit - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """An 8-bit grey PNG whose samples are the payload; filter 0 on each row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int]:
    """Width and height from the first 33 bytes."""
    if data[:8] != PNG or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("not the header of a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    return width, height


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG of the kind above; checks every chunk."""
    width, height = png_header(data)
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a row filter that isn't written here")
    return raw[:, 1:].tobytes()


def feature(samples: bytes, width: int, height: int) -> str:
    """Size, mean, deviation and an 8x8 average hash of the image."""
    x = np.frombuffer(samples, np.uint8).reshape(height, width).astype(np.float64)
    edges = np.arange(9) * height // 8
    lines = np.concatenate([np.zeros((1, 8)), np.cumsum(x.reshape(height, 8, width // 8).mean(2), axis=0)])
    span = np.maximum(1, np.diff(edges))[:, None]
    cells = np.where(np.diff(edges)[:, None] > 0, (lines[edges[1:]] - lines[edges[:-1]]) / span, 0)
    bits = "".join("1" if c else "0" for c in (cells > cells.mean()).ravel())
    return f"{width}x{height} mean={x.mean():.3f} std={x.std():.3f} ahash={int(bits, 2):016x}"


def open_fs(path: str):
    """(file system, path in it) for the shared folder's path, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ShardWriter:
    """Tar shards in a folder; each digest is stored once in a shard."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.folder = open_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.limit, self.out, self.seen, self.at, self.shards = limit, None, {}, 0, 0
        task = TaskContext.get()
        # no two attempts write one name
        self.task = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else uuid.uuid4().hex

    def put(self, payload: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(payload).hexdigest()
        if digest not in self.seen:
            if self.out is None or self.at >= self.limit:
                self.close()
                self.name, self.shards = f"{self.task}-{self.shards:05d}.tar", self.shards + 1
                self.out, self.at, self.seen = self.fs.open_output_stream(f"{self.folder}/{self.name}"), 0, {}
            data = encode_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head)
            self.out.write(data)
            self.out.write(b"\0" * (-len(data) % 512))
            self.seen[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return (digest, self.name, *self.seen[digest])

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, shard_mb: int = 64, width: int = WIDTH) -> DataFrame:
    """doc_id, text -> the index rows; the result must be written once."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(INDEX.format(id="long")).fields[1:]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None
        for b in batches:
            if not len(b):
                continue
            shards = shards or ShardWriter(folder, shard_mb << 20)
            rows = []
            for text in b.column("text").cast(pa.binary()):
                data = text.as_py() or b""
                rows.append((len(data), *shards.put(pad(data, width))))
            n, digest, shard, offset, length = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=schema.names)
        if shards:
            shards.close()

    return docs.select("doc_id", "text").mapInArrow(write, schema)


class RangeReader:
    """Range reads of members; one open shard, and the features of the members read last."""

    def __init__(self, folder: str, keep: int = 256):
        self.fs, self.folder = open_fs(folder)
        self.keep, self.name, self.file, self.done = keep, None, None, OrderedDict()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.folder}/{shard}")
        return self.file.read_at(length, offset)

    def features(self, digest: str, shard: str, offset: int, length: int) -> tuple:
        key = (shard, offset)  # each stored copy is read back, equal digests or not
        if key not in self.done:
            width, height = png_header(self.read(shard, offset, 33))
            data = self.read(shard, offset, length)
            payload = decode_png(data)
            self.done[key] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), width, height, feature(payload, width, height))
            if len(self.done) > self.keep:
                self.done.popitem(last=False)
        self.done.move_to_end(key)
        return self.done[key]


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """Index rows with header metadata and features, by range reads."""
    schema = T.StructType([*index.schema.fields, *T._parse_datatype_string(FEATURES).fields])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            if not len(b):
                continue
            reader = reader or RangeReader(folder)
            cols = [b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")]
            got = [reader.features(*row) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(zip(*got, strict=True), types, strict=True))], names=schema.names)

    return index.mapInArrow(read, schema)


def media_columns(docs: DataFrame, shard_mb: int = 64) -> DataFrame:
    """doc_id, text -> index, header metadata and features of each row."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "media")
    index = store(docs, f"{folder}/shards", shard_mb)
    index.write.parquet(f"{folder}/index")
    stored = spark.read.schema(index.schema).parquet(f"{folder}/index")
    # the index is tiny: it is dealt by the bytes that its rows point to, a stretch of a shard each
    total = stored.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / STRETCH)
    return read_features(stored.repartition(max(1, -(-total // STRETCH)), "shard", stretch), f"{folder}/shards")


def members(data: bytes) -> list[str]:
    """Names in a shard, for tests."""
    return tarfile.open(fileobj=io.BytesIO(data)).getnames()
