"""Shared pieces of the training-data operators.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z only.
The numpy code works straight on the UTF-8 buffers of Arrow string columns in
chunks of about ``CHUNK`` bytes, so memory in a Python worker does not depend
on the batch size that Spark picks; one document is never cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow = np.ones(1, dtype=U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the odd multiplier, modulo 2**64."""
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 256) - 1, _MULT)]), dtype=U)
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * _A
    x ^= x >> U(27)
    x *= _B
    x ^= x >> U(31)
    return x


def text_chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of a string column, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    length = np.diff(off)
    if col.null_count:
        length = np.where(np.asarray(col.is_null()), 0, length)
    ends = np.cumsum(length)
    i = 0
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        if col.null_count and length[i:j].sum() != off[j] - off[i]:
            buf = np.concatenate([data[off[k] : off[k] + length[k]] for k in range(i, j)] or [data[:0]])
        else:
            buf = data[off[i] : off[j]]
        yield i, j - i, buf, np.concatenate([[0], ends[i:j] - before])
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; words do not cross documents."""
    nz = ~SPACE[buf]
    if not len(nz):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = off[:-1][off[:-1] < len(buf)]
    start = nz.copy()
    start[1:] &= ~nz[:-1]
    start[edge] = nz[edge]
    end = nz.copy()
    end[:-1] &= ~nz[1:]
    last = edge[edge > 0] - 1
    end[last] = nz[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty byte spans."""
    if not len(s):
        return np.zeros(0, U)
    length = e - s
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    pos = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    take = pos + np.repeat(s, length)
    b = buf[take]
    if lower:
        b = LOWER[b]
    with np.errstate(over="ignore"):
        v = (b.astype(U) + U(1)) * powers(int(length.max()))[pos]
        return mix(np.add.reduceat(v, first) + length.astype(U) * _B)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte starts, byte ends, word offsets of the documents)."""
    s, e = word_spans(buf, off)
    return hash_spans(buf, s, e), s, e, np.searchsorted(s, off).astype(np.int64)


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; empty segments give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Number of words of a text, null as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_crc(c: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    The setting is read from the session.  Where it is unset, a folder under /tmp is
    set for the session if all runs in one process (tests); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        base = "file:///tmp/foliant-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/foliant/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
