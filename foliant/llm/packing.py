"""Packing documents into sequences of a fixed length: concatenate and cut.

Every document becomes its token ids and one end id.  Pass one encodes each
partition's documents in their order, writes the ids with the running sum of
tokens within the partition, and so leaves one total a partition; the prefix sums
of these totals are the partitions' offsets in the concatenation of everything.
Pass two adds the two, cuts at multiples of the sequence length, and emits a
record for each piece: which ids of which document stand where in which sequence.
Only the last sequence can be short, so padding is less than one sequence.

Nothing is shuffled but the totals.  Ids are stored once, in the shared folder, as
two bytes each where the vocabulary allows; a partition that is run again (lost
executor, retried task) writes rows and sums that agree with each other, as only
one attempt is committed.

A text is encoded in units that begin at single spaces between two characters
that surely are no white space.  The tokenizer's own pre-tokens never cross such a
place, so the ids are those of the whole text (tested); equal units of a chunk of
about ``CHUNK`` bytes are encoded once.

Defined results: a null text is an empty one, and an empty text is its end id
alone; repeated rows and rows without an id are documents of their own; an empty
table gives no pieces; other columns, whatever their names, take no part.  The
strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import text_chunks, written

SEQUENCE = 1024
#: Bytes of texts that are encoded at a time, and of units that are joined into one string.
CHUNK, RUN = 1 << 23, 1 << 16
#: Parts whose offsets are broadcast (12 bytes each); those of more are joined.
SMALL = 1 << 20

# bytes that are no white space by themselves: printable ASCII
_PLAIN = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
# first bytes of U+00C0 to U+02FF, among which there is no white space
_LATIN = (np.arange(256) >= 0xC3) & (np.arange(256) <= 0xCB)
# Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    """(encode one text, number of ids, bytes of each id) of a ``tokenizers`` file of byte-level BPE.

    Where its merges stand in the order of their ids, as they do in files made by
    training, ids are ranks, and the same ids are found by ranks in a fraction of the
    time; otherwise the library of the file is used.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    own, vocab = byte_of_char(), model["vocab"]
    special = {x["content"] for x in spec.get("added_tokens", []) if x.get("special")}
    ranks = {bytes(own[c] for c in k): v for k, v in vocab.items() if k not in special}
    size = np.zeros(max(vocab.values()) + 1, np.int64)
    for k, v in ranks.items():
        size[v] = len(k)
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged == sorted(merged) and not model.get("ignore_merges"):
        import tiktoken

        return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, len(size), size
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids, len(size), size


def apart(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places (not the first or last byte) are single spaces between plain or Latin characters."""
    before, after = buf[at - 1], buf[at + 1]
    latin = (before >= 0x80) & (before < 0xC0) & _LATIN[buf[np.maximum(at - 2, 0)]]
    return (buf[at] == 0x20) & (_PLAIN[before] | latin) & (_PLAIN[after] | _LATIN[after])


def unit_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units start: texts, and spaces that set two words apart."""
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    at = np.flatnonzero(buf == 0x20)
    at = at[~(first[at] | first[at + 1])]
    first[at[apart(buf, at)]] = True
    return np.flatnonzero(first[:-1])


class Encoder:
    """Token ids of texts; equal units of a call are encoded once."""

    def __init__(self, path: str) -> None:
        self.encode, self.vocabulary, self.size = encoder(path)

    def distinct(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units buf[off[i]:off[i+1]] in a row, and where each one's start."""
        at = off[1:-1]
        at = at[(at > 0) & (at < len(buf) - 1)]
        joint = np.isin(off[1:-1], at[apart(buf, at)])  # units that may follow another in one string
        cut = np.concatenate([[True], ~joint | (off[1:-1] // RUN != off[:-2] // RUN), [True]])
        cut = off[np.flatnonzero(cut)]
        data = buf.tobytes()
        ids = list(chain.from_iterable(self.encode(data[a:b].decode()) for a, b in pairwise(cut.tolist())))
        ids = np.array(ids, np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        starts = np.searchsorted(ends, off)
        if (ends[starts] != off).any():
            raise ValueError("a token crosses a place where units were cut")
        return ids, starts

    def ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their offsets per text)."""
        starts = unit_starts(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = np.append(starts, len(buf)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
        _, own_off, own = units.dictionary.buffers()
        own_off = np.frombuffer(own_off, np.int64)[: len(units.dictionary) + 1]
        table, first = self.distinct(np.frombuffer(own, np.uint8)[: own_off[-1]], own_off)
        code = np.asarray(units.indices)
        n = np.diff(first)[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = table[np.repeat(first[code] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, off)]


def encoded(docs: DataFrame, path: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary, little-endian), width (bytes an id), n, part, before (tokens of the part before it)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"]
    out = StructType([kind, *StructType.fromDDL("ids binary, width int, n long, part int, before long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, work = TaskContext.get().partitionId(), 0, Encoder(path)
        width = 2 if work.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4
        for b in batches:
            keys = b.column("key")
            for i, rows, buf, off in text_chunks(b.column("text"), CHUNK):
                ids, at = work.ids(buf, off)
                ids = np.insert(ids, at[1:], end_id).astype(f"<u{width}")
                at = at + np.arange(rows + 1)
                n = np.diff(at)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(ids)])
                sums = before + at[:-1]
                before += int(at[-1])
                columns = [keys.slice(i, rows), data.cast(pa.binary()), pa.array(np.full(rows, width, np.int32)), pa.array(n), pa.array(np.full(rows, part, np.int32)), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "width", "n", "part", "before"])

    return rows.mapInArrow(run, out)


def offsets(tokens: DataFrame) -> DataFrame:
    """part, base: tokens of all parts before it.  One number a part goes through the driver."""
    totals = sorted((r["part"], r["t"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("t")).collect())
    base, rows = 0, []
    for part, t in totals:
        rows.append((part, base))
        base += t
    found = tokens.sparkSession.createDataFrame(rows, "p int, base long")
    return F.broadcast(found) if len(rows) <= SMALL else found


def pieces(docs: DataFrame, path: str, end_id: int = 0, length: int = SEQUENCE, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless only
    the records are asked for, ids (unsigned 32 bit, little-endian): one row for each
    piece of a document in a sequence."""
    tokens = written(encoded(docs, path, end_id, text, key), "packing-ids")
    placed = tokens.join(offsets(tokens), F.col("part") == F.col("p")).select("key", "ids", "width", "n", (F.col("base") + F.col("before")).alias("at"))
    out = StructType([placed.schema["key"], *StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"), *([StructField("ids", BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i, (ids, width, n, at) in enumerate(zip(*(b.column(c) for c in ("ids", "width", "n", "at")), strict=True)):
                values = np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}").astype("<u4")
                n, at, start = n.as_py(), at.as_py(), 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    stop = min(n, start + length - offset)
                    data = values[start:stop].tobytes()
                    rows.append((i, start, stop - start, zlib.crc32(data), n, seq, offset, data if with_ids else b""))
                    held += 100 + len(rows[-1][-1])
                    start = stop
                    if held > 1 << 23:
                        yield batch(b, rows)
                        rows, held = [], 0
            if rows:
                yield batch(b, rows)

    def batch(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        i, *columns, data = zip(*rows, strict=True)
        columns = [b.column("key").take(pa.array(i)), *[pa.array(c, pa.int64()) for c in columns], *([pa.array(data, pa.binary())] if with_ids else [])]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    return placed.mapInArrow(run, out)


def padded(n: Column, length: int = SEQUENCE) -> Column:
    """Length that a sequence of n tokens is padded to: none at a power of two."""
    return F.when(F.bit_count(n) == 1, n).otherwise(F.lit(length)).cast("long")


def sequences(cut: DataFrame, length: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The packed sequences of ``pieces``: sequence_id, n_tokens, ids (padded, unsigned
    32 bit, little-endian) and boundaries (document, start, offset and length of each
    piece).  A sequence has at most ``length`` pieces, so a group is of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "key", "start", "length", "ids")))
    rows = cut.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    fill = F.lit(int(pad_id).to_bytes(4, "little"))
    missing = (padded(F.col("n_tokens"), length) - F.col("n_tokens")).cast("int")
    pad = F.aggregate(F.when(missing > 0, F.sequence(F.lit(1), missing)).otherwise(F.array().cast("array<int>")), F.lit(b""), lambda acc, _: F.concat(acc, fill))
    bounds = F.transform("parts", lambda p: F.struct(p["key"].alias("doc"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length")))
    return rows.select("sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"), bounds.alias("boundaries"))
