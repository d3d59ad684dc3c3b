"""Substring dedup: line hashing.

Units are lines, split again after sentence ends and, in sentences of over 16
words, after words whose hash says so (one in 12), so that a passage set into a
longer line, or cut out of a long sentence, falls into the same units wherever it
stands.  A unit is normalised (A-Z lowered, white space
collapsed) and digested to 128 bits.  Digests are grouped globally; the unit of
the lowest doc_id, and in it the first, is kept, all later ones go.  Units of
under ``unit_words`` words are too common to be judged by themselves: they go
only between two that go.  A run of units is cut out if it has ``min_words``
words, so a chance repeat of a short sentence stays.  Offsets are code points of
the original text.

A shorter run (``min_words`` is 20) is no passage: single sentences and short
lines that two documents share by chance, or by custom, are left alone.  For
line dedup in the narrow sense set ``min_words`` to 1.

Repeats within a document are settled where the text is read, so a digest is
sent once per document.  The groups are a partial aggregate (count and lowest
id), so a unit that a third of all documents hold is pre-aggregated; the marks
come from a shuffled join whose large partitions Spark can split.

Defined results: null and blank texts stay as they are, without units; rows
without doc_id rank last and never remove from each other, nor do repeated rows
of one id; ties cannot occur otherwise; an empty table gives an empty result;
only doc_id and text are read, so clashing names are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, mix, powers, text_chunks, words, written

END = np.zeros(256, bool)
END[[0x21, 0x2E, 0x3F]] = True  # ! . ?
LAST = (1 << 63) - 1
LONG, CUT = 16, 12  # in longer sentences, one word in so many ends a unit


class Units:
    """The units of a chunk of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        h, s, e, woff = words(buf, off)
        n = len(h)
        if not n:
            self.h1 = self.h2 = np.zeros(0, U)
            self.words = self.start = self.end = np.zeros(0, np.int64)
            self.off = np.zeros(len(off), np.int64)
            return
        lines = np.concatenate([[0], np.cumsum(buf == 0x0A)])
        # one mark ends a sentence, not "!!" after each word
        stop = END[buf[e - 1]] & ~END[buf[np.maximum(e - 2, 0)]]
        stop[:-1] |= lines[s[1:]] > lines[e[:-1]]
        bound = woff[1:][woff[1:] > woff[:-1]] - 1
        stop[bound] = True
        # long sentences are cut by content; words that repeat don't cut themselves up
        ends = np.flatnonzero(stop)
        size = np.diff(np.concatenate([[-1], ends]))
        stop |= np.repeat(size > LONG, size) & (mix(h ^ U(0x2545F491)) % U(CUT) == 0) & np.concatenate([[True], h[1:] != h[:-1]])
        last = np.flatnonzero(stop)
        first = np.concatenate([[0], last[:-1] + 1])
        self.words = last - first + 1
        place = np.arange(n) - np.repeat(first, self.words)
        p = powers(int(self.words.max()))[place]
        with np.errstate(over="ignore"):
            self.h1 = mix(np.add.reduceat(h * p, first) + self.words.astype(U))
            self.h2 = mix(np.add.reduceat(mix(h + U(0x51ED27)) * p, first) ^ self.words.astype(U))
        self.start, self.end = s[first], e[last]
        self.off = np.searchsorted(self.start, off).astype(np.int64)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def firsts(self) -> np.ndarray:
        """Whether a unit is the first of its digest in its document."""
        with np.errstate(over="ignore"):
            key = self.h1 + mix(self.docs().astype(U) + U(77))
        out = np.zeros(len(key), bool)
        out[np.unique(key, return_index=True)[1]] = True
        return out


def unit_digests(docs: DataFrame, unit_words: int) -> DataFrame:
    """key, h1, h2: each digest of a document once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.asarray(b.column("key"))
            for i, n, buf, off in text_chunks(b.column("text")):
                u = Units(buf, off)
                take = u.firsts() & (u.words >= unit_words)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + n][u.docs()[take]]), pa.array(u.h1[take].view(np.int64)), pa.array(u.h2[take].view(np.int64))], names=["key", "h1", "h2"])

    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), "text").mapInArrow(emit, "key long, h1 long, h2 long")


def removed_units(gone: np.ndarray, small: np.ndarray, size: np.ndarray, min_words: int) -> np.ndarray:
    """Units of one document to cut: small ones go between two that go; short runs stay."""
    n = len(gone)
    if not gone.any():
        return gone
    # the state of the last unit before, and the next after, that isn't small
    at = np.where(small, -1, np.arange(n))
    before = np.maximum.accumulate(at)
    after = np.minimum.accumulate(np.where(small, n, np.arange(n))[::-1])[::-1]
    pad = np.concatenate([gone, [False]])
    gone = np.where(small, (before >= 0) & (after < n) & pad[before] & pad[after], gone)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if total[b] - total[a] < min_words:
            gone[a:b] = False
    return gone


def dedup_substrings(docs: DataFrame, unit_words: int = 4, min_words: int = 20) -> DataFrame:
    """doc_id, text -> doc_id, n_units, n_removed, removed and kept (spans), text (what is kept)."""
    units = written(unit_digests(docs, unit_words), "units")  # read twice below, hashed once
    repeated = units.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    marks = units.join(repeated, ["h1", "h2"]).where("key > first").groupBy("key").agg(F.collect_set("h1").alias("marks"))
    both = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("key")).join(marks, "key", "left").select("doc_id", "text", "marks")
    spans = "array<struct<start:int,end:int>>"
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"n_units long, n_removed long, removed {spans}, kept {spans}, text string").fields])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked, texts = b.column("marks"), b.column("text")
            rows = []
            for i, n, buf, off in text_chunks(texts):
                u = Units(buf, off)
                first = u.firsts()
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                data = buf.tobytes()
                for d in range(n):
                    a, z = u.off[d], u.off[d + 1]
                    m = marked[i + d]
                    small = u.words[a:z] < unit_words
                    gone = ~first[a:z] & ~small
                    if m.is_valid:
                        gone |= np.isin(u.h1[a:z], np.asarray(m.values).view(U)) & ~small
                    gone = removed_units(gone, small, u.words[a:z], min_words)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    cuts = [(int(u.start[a + x]), int(u.end[a + y - 1])) for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    ends = [int(off[d]), *(x for c in cuts for x in c), int(off[d + 1])]
                    keep = [(x, y) for x, y in zip(ends[::2], ends[1::2], strict=True) if x < y]
                    place = lambda x, o=off[d]: int(chars[x] - chars[o])
                    text = b"".join(data[x:y] for x, y in keep).decode() if texts[i + d].is_valid else None
                    rows.append((int(z - a), int(gone.sum()), [{"start": place(x), "end": place(y)} for x, y in cuts], [{"start": place(x), "end": place(y)} for x, y in keep], text))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, span, pa.string()), strict=True))], names=schema.names)

    return both.mapInArrow(cut, schema)
