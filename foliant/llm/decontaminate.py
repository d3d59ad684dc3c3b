"""Benchmark decontamination by latent semantic retrieval.

1. Passages (runs of 32 words) over hashed terms: document frequencies give
   inverse document frequencies.
2. A randomised SVD of the passage-term matrix A: every task adds up its part of
   A'(A R) for one fixed random R, block sums are added up by shuffled blocks, and
   the small products give the singular vectors (single-pass Nystrom).  Nothing
   of a document leaves its task but sums of a fixed size.
3. Benchmark items and sliding windows of each whole text are folded into the
   latent space (whitened by the singular values); windows with a cosine of
   ``cosine`` or more to an item of their length are candidates.  Windows start
   every ``STEP`` words; items of up to ``SHORT`` words are also compared with
   windows of their exact length at every word.
4. A candidate is confirmed by the longest common subsequence of words between
   the item and the window with half its length on both sides: ``lcs`` of the
   item's words, and ``answer`` of those of its answer (the column ``answer`` of
   the benchmark if it has one, else the item's last third).  So a paraphrase
   that keeps the order of most words is found.

Words are compared in folded case (Unicode, NFC), so copies in capitals are found.
Folding keeps the number and order of words, so spans are those of the text itself.

The model has 2**13 terms and 32 dimensions whatever the corpus; items are a
query set, taken in blocks of ``block`` so that what is broadcast is bounded.
Each text is read by one task in chunks.  No join, and no shuffle of texts.

Defined results: null and blank texts match nothing; items of fewer than
``least`` words are too common to be evidence and match nothing; a document
that holds an item several times gives one row, of the best match, ties to the
first; repeated rows give a row each; an empty benchmark or corpus gives an
empty result; only doc_id, text, item_id (and answer) are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, fresh, text_chunks, word_spans, words

BITS = 13
RANK = 32
PASSAGE = 32
BLOCKS = 64
STEP = 4  # words between windows
SHORT = 16  # words of items that get a window at every word


def folded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in folded case and NFC: neither adds or removes ASCII space."""
    data = buf.tobytes()
    if data.isascii():  # words() lowers A-Z
        return buf, off
    texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    texts = [t if t.isascii() else unicodedata.normalize("NFC", t.decode().casefold()).encode() for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def _passages(woff: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each run of ``size`` words, runs before each document)."""
    n = -(-np.diff(woff) // size)
    off = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    return woff[:-1][doc] + (np.arange(off[-1]) - off[:-1][doc]) * size, off


def _blocks(t: np.ndarray, woff: np.ndarray, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(terms dealt into rows of STEP, each text's last filled up with a term of
    no weight and followed by ``extra`` such rows; rows before each text)."""
    n = np.diff(woff)
    rows = -(-n // STEP) + np.where(n > 0, extra, 0)
    off = np.concatenate([[0], np.cumsum(rows)])
    out = np.full(off[-1] * STEP, 1 << BITS, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(t)) - woff[:-1][doc] + off[:-1][doc] * STEP] = t
    return out.reshape(-1, STEP), off


def _fold(table: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Row sums of table over the terms of each block."""
    out = table[blocks[:, 0]]
    for k in range(1, blocks.shape[1]):
        out += table[blocks[:, k]]
    return out


def _with_none(table: np.ndarray) -> np.ndarray:
    """The table with a zero row for the term of no weight."""
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])


def idf(docs: DataFrame, size: int = PASSAGE) -> tuple[np.ndarray, int]:
    """(idf of each hashed term over all passages, their number)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for _, _, buf, off in text_chunks(b.column("text")):
                h, _, _, woff = words(*folded(buf, off))
                first, _ = _passages(woff, size)
                if len(first):
                    p = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                    # 32 bits are enough for the passages of a usual chunk
                    key = (p.astype(np.uint64) << U(BITS)) | (h >> U(64 - BITS))
                    key = key.astype(np.uint32) if len(first) < 1 << (32 - BITS) else key
                    key.sort()
                    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                    df += np.bincount((key & key.dtype.type((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
                    n += len(first)
        if n:
            t = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1)), pa.array(np.append(df[t], n))], names=["term", "df"])

    rows = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # 2**13 + 1 at most
    df = {r["term"]: r["df"] for r in rows}
    n = df.pop(-1, 0)
    out = np.full(1 << BITS, np.log(1.0 + n), np.float32)
    for t, c in df.items():
        out[t] = np.log((1.0 + n) / (1.0 + c))
    return out, n


def latent(docs: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 7, size: int = PASSAGE) -> np.ndarray:
    """terms x dimensions: the fold-in matrix, idf and whitening included."""
    terms = 1 << BITS
    probe = (np.random.default_rng(seed).standard_normal((terms, rank)) * 1.0).astype(np.float32)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((weight, _with_none(probe * weight[:, None])))  # 1 MB
    rows = terms // BLOCKS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, wr = shared.value
        g = np.zeros((terms, rank), np.float32)
        seen = False
        for b in batches:
            for _, _, buf, off in text_chunks(b.column("text"), 1 << 19):
                h, _, _, woff = words(*folded(buf, off))
                first, poff = _passages(woff, size)
                if not len(first):
                    continue
                seen = True
                t = _terms(h)
                blocks, off4 = _blocks(t, woff)
                runs = (first - np.repeat(woff[:-1], np.diff(poff))) // STEP + np.repeat(off4[:-1], np.diff(poff))
                y = np.add.reduceat(_fold(wr, blocks), runs, axis=0)
                p = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                order = np.argsort(t.astype(np.uint16), kind="stable")  # a radix sort
                t = t[order]
                cut = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
                g[t[cut]] += np.add.reduceat(y[p[order]], cut, axis=0)
        if seen:
            g *= w[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array([g[i * rows : (i + 1) * rows].tobytes() for i in range(BLOCKS)])], names=["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, d in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(d.as_buffer(), np.float32).astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()])], names=["block", "data"])

    parts = docs.select("text").mapInArrow(part, "block long, data binary")
    g = np.zeros((terms, rank))
    for r in parts.repartition("block").mapInArrow(add, "block long, data binary").collect():  # 2 MB in all
        g[r["block"] * rows : (r["block"] + 1) * rows] = np.frombuffer(r["data"]).reshape(rows, rank)
    c = probe.astype(np.float64).T @ g
    val, vec = np.linalg.eigh((c + c.T) / 2)
    good = val > max(val.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((terms, 1), np.float32)
    u, s, _ = np.linalg.svd(g @ vec[:, good] / np.sqrt(val[good]), full_matrices=False)
    dims = s > s[0] * 1e-4
    # the first dimension is the common part of all passages
    dims[0] = dims.sum() < 8
    return (u[:, dims] / s[dims] * weight[:, None]).astype(np.float32)


class Items:
    """A block of benchmark items, grouped by window length."""

    def __init__(self, rows: list[tuple], fold: np.ndarray, weight: np.ndarray, least: int):
        self.words, self.answers, self.ids = [], [], []
        unit = []
        for item, text, answer in rows:
            h = _hashes(text)
            if len(h) < least:
                continue
            self.ids.append(item)
            self.words.append(h.tolist())
            a = _hashes(answer) if answer else h[-(-2 * len(h) // 3) :]
            self.answers.append(a.tolist())
            z = fold[_terms(h)].sum(0)
            unit.append(z / (np.linalg.norm(z) + 1e-30))
        # the weights of each item's terms, to tell candidates by their overlap
        self.table = np.zeros((len(self.ids), len(weight) + 1), np.float32)
        for j, w in enumerate(self.words):
            t = _terms(np.array(w, U))
            self.table[j, t] = weight[t]
        self.unit = np.array(unit, np.float32).reshape(len(self.ids), fold.shape[1])
        # windows of as many steps as the item has; long items take every other one
        self.steps = np.array([max(1, round(len(w) / STEP)) for w in self.words], np.int64)
        self.sizes = np.array([len(w) for w in self.words], np.int64)


def _hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(*folded(data, np.array([0, len(data)])))[0]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence: one bit per word of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def short_windows(t: np.ndarray, woff: np.ndarray, fold: np.ndarray, weight: np.ndarray, items: Items, cosine: float, overlap: float) -> Iterator[tuple]:
    """(document, item, first word, cosine) of the windows at every word that are candidates for an item of exactly their length."""
    sizes = np.unique(items.sizes[items.sizes <= SHORT])
    if not len(sizes):
        return
    total = np.concatenate([[0.0], np.cumsum(weight[t], dtype=np.float64)])
    doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    left = woff[1:][doc] - np.arange(len(t))
    for k in sizes.tolist():
        own = np.flatnonzero(items.sizes == k)
        # no item shares more with a window than all of them together
        most = np.concatenate([[0.0], np.cumsum(items.table[own].max(0)[t], dtype=np.float64)])
        n = max(len(t) - k + 1, 0)
        fit = (left[:n] >= k) & (most[k:] - most[:n] >= overlap * (total[k:] - total[:n]) - 1e-3)
        starts = np.flatnonzero(fit)
        for x in range(0, len(starts), 20_000):
            start = starts[x : x + 20_000]
            window = t[start[:, None] + np.arange(k)]
            at = _fold(fold, window)
            norm = np.sqrt(np.einsum("ij,ij->i", at, at)) + 1e-30
            near = at @ items.unit[own].T
            whole = weight[window].sum(1)
            i, j = np.nonzero(near >= (cosine * norm)[:, None])
            for y in range(0, len(i), 20_000):
                ii, jj = i[y : y + 20_000], j[y : y + 20_000]
                shared = items.table[own[jj][:, None], window[ii]].sum(1)
                for c in np.flatnonzero(shared >= overlap * whole[ii]):
                    yield int(doc[start[ii[c]]]), int(own[jj[c]]), int(start[ii[c]]), float(near[ii[c], jj[c]] / norm[ii[c]])


def matches(h: np.ndarray, woff: np.ndarray, fold: np.ndarray, weight: np.ndarray, items: Items, cosine: float, overlap: float, share: float, answer: float) -> list[tuple]:
    """(document, item, first word, last word, cosine, lcs) of a chunk of texts."""
    if not len(h) or not items.ids:
        return []
    most = int(items.steps.max())
    blocks, off = _blocks(_terms(h), woff, most)
    sums = _fold(fold, blocks)
    docs = np.repeat(np.arange(len(off) - 1), np.diff(off))
    # a window starts in a text, not in the rows after it
    inside = np.arange(len(blocks)) - off[:-1][docs] < -(-np.diff(woff)[docs] // STEP)
    odd = (np.arange(len(blocks)) - off[:-1][docs]) % 2 == 1
    terms = blocks.reshape(-1)
    z = np.zeros_like(sums)
    best: dict[tuple[int, int], list] = {}
    for k in range(1, most + 1):
        z[: len(z) - k + 1] += sums[k - 1 :]
        own = np.flatnonzero(items.steps == k)
        if not len(own):
            continue
        start = np.flatnonzero(inside & ~odd if k >= 8 else inside)
        at = z[start]
        norm = np.sqrt(np.einsum("ij,ij->i", at, at)) + 1e-30
        near = at @ items.unit[own].T
        i, j = np.nonzero(near >= (cosine * norm)[:, None])
        for x in range(0, len(i), 20_000):
            ii, jj = i[x : x + 20_000], own[j[x : x + 20_000]]
            window = terms[(start[ii] * STEP)[:, None] + np.arange(k * STEP)]
            shared = items.table[jj[:, None], window].sum(1)
            for c in np.flatnonzero(shared >= overlap * weight[window].sum(1)):
                d = int(docs[start[ii[c]]])
                word = int(woff[d] + (start[ii[c]] - off[d]) * STEP)
                best.setdefault((d, int(jj[c])), []).append((-float(near[ii[c], j[x + c]] / norm[ii[c]]), word, word + k * STEP))
    for d, j, word, c in short_windows(_terms(h), woff, fold, weight, items, cosine, overlap):
        best.setdefault((d, j), []).append((-c, word, word + int(items.sizes[j])))
    out = []
    for (d, j), found in best.items():
        w, ans = items.words[j], items.answers[j]
        tried: list[tuple[int, int]] = []
        for c, a, z in sorted(found):
            lo, hi = max(a - len(w) // 2, woff[d]), min(z + len(w) // 2, woff[d + 1])
            if any(x <= lo and hi <= y for x, y in tried):
                continue
            tried.append((lo, hi))
            region = h[lo:hi].tolist()
            n = lcs(w, region)
            if n >= share * len(w) and lcs(ans, region) >= answer * len(ans):
                out.append((d, j, int(lo), int(hi), -c, n / len(w)))
                break
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.77, overlap: float = 0.5, share: float = 0.8, answer: float = 0.6, least: int = 5, block: int = 2000) -> DataFrame:
    """doc_id, text -> doc_id, item_id, start, end (code points), cosine, lcs: one row per document and item that it leaks."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start long, end long, cosine double, lcs double"
    reply = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    query = benchmark.select("item_id", "text", reply.alias("answer"))
    count = query.count()
    if not count:
        return spark.createDataFrame([], schema)
    weight, _ = idf(docs)
    fold = latent(docs, weight)
    blocks = -(-count // block)
    out = None
    for k in range(blocks):
        own = query if blocks == 1 else query.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = Items([tuple(r) for r in own.orderBy("item_id", "text").collect()], fold, weight, least)
        if not items.ids:
            continue
        one = _search(docs, _with_none(fold), _with_none(weight), items, schema, cosine, overlap, share, answer)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)


def _search(docs: DataFrame, fold: np.ndarray, weight: np.ndarray, items: Items, schema: str, cosine: float, overlap: float, share: float, answer: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((fold, weight, items))  # bounded by the block of items

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, weight, items = shared.value
        ids = pa.array(items.ids)
        for b in batches:
            for i, n, buf, off in text_chunks(b.column("text"), 1 << 19):
                h, _, _, woff = words(*folded(buf, off))
                found = matches(h, woff, fold, weight, items, cosine, overlap, share, answer)
                if not found:
                    continue
                d, j, lo, hi, c, share_ = zip(*found, strict=True)
                s, e = word_spans(buf, off)
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                base = chars[off[list(d)]]
                start, end = chars[s[list(lo)]] - base, chars[e[np.array(hi) - 1]] - base
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n).take(pa.array(d)), ids.take(pa.array(j)), pa.array(start), pa.array(end), pa.array(c), pa.array(share_)], names=["doc_id", "item_id", "start", "end", "cosine", "lcs"])

    return docs.select("doc_id", "text").mapInArrow(search, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item.  What a row leaks depends on its text alone, so
    rows are told apart by the text's digest: one without an id goes as well, and a clean
    row stays though another of its id goes.  A null text leaks nothing."""
    (key,) = fresh(docs, "text_digest")
    digest = F.md5(F.col("text").cast("binary"))
    gone = contaminated(docs.select(digest.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, digest).join(gone, key, "left_anti").select(*docs.columns)
