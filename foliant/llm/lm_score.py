"""LM scoring with a hierarchical Pitman-Yor model of word pairs.

Restaurants: one for every context, that is for every word of the training
texts and for the start of a text, and one root that all contexts share as their
parent.  Dishes are all training words and the end of a text, over a uniform
base of V + 1 words (one for all unknown ones).

Seating is sampled by Gibbs sweeps: all customers of a dish in a context leave
and sit down again, given the tables of everyone else; the first 8 one at a
time, later ones in draws of an eighth of those seated (a binomial number of new
tables each).  Tables are customers of the root, seated likewise.  A score
averages the predictive probabilities of several samples.

Data flow.  A pair is a word (dish) and the word before it (context).

* ``frequent``: the most frequent words, and most frequent pairs of such words.
  They decide only how work is dealt, not what is computed: frequent pairs are
  counted where they are read and seated on the driver (2^20 of them at most, a fixed
  size), so no other pair, word or context is hot.
* ``blocks`` and ``gather``: all other pairs travel once, to the target of their
  word if that is not frequent, else of their context, else of the pair, with the
  documents they occur in.  A target holds about ``tokens_each`` tokens; the table
  is bucketed by target, so that later joins leave it where it is.
* ``homes``: each context's customers and tables are spread over targets.  Its
  home, a target too, adds them up and knows who asks for it.  The totals are a
  table that is joined in each sweep; those of frequent words are broadcast.
* ``sweep``: targets seat their pairs, given the totals of the previous sweep, and
  write their tables (the sample) and what they add to contexts and to the root.
* ``scores``: targets sum log probabilities by document; sums return to the batch
  they came from, and a second pass over the texts adds the frequent pairs.

Words are told apart by 40 bits of their hash.

Defined results: a null or blank text is the end token alone; a null doc_id is
trained on; repeated rows count as often as they occur, and score alike; an
empty table gives an empty result; with nothing to train on, every word has the
base's probability; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, id_crc, mix, shared_dir, text_chunks, words, written

HOT_WORDS = 1 << 14
HOT_PAIRS = 1 << 20
FREQ_BLOCK = 1 << 15  # frequent pairs are added up in blocks of this size
START, END = (int(x) for x in mix(np.array([1, 2], U)))
_P, _Q = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)

BLOCK_COLS = "kind target batch words pairs contexts seen docs".split()
BLOCK_SCHEMA = "kind int, target int, batch long, " + ", ".join(f"{c} binary" for c in BLOCK_COLS[3:])
PART_COLS = "kind target batch word_hot word_count word_pairs pair_context pair_count context_hot homes names context_count context_single seen post_batch post_doc batches".split()
PART_SCHEMA = "kind int, target int, batch long, " + ", ".join(f"{c} binary" for c in PART_COLS[3:])


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in the least width that holds them all."""
    top = int(x.max()) if len(x) else 0
    if 1 << 16 <= top < 1 << 24:
        return b"\x04" + x.astype(np.uint16).tobytes() + (x.astype(np.uint32) >> 16).astype(np.uint8).tobytes()
    k = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    return bytes([k]) + x.astype(KINDS[k]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if b[0] == 4:
        n = (len(b) - 1) // 3
        return np.frombuffer(b, np.uint16, n, 1).astype(np.int64) | np.frombuffer(b, np.uint8, n, 1 + 2 * n).astype(np.int64) << 16
    return np.frombuffer(b, KINDS[b[0]], offset=1).astype(np.int64)


def pack_ones(x: np.ndarray) -> bytes:
    """Numbers that are mostly 1: a bit each, and the others."""
    other = x != 1
    return len(x).to_bytes(4, "little") + np.packbits(other).tobytes() + pack(x[other])


def unpack_ones(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    m = -(-n // 8)
    other = np.unpackbits(np.frombuffer(b, np.uint8, m, 4), count=n).astype(bool)
    out = np.ones(n, np.int64)
    out[other] = unpack(b[4 + m :])
    return out


def pack40(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).tobytes() + (x >> U(32)).astype(np.uint8).tobytes()


def unpack40(b: bytes) -> np.ndarray:
    n = len(b) // 5
    return np.frombuffer(b, np.uint32, n).astype(U) | np.frombuffer(b, np.uint8, n, 4 * n).astype(U) << U(32)


def short(h: np.ndarray) -> np.ndarray:
    return h >> U(24)


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word * _P + context * _Q)


def heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Places:
    """Places of numbers of some bits in an ascending array, by a table of their leading bits."""

    def __init__(self, table: np.ndarray, bits: int, lead: int):
        self.table, self.shift = table, U(bits - lead)
        head = (table >> self.shift).astype(np.int64)
        self.first = np.full(1 << lead, -1, np.int32)
        self.first[head[::-1]] = np.arange(len(table), dtype=np.int32)[::-1]
        shared = head[1:][head[1:] == head[:-1]]
        self.shared = np.zeros(1 << lead, bool) if len(shared) else None
        if len(shared):
            self.shared[shared] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """-1 if absent."""
        if not len(self.table):
            return np.full(len(x), -1, np.int32)
        head = (x >> self.shift).astype(np.int64)
        at = self.first[head]
        if self.shared is not None:
            more = np.flatnonzero(self.shared[head])
            at[more] = np.minimum(np.searchsorted(self.table, x[more]), len(self.table) - 1)
        return np.where((at >= 0) & (self.table[at] == x), at, -1)


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in an ascending table, -1 if absent."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def by_pair(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """An order by word and context: by the word and the leading bits of the context, then exactly where those are equal."""
    key = word << U(24) | context >> U(16)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(key) else order
    own = order[again]
    order[again] = own[np.lexsort((context[own], key[again]))]
    return order


def rows(schema: str, out: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))


def tokens(buf: np.ndarray, off: np.ndarray):
    """(word, context, document) of all tokens, ends included."""
    h, _, _, woff = words(buf, off)
    docs = len(off) - 1
    n = np.diff(woff)
    doc = np.repeat(np.arange(docs), n + 1)
    word = np.full(len(h) + docs, END, U)
    word[np.arange(len(h)) + np.repeat(np.arange(docs), n)] = h
    context = np.full(len(word), START, U)
    context[1:] = word[:-1]
    context[np.cumsum(n + 1) - n - 1] = START
    return word, context, doc


@dataclass
class Frequent:
    """Ascending 40-bit words with START and END; pairs as ascending keys with the places of their words."""

    words: np.ndarray
    keys: np.ndarray
    word: np.ndarray
    context: np.ndarray

    def splitter(self):
        """word, context -> (places of frequent words, of frequent contexts, of frequent pairs), -1 if not frequent."""
        names, pairs = Places(self.words, 40, 20), Places(self.keys, 64, 22)

        def split(word: np.ndarray, context: np.ndarray):
            w, c = names.find(short(word)), names.find(short(context))
            p = np.full(len(word), -1, np.int32)
            both = np.flatnonzero((w >= 0) & (c >= 0))
            p[both] = pairs.find(pair_key(word[both], context[both]))
            return w, c, p

        return split


def counted(word: np.ndarray, context: np.ndarray, n: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs added up, the most frequent ``best`` of them."""
    order = np.lexsort((context, word))
    word, context = word[order], context[order]
    at = heads(word, context)
    n = np.add.reduceat(n[order], at) if len(at) else n
    word, context = word[at], context[at]
    if len(n) > best:
        keep = np.argsort(-n, kind="stable")[:best]
        word, context, n = word[keep], context[keep], n[keep]
    return word, context, n


def frequent(train: DataFrame, words_each: int = 1 << 15, pairs_each: int = 100_000, span: int = 1_000_000, slots: int = 16) -> Frequent:
    """From what is frequent in each task's texts, added up by hash."""
    schema = "kind int, slot int, words binary, contexts binary, counts binary"
    most = {1: HOT_WORDS, 2: HOT_PAIRS}

    def row(kind, slot, found):
        return rows(schema, [(kind, slot, *(x.tobytes() for x in found))])

    def held_in(r):
        return tuple(np.frombuffer(r[k], t) for k, t in (("words", U), ("contexts", U), ("counts", np.int64)))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        found: dict[int, list] = {1: [], 2: []}

        def settle():
            w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            k = np.sort(w)
            at = heads(k)
            n = np.diff(np.append(at, len(k)))
            found[1].append((k[at][n > 2], np.zeros((n > 2).sum(), U), n[n > 2]))
            key = pair_key(w, c)
            order = np.argsort(key)
            at = heads(key[order])
            n = np.diff(np.append(at, len(key)))
            own = order[at[n > 2]]
            found[2].append((w[own], c[own], n[n > 2]))

        for b in batches:
            for _, _, buf, off in text_chunks(b.column("text")):
                w, c, _ = tokens(buf, off)
                held.append((w, c))
                if sum(len(x) for x, _ in held) > span:
                    settle()
        if held:
            settle()
        for kind, best in ((1, words_each), (2, pairs_each)):
            if found[kind]:
                w, c, n = counted(*(np.concatenate(x) for x in zip(*found[kind], strict=True)), best)
                slot = (pair_key(w, c) % U(slots)).astype(int)
                for k in range(slots):
                    yield row(kind, k, (w[slot == k], c[slot == k], n[slot == k]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        total = lambda: row(*now, counted(*(np.concatenate(x) for x in zip(*got, strict=True)), most[now[0]] // slots * 5 // 4))
        for b in batches:
            for r in b.to_pylist():
                if got and (r["kind"], r["slot"]) != now:
                    yield total()
                    got.clear()
                now = r["kind"], r["slot"]
                got.append(held_in(r))
        if got:
            yield total()

    found = train.select("text").mapInArrow(top, schema).repartition(slots, "kind", "slot").sortWithinPartitions("kind", "slot").mapInArrow(add, schema).collect()
    none = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))
    own = {k: counted(*(np.concatenate(x) for x in zip(none, *(held_in(r) for r in found if r["kind"] == k), strict=True)), most[k]) for k in (1, 2)}
    hot = np.unique(short(np.concatenate([own[1][0], np.array([START, END], U)])))
    w, c, _ = own[2]
    a, b = find(hot, short(w)), find(hot, short(c))
    both = (a >= 0) & (b >= 0)
    keys, at = np.unique(pair_key(w[both], c[both]), return_index=True)
    return Frequent(hot, keys, a[both][at].astype(np.int16), b[both][at].astype(np.int16))


def blocks(docs: DataFrame, freq: Frequent, parts: int, batch_pairs: int = 700_000) -> DataFrame:
    """doc_id, th, fold, text -> what goes to targets.

    kind 0: a batch's pairs: words, pairs of each, contexts, occurrences of each, their documents (the first bit: trained on)
    kind 1: a batch's documents: words = doc_id, contexts = text hash, docs = whether doc_id is there
    kind 2: trained-on counts of a block of frequent pairs (pairs = place in it, contexts = count)
    """
    shared = docs.sparkSession.sparkContext.broadcast(freq)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        split = freq.splitter()
        lead, width = U((64 - parts.bit_length()) // 2), U(40)
        me = TaskContext.get().partitionId() << 32
        counts = np.zeros(len(freq.keys), np.int64)
        held: list[tuple] = []
        ids: list[tuple] = []
        count = base = k = 0

        def flush():
            nonlocal held, ids, count, base, k
            w, c, target, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            # equal pairs that this order leaves apart are brought together by their target
            order = np.argsort(target.astype(U) << (lead + lead) | w >> (width - lead) << lead | c >> (width - lead))
            w, c, target, doc = w[order], c[order], target[order], doc[order]
            pair = heads(target, w, c)
            seen = np.diff(np.append(pair, len(w)))
            word = heads(target[pair], w[pair])
            n = np.diff(np.append(word, len(pair)))
            edge = np.append(pair, len(w))
            out = []
            owner = target[pair[word]]
            for t in np.unique(owner):
                x, y = np.searchsorted(owner, [t, t + 1])
                p, q = word[x], word[y] if y < len(word) else len(pair)
                out.append((0, int(t), me + k, pack40(w[pair[word[x:y]]]), pack(n[x:y]), pack40(c[pair[p:q]]), pack_ones(seen[p:q]), doc[edge[p] : edge[q]].tobytes()))
            d, th, ok = (np.concatenate(x) for x in zip(*ids, strict=True))
            out.append((1, (me + k) * 2654435761 % parts, me + k, d.tobytes(), b"", th.tobytes(), b"", ok.tobytes()))
            held, ids, count, base, k = [], [], 0, 0, k + 1
            return rows(BLOCK_SCHEMA, out)

        for b in batches:
            key, fold = b.column("doc_id"), np.asarray(b.column("fold"))
            ok = np.asarray(key.is_valid())
            d, th = np.asarray(key.fill_null(0)), np.asarray(b.column("th"))
            for i, n, buf, off in text_chunks(b.column("text")):
                for j in range(0, n, 1 << 14):  # documents of a batch are numbered in 15 bits
                    m = min(1 << 14, n - j)
                    if base + m > 1 << 15:
                        yield flush()
                    own = slice(off[j], off[j + m])
                    w, c, doc = tokens(buf[own], off[j : j + m + 1] - off[j])
                    train = (fold[i + j : i + j + m] != 2)[doc]
                    hw, hc, pair = split(w, c)
                    counts += np.bincount(pair[train & (pair >= 0)], minlength=len(counts))
                    rest = pair < 0
                    w, c, hw, hc, doc, train = short(w[rest]), short(c[rest]), hw[rest], hc[rest], doc[rest], train[rest]
                    owner = np.where(hw < 0, w, np.where(hc < 0, c, short(pair_key(w, c))))
                    held.append((w, c, (owner * U(parts) >> U(40)).astype(np.int32), (doc + base).astype(np.uint16) | train.astype(np.uint16) << 15))
                    ids.append((d[i + j : i + j + m], th[i + j : i + j + m], ok[i + j : i + j + m]))
                    count += len(w)
                    base += m
                    if count > batch_pairs:
                        yield flush()
        if ids:
            yield flush()
        out = []
        for t in range(0, len(counts), FREQ_BLOCK):
            x = counts[t : t + FREQ_BLOCK]
            own = np.flatnonzero(x)
            if len(own):
                out.append((2, t // FREQ_BLOCK % parts, t, b"", pack(own), pack(x[own]), b"", b""))
        if out:
            yield rows(BLOCK_SCHEMA, out)

    return docs.mapInArrow(deal, BLOCK_SCHEMA)


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + n[i] - 1, one run after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def gather(df: DataFrame, freq: Frequent, parts: int) -> DataFrame:
    """Blocks -> one row (kind 0) per target; rows of kinds 1 and 2 as they are, or added up."""
    shared = df.sparkSession.sparkContext.broadcast(freq.words)

    def part(target: int, held: list[tuple]) -> tuple:
        n = [unpack(h[2]) for h in held]
        w = np.concatenate([np.repeat(unpack40(h[1]), k) for h, k in zip(held, n, strict=True)])
        c = np.concatenate([unpack40(h[3]) for h in held])
        each = [unpack_ones(h[4]) for h in held]
        block = np.repeat(np.arange(len(held)), [int(x.sum()) for x in each])
        seen = np.concatenate(each)
        doc = np.concatenate([np.frombuffer(h[5], np.uint16) for h in held])
        order = by_pair(w, c)
        post = runs((np.cumsum(seen) - seen)[order], seen[order])
        w, c, block, doc = w[order], c[order], block[post], doc[post]
        at = heads(w, c)
        occurs = np.add.reduceat(seen[order], at)
        count = np.add.reduceat((doc >> 15).astype(np.int64), np.cumsum(occurs) - occurs)
        w, c = w[at], c[at]
        names, pair_word = np.unique(w, return_inverse=True)
        # contexts: frequent ones, then by home, those with pairs to seat first
        contexts, pc = np.unique(c, return_inverse=True)
        live = np.bincount(pc, weights=count > 1) > 0
        hot = find(shared.value, contexts)
        home = np.where(hot >= 0, -1, (contexts * U(parts) >> U(40)).astype(np.int64))
        rank = np.lexsort((contexts, ~live, home))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        pc = place[pc]
        contexts, live, hot, home = contexts[rank], live[rank], hot[rank], home[rank]
        cold = int((hot >= 0).sum())
        ids, begin, total = np.unique(home[cold:], return_index=True, return_counts=True)
        active = np.add.reduceat(live[cold:], begin) if len(begin) else begin
        customers, single = (np.bincount(pc, weights=x, minlength=len(contexts)).astype(np.int64)[cold:] for x in (count, count == 1))
        return (0, target, 0, pack(find(shared.value, names) + 1), pack(np.bincount(pair_word, weights=count, minlength=len(names)).astype(np.int64)), pack(np.bincount(pair_word, minlength=len(names))), pack(pc), pack_ones(count), pack(hot[:cold]), np.stack([ids, active, total]).astype(np.int64).tobytes(), pack40(contexts[cold:]), pack(customers), pack(single), pack_ones(occurs), pack(block), doc.tobytes(), np.array([h[0] for h in held], np.int64).tobytes())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by target; one target's blocks are held at a time
        held: list[tuple] = []
        added: dict[int, np.ndarray] = {}
        now = None
        other = lambda kind, target, batch, a, b, c: rows(PART_SCHEMA, [(kind, target, batch, a, b, c, *[b""] * 11)])
        for batch in batches:
            cols = [batch.column(c) for c in BLOCK_COLS]
            for i in range(batch.num_rows):
                kind, target, own, *data = (c[i].as_py() for c in cols)
                if held and target != now:
                    yield rows(PART_SCHEMA, [part(now, held)])
                    held = []
                now = target
                if kind == 0:
                    held.append((own, *data))
                elif kind == 1:
                    yield other(1, target, own, data[0], data[2], data[4])
                else:
                    added.setdefault(own, np.zeros(FREQ_BLOCK, np.int64))[unpack(data[1])] += unpack(data[2])
        if held:
            yield rows(PART_SCHEMA, [part(now, held)])
        for own, x in added.items():
            yield other(2, own // FREQ_BLOCK % parts, own, pack(x), b"", b"")

    return df.repartition(parts, "target").sortWithinPartitions("target").mapInArrow(collect, PART_SCHEMA)


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, bucketed by key: joins on it don't move it."""
    spark, table = df.sparkSession, f"lm_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", shared_dir(spark, f"lm-{name}")).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files are outside the warehouse
    return out


def tables(c: np.ndarray, alpha: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables after c customers of each dish sat down; alpha: weight of a new table."""
    t = (c > 0).astype(np.float64)
    live = np.flatnonzero(c > 1)
    i = 1
    while len(live):
        m = np.minimum(max(1, i // 8), c[live] - i)
        p = alpha[live] / (alpha[live] + i - d * t[live])
        t[live] += rng.binomial(m.astype(np.int64), np.clip(p, 0, 1))
        i += max(1, i // 8)
        live = live[c[live] > i]
    return t


@dataclass
class Model:
    """What all targets share: discounts, the root's totals, and of frequent words the root's
    customers and tables as dishes, the customers and tables as contexts."""

    v: int
    n: int
    d1: float
    d0: float
    dish: np.ndarray
    dish_tables: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    root: float
    root_tables: float
    theta1: float = 2.0
    theta0: float = 10.0

    def base(self) -> float:
        return (self.theta0 + self.d0 * self.root_tables) / (self.theta0 + self.root) / (self.v + 1)

    def root_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.d0 * tables) / (self.theta0 + self.root) + self.base()

    def seat_root(self, customers: np.ndarray, rng) -> np.ndarray:
        return tables(customers.astype(np.int64), np.full(len(customers), (self.theta0 + self.d0 * self.root_tables) / (self.v + 1)), self.d0, rng)

    def seat(self, c: np.ndarray, context_tables: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
        return tables(c, (self.theta1 + self.d1 * context_tables) * p, self.d1, rng)

    def predict(self, c, t, customers, context_tables, p) -> np.ndarray:
        """Probabilities of pairs.  All totals are those of one sample, so a context's sum to one."""
        return (c - self.d1 * t + (self.theta1 + self.d1 * context_tables) * p) / (self.theta1 + customers)


@dataclass
class Part:
    """A target's row: what is not packed."""

    hot: np.ndarray  # place of each word among the frequent ones, or -1
    word_count: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    context_hot: np.ndarray
    homes: np.ndarray  # ids, contexts with pairs to seat, contexts

    @classmethod
    def of(cls, r: dict) -> Part:
        pairs = unpack(r["word_pairs"])
        return cls(unpack(r["word_hot"]) - 1, unpack(r["word_count"]), np.repeat(np.arange(len(pairs)), pairs), unpack(r["pair_context"]), unpack_ones(r["pair_count"]), unpack(r["context_hot"]), np.frombuffer(r["homes"], np.int64).reshape(3, -1))

    def starts(self) -> np.ndarray:
        """First context of each home."""
        return len(self.context_hot) + np.cumsum(self.homes[2]) - self.homes[2]

    def spread(self, hot: np.ndarray, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """A value for each context, from those of the frequent ones and of the homes; 0 where a home gives less."""
        out = np.zeros(len(self.context_hot) + int(self.homes[2].sum()))
        out[: len(self.context_hot)] = hot[self.context_hot]
        at = dict(zip(self.homes[0].tolist(), self.starts().tolist(), strict=True))
        for home, x in found:
            out[at[home] : at[home] + len(x)] = x
        return out


def beside(left: DataFrame, right: DataFrame, key: str, *cols: str) -> DataFrame:
    """left with an array ``got`` of the rows of right that have its key."""
    got = right.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(*cols)).alias("got"))
    return left.join(got.hint("shuffle_hash"), left[key] == got["_key"], "left").drop("_key")  # the large rows of left stream by


def homes(parts: DataFrame, n: int) -> DataFrame:
    """home, customers, fixed (tables of pairs that occur once) of its contexts; targets that ask, with
    (target, contexts with pairs to seat, contexts), and the places of those contexts."""
    ask = "home int, target int, active int, names binary, customers binary, single binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                names, customers, single = unpack40(r["names"]), unpack(r["context_count"]), unpack(r["context_single"])
                ids = np.frombuffer(r["homes"], np.int64).reshape(3, -1)
                cut = np.concatenate([[0], np.cumsum(ids[2])])
                out = [(int(h), r["target"], int(a), pack40(names[x:y]), pack(customers[x:y]), pack(single[x:y])) for (h, a, _), x, y in zip(ids.T, cut[:-1], cut[1:], strict=True)]
                if out:
                    yield rows(ask, out)

    def add(home: int, got: list[tuple]) -> tuple:
        each = [unpack40(g[2]) for g in got]
        names, at = np.unique(np.concatenate(each), return_inverse=True)
        customers, fixed = (np.bincount(at, weights=np.concatenate([unpack(g[k]) for g in got]), minlength=len(names)).astype(np.int64) for k in (3, 4))
        return home, pack(customers), pack(fixed), np.array([(g[0], g[1], len(x)) for g, x in zip(got, each, strict=True)], np.int64).tobytes(), pack(at)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for b in batches:
            for r in b.to_pylist():
                if got and r["home"] != now:
                    yield rows(HOME_SCHEMA, [add(now, got)])
                    got = []
                now = r["home"]
                got.append((r["target"], r["active"], r["names"], r["customers"], r["single"]))
        if got:
            yield rows(HOME_SCHEMA, [add(now, got)])

    sent = parts.where("kind = 0").select("target", "homes", "names", "context_count", "context_single").mapInArrow(send, ask)
    return sent.repartition(n, "home").sortWithinPartitions("home", "target").mapInArrow(settle, HOME_SCHEMA)


HOME_SCHEMA = "home int, customers binary, fixed binary, asks binary, places binary"
SWEEP_SCHEMA = "kind int, target int, home int, sample int, a binary, b binary"


def reply(home: DataFrame, swept: DataFrame | None) -> DataFrame:
    """target, home, totals: tables of the contexts that a target seats pairs in, after a sweep (before the first: a guess)."""
    schema, guess = "target int, home int, totals binary", swept is None

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                customers, fixed, asks, places = unpack(r["customers"]), unpack(r["fixed"]), np.frombuffer(r["asks"], np.int64).reshape(-1, 3), unpack(r["places"])
                cut = np.concatenate([[0], np.cumsum(asks[:, 2])])
                ask = {int(t): places[x : x + a] for (t, a, _), x in zip(asks, cut[:-1], strict=True)}
                total = fixed + (customers - fixed) * 0.3 if guess else fixed.astype(np.float64)
                for g in r["got"] or []:
                    total[ask[g["target"]]] += unpack(g["a"])
                out = [(t, r["home"], total[x].astype(np.float32).tobytes()) for t, x in ask.items() if len(x)]
                if out:
                    yield rows(schema, out)

    if guess:
        return home.withColumn("got", F.lit(None).cast("array<struct<target:int,a:binary>>")).mapInArrow(one, schema)
    return beside(home, swept.where("kind = 1"), "home", "target", "a").mapInArrow(one, schema)


def sweep(parts: DataFrame, replies: DataFrame, model: Model, seed: int) -> DataFrame:
    """One Gibbs sweep of all targets.

    kind 0: a target's sample: a = tables of its pairs that occur more than once, b = root tables of its words
    kind 1: a = tables that a target adds to the home's contexts
    kind 2: a = sums over the frequent words (as dishes, as contexts) and over the other words (root customers, root tables)
    """
    shared = parts.sparkSession.sparkContext.broadcast(model)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.customers)
        sums, any_ = np.zeros(2 * k + 2), False
        for b in batches:
            for r in b.to_pylist():
                p = Part.of(r)
                rng = np.random.default_rng([seed, r["target"]])
                total = p.spread(model.tables, [(g["home"], np.frombuffer(g["totals"], np.float32)) for g in r["got"] or []])
                live = p.count > 1
                word, context, c = p.word[live], p.context[live], p.count[live]
                cold = p.hot < 0
                once = np.bincount(p.word[p.count == 1], minlength=len(p.hot)).astype(np.float64)
                prob = (p.word_count + 1.0) / (model.n + model.v + 1.0)
                prob[~cold] = model.root_probability(model.dish, model.dish_tables)[p.hot[~cold]]
                for _ in range(2):
                    t = model.seat(c, total[context], prob[word], rng)
                    tw = once + np.bincount(word, weights=t, minlength=len(p.hot))
                    s = np.zeros(len(tw))
                    s[cold] = model.seat_root(tw[cold], rng)
                    prob[cold] = model.root_probability(tw[cold], s[cold])
                tu = np.bincount(context, weights=t, minlength=len(total))
                # of frequent contexts, pairs that occur once count as well
                first = len(p.context_hot)
                tu[:first] += np.bincount(p.context[p.count == 1], minlength=len(total))[:first]
                sums[:k] += np.bincount(p.hot[~cold], weights=tw[~cold], minlength=k)
                sums[k : 2 * k] += np.bincount(p.context_hot, weights=tu[:first], minlength=k)
                sums[-2:] += tw[cold].sum(), s[cold].sum()
                any_ = True
                out = [(0, r["target"], None, seed, pack(t.astype(np.int64)), pack(s.astype(np.int64)))]
                out += [(1, r["target"], int(h), seed, pack(tu[x : x + a].astype(np.int64)), None) for h, a, x in zip(*p.homes[:2], p.starts(), strict=True) if a]
                yield rows(SWEEP_SCHEMA, out)
        if any_:
            yield rows(SWEEP_SCHEMA, [(2, None, None, seed, sums.tobytes(), None)])

    own = parts.where("kind = 0").select("target", "word_hot", "word_count", "word_pairs", "pair_context", "pair_count", "context_hot", "homes")
    return written(beside(own, replies, "target", "home", "totals").mapInArrow(one, SWEEP_SCHEMA), "lm-sweep")


def added(df: DataFrame, col: str) -> np.ndarray | float:
    """The sum of arrays of doubles, added in tasks first."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                x = np.frombuffer(x)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    return sum((np.frombuffer(r["x"]) for r in df.select(col).repartition(8).mapInArrow(one, "x binary").collect()), 0.0)


def after(model: Model, swept: DataFrame, freq: Frequent, counts: np.ndarray, seed: int) -> tuple[Model, np.ndarray]:
    """The model with the totals of a sweep, and the tables of the frequent pairs, which are seated here."""
    k = len(freq.words)
    rng = np.random.default_rng([seed, 1 << 32])
    sums = added(swept.where("kind = 2"), "a") + np.zeros(2 * k + 2)
    t = model.seat(counts, model.tables[freq.context], model.root_probability(model.dish, model.dish_tables)[freq.word], rng)
    dish = sums[:k] + np.bincount(freq.word, weights=t, minlength=k)
    s = model.seat_root(dish, rng)
    return replace(model, dish=dish, dish_tables=s, tables=sums[k : 2 * k] + np.bincount(freq.context, weights=t, minlength=k), root=float(dish.sum() + sums[-2]), root_tables=float(s.sum() + sums[-1])), t


def final_replies(home: DataFrame, swept: DataFrame) -> DataFrame:
    """target, home, customers, totals: of all contexts a target has; totals by sample, each less the sample before."""
    schema = "target int, home int, customers binary, totals binary"

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                customers, fixed, asks, places = unpack(r["customers"]), unpack(r["fixed"]), np.frombuffer(r["asks"], np.int64).reshape(-1, 3), unpack(r["places"])
                cut = np.concatenate([[0], np.cumsum(asks[:, 2])])
                ask = {int(t): places[x : x + n] for (t, _, n), x in zip(asks, cut[:-1], strict=True)}
                live = {int(t): a for t, a, _ in asks}
                totals: dict[int, np.ndarray] = {}
                for g in r["got"] or []:
                    totals.setdefault(g["sample"], fixed.copy())[ask[g["target"]][: live[g["target"]]]] += unpack(g["a"])
                totals = totals or {0: fixed}
                grid = np.stack([totals[k] for k in sorted(totals)]) - fixed
                yield rows(schema, [(t, r["home"], pack(customers[x]), pack(np.concatenate([fixed[x], grid[:, x].ravel()]))) for t, x in ask.items()])

    return beside(home, swept.where("kind = 1"), "home", "sample", "target", "a").mapInArrow(one, schema)


def part_sums(parts: DataFrame, drawn: DataFrame, replies: DataFrame, models: list[Model], word_counts: np.ndarray) -> DataFrame:
    """batch, kind, docs, base, score, known: sums over a batch's pairs in one target, and the batch's manifest."""
    shared = parts.sparkSession.sparkContext.broadcast((models, word_counts))
    schema = "batch long, kind int, docs binary, base binary, score binary, known binary"

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, word_counts = shared.value
        for b in batches:
            for r in b.to_pylist():
                p = Part.of(r)
                cold = p.hot < 0
                live = p.count > 1
                got = [(g["home"], unpack(g["customers"]), unpack(g["totals"])) for g in r["got"] or []]
                sizes = {h: len(c) for h, c, _ in got}
                samples = {g["sample"]: (unpack(g["a"]), unpack(g["b"])) for g in r["samples"]}
                customers = p.spread(models[0].customers, [(h, c) for h, c, _ in got])[p.context]
                prob = 0.0
                for i, (k, model) in enumerate(zip(sorted(samples), models, strict=True)):
                    # a home that no pair is seated in has one row of totals for all samples
                    part = [(h, x[: (n := sizes[h])] + x[n * (j := min(i + 1, len(x) // n - 1)) : n * (j + 1)]) for h, _, x in got]
                    total = p.spread(model.tables, part)[p.context]
                    t = (p.count > 0).astype(np.float64)
                    t[live] = samples[k][0]
                    tw = np.bincount(p.word, weights=t, minlength=len(p.hot))
                    root = model.root_probability(tw, samples[k][1])
                    root[~cold] = model.root_probability(model.dish, model.dish_tables)[p.hot[~cold]]
                    prob = prob + model.predict(p.count, t, customers, total, root[p.word])
                logp = np.log10(prob / len(models))
                wc = p.word_count.copy()
                wc[~cold] = word_counts[p.hot[~cold]]
                occurs = unpack_ones(r["seen"])
                doc = unpack(r["post_batch"]) << 16 | np.frombuffer(r["post_doc"], np.uint16) & 0x7FFF
                order = np.argsort(doc, kind="stable")
                doc = doc[order]
                pair = np.repeat(np.arange(len(occurs)), occurs)[order]
                at = heads(doc)
                sums = [np.add.reduceat(x[pair], at) for x in (np.log10(wc + 1.0)[p.word], logp, (wc > 0).astype(np.int64)[p.word])]
                doc = doc[at]
                owner = np.frombuffer(r["batches"], np.int64)
                edge = np.searchsorted(doc >> 16, np.arange(len(owner) + 1))
                yield rows(schema, [(int(own), 0, pack(doc[x:y] & 0xFFFF), sums[0][x:y].astype(np.float32).tobytes(), sums[1][x:y].astype(np.float32).tobytes(), pack(sums[2][x:y])) for own, x, y in zip(owner, edge[:-1], edge[1:], strict=True)])

    own = parts.where("kind = 0").select("target", "word_hot", "word_count", "word_pairs", "pair_context", "pair_count", "context_hot", "homes", "seen", "post_batch", "post_doc", "batches")
    full = beside(beside(own, drawn.where("kind = 0"), "target", "sample", "a", "b").withColumnRenamed("got", "samples"), replies, "target", "home", "customers", "totals")
    manifest = parts.where("kind = 1").select("batch", "kind", F.col("word_hot").alias("docs"), F.col("word_count").alias("base"), F.col("word_pairs").alias("score"), F.lit(b"").alias("known"))
    return full.mapInArrow(one, schema).unionByName(manifest)


def add_sums(sums: DataFrame) -> DataFrame:
    """doc_id, th, base, score, known of the pairs that are not frequent."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        ids: dict[int, tuple] = {}
        for b in batches:
            for r in b.to_pylist():
                k = r["batch"]
                if r["kind"] == 1:
                    ids[k] = tuple(np.frombuffer(r[x], t) for x, t in (("docs", np.int64), ("base", np.int64), ("score", bool)))
                    continue
                d = unpack(r["docs"])
                x = acc.get(k, np.zeros((3, 0)))
                if x.shape[1] <= d[-1]:
                    x = np.concatenate([x, np.zeros((3, int(d[-1]) + 1 - x.shape[1]))], axis=1)
                x[:, d] += (np.frombuffer(r["base"], np.float32), np.frombuffer(r["score"], np.float32), unpack(r["known"]))
                acc[k] = x
        for k, (d, th, ok) in ids.items():
            x = acc.get(k, np.zeros((3, 0)))
            x = np.concatenate([x, np.zeros((3, len(d) - x.shape[1]))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(d, mask=~ok), pa.array(th), pa.array(x[0]), pa.array(x[1]), pa.array(x[2].astype(np.int64))], names=["doc_id", "th", "base", "score", "known"])

    return sums.repartition("batch").mapInArrow(one, "doc_id long, th long, base double, score double, known long")


def hot_sums(docs: DataFrame, freq: Frequent, logp: np.ndarray, logc: np.ndarray, known: np.ndarray) -> DataFrame:
    """doc_id, th, fold, n_tokens and the frequent pairs' sums of each text."""
    shared = docs.sparkSession.sparkContext.broadcast((freq, logp, logc[freq.word], known[freq.word].astype(np.uint8)))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, logp, logc, known = shared.value
        split = freq.splitter()
        for b in batches:
            for i, n, buf, off in text_chunks(b.column("text")):
                word, context, doc = tokens(buf, off)
                pair = split(word, context)[2]
                own = pair >= 0
                pair, at = pair[own], doc[own]
                cols = [np.bincount(doc, minlength=n), *(np.bincount(at, weights=x[pair], minlength=n).astype(np.float64) for x in (logc, logp)), np.bincount(at, weights=known[pair], minlength=n).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, n) for c in ("doc_id", "th", "fold")), *map(pa.array, cols)], names=["doc_id", "th", "fold", "n_tokens", "hot_base", "hot_score", "hot_known"])

    return docs.mapInArrow(one, "doc_id long, th long, fold int, n_tokens long, hot_base double, hot_score double, hot_known long")


def discount(one: float, two: float) -> float:
    """From the numbers of dishes eaten once and twice."""
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def count_stats(parts: DataFrame, k: int) -> np.ndarray:
    """Sums over targets: of frequent words the customers as dishes and as contexts; then of the other
    words the number and customers, and pairs that occur once and twice."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                p = Part.of(r)
                cold = p.hot < 0
                by = np.bincount(p.context, weights=p.count, minlength=len(p.context_hot))[: len(p.context_hot)]
                x = np.concatenate([np.bincount(p.hot[~cold], weights=p.word_count[~cold], minlength=k), np.bincount(p.context_hot, weights=by, minlength=k), [(p.word_count[cold] > 0).sum(), p.word_count[cold].sum(), (p.count == 1).sum(), (p.count == 2).sum()]])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    own = parts.where("kind = 0").select("word_hot", "word_count", "word_pairs", "pair_context", "pair_count", "context_hot", "homes")
    return added(own.mapInArrow(one, "x binary"), "x") + np.zeros(2 * k + 4)


def score_documents(docs: DataFrame, sweeps: int = 1, samples: int = 3, tokens_each: int = 1_200_000) -> DataFrame:
    """doc_id, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), id_crc(F.col("doc_id"), 7).alias("fold"), "text")
    freq = frequent(keyed.where("fold <> 2"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, int(size / 6 / tokens_each) + 1)
    parts = bucketed(gather(blocks(keyed, freq, n), freq, n), "target", n, "parts")
    home = bucketed(homes(parts, n), "home", n, "homes")
    counts = np.zeros(len(freq.keys), np.int64)
    for r in parts.where("kind = 2").select("batch", "word_hot").collect():  # HOT_PAIRS counts at most
        x = unpack(r["word_hot"])[: len(counts) - r["batch"]]
        counts[r["batch"] : r["batch"] + len(x)] = x
    k = len(freq.words)
    stats = count_stats(parts, k)
    word_counts = (stats[:k] + np.bincount(freq.word, weights=counts, minlength=k)).astype(np.int64)
    customers = stats[k : 2 * k] + np.bincount(freq.context, weights=counts, minlength=k)
    v, total = int(stats[-4] + (word_counts > 0).sum()), int(stats[-3] + word_counts.sum())
    d1 = discount(stats[-2] + (counts == 1).sum(), stats[-1] + (counts == 2).sum())
    model = Model(v, total, d1, 0.5, word_counts * 0.3, (word_counts > 0) * 1.0, customers, customers * 0.3, total * 0.3, float(v))
    drawn, models, hot_logp, last = [], [], 0.0, None
    for i in range(sweeps + samples):
        last = sweep(parts, reply(home, last), model, i)
        model, t = after(model, last, freq, counts, i)
        if i >= sweeps:
            drawn.append(last)
            models.append(model)
            hot_logp = hot_logp + model.predict(counts, t, customers[freq.context], model.tables[freq.context], model.root_probability(model.dish, model.dish_tables)[freq.word])
    together = drawn[0]
    for d in drawn[1:]:
        together = together.unionByName(d)
    rest = add_sums(part_sums(parts, together, final_replies(home, together), models, word_counts)).dropDuplicates(["doc_id", "th"])
    hot_part = hot_sums(keyed, freq, np.log10(hot_logp / samples) + np.zeros(len(counts)), np.log10(word_counts + 1.0), (word_counts > 0).astype(np.int64))
    a, b = hot_part.alias("a"), rest.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")))
    return both.select(
        "a.doc_id",
        (F.col("fold") == 2).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + v + 1)))).alias("base_score"),
        (F.col("hot_score") + F.col("score")).alias("score"),
        (-F.col("hot_score") - F.col("score")).alias("_neg"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), F.col("_neg") / F.col("n_tokens"))).drop("_neg")
