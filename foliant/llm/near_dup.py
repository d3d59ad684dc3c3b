"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find.

1. Sketch: each text's set of distinct 5-word shingles is hashed; SuperMinHash
   draws, per shingle, a random permutation of the registers and ascending ranks,
   and stops once no register can fall.  One pass, no shuffle.
2. Texts with equal sets collapse to one node by a digest of the set, a partial
   aggregate; copies are never compared.
3. Banding: 25 bands of 5 registers (a pair of similarity 0.85 shares none with
   a probability of 5e-7) and 8 strict bands of 15 registers.  Each node is
   paired with the leader of each strict bucket and with its least leader of all
   others; the pairs are verified on the full sets and grouped by union-find.
4. What is left: in a bucket that still holds several groups, the members
   outside its largest group are compared with the other groups' members.  The
   bucket is dealt into blocks, so no task holds more than two blocks.  There,
   pairs whose registers agree too little (by five standard deviations of the
   estimate) go, and the others are tested, the most alike first, until a member
   has a link to the other group.  Only such links leave the task; they are
   confirmed on the full sets and grouped.
5. Groups: union-find within each partition leaves a spanning forest; then labels
   fall to the minimum over shuffled joins until nothing changes.

So no pair is formed between copies or within a group already joined; only
members that link to nothing in their bucket are compared with all of it.

Defined results: a text without words has an empty set, and links to nothing; a
row without doc_id links to nothing (component_id null, kept true); repeated rows
of an id share its component; an empty table gives an empty result; ties cannot
matter, as links and minima don't depend on order; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, text_chunks, words, written

WIDTH = 5
REGISTERS = 125
BAND, STRICT = 5, 15
BLOCK = 512

_C = mix(np.arange(1, 65, dtype=U)) | U(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each document; offsets)."""
    h, _, _, woff = words(buf, off)
    n = np.diff(woff)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h), U)
        for j in range(width):
            acc[: len(h) - j] += h[j:] * _C[j]
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        soff = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(n)), count)
        at = woff[:-1][doc] + np.arange(soff[-1]) - soff[:-1][doc]
        x = acc[at]
        for d in np.flatnonzero((n > 0) & (n < width)):  # the whole sequence as one
            x[soff[d]] = (h[woff[d] : woff[d + 1]] * _C[8 : 8 + n[d]]).sum(dtype=U) + U(n[d])
        x = mix(x)
    for a, b in zip(soff[:-1], soff[1:], strict=True):
        if b - a > 1:
            x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    keep[soff[:-1][count > 0]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[soff]


def superminhash(x: np.ndarray, off: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (documents x m) of sets of hashes; empty sets stay infinite."""
    docs = len(off) - 1
    out = np.full((docs, m), np.inf)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(docs), np.diff(off))
    top = np.full(docs, m - 1.0)
    swaps: list[np.ndarray] = []
    perm = None
    for j in range(m):
        live = top[doc] >= j
        if not live.all():
            x, doc = x[live], doc[live]
            swaps = [k[live] for k in swaps]
            perm = perm[live] if perm is not None else None
        if not len(x):
            break
        with np.errstate(over="ignore"):
            u = mix(x + U(2 * j + 1) * _C[60])
            k = j + (((mix(u ^ _C[61]) >> U(32)) * U(m - j)) >> U(32)).astype(np.int64)
        if perm is None and j >= 6:  # few are left: hold their permutations themselves
            perm = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
            rows = np.arange(len(x))
            for i, s in enumerate(swaps):
                perm[rows, s], perm[rows, i] = perm[rows, i], perm[rows, s]
            swaps = []
        if perm is None:
            place = k
            for i in range(j - 1, -1, -1):
                place = np.where(swaps[i] == place, i, place)
            swaps.append(k)
        else:
            rows = np.arange(len(x))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, doc * m + place, (u >> U(11)) * 2.0**-53 + j)
        top = np.minimum(np.floor(out.max(1)), m - 1)
    return out


def band_keys(bits: np.ndarray, rows: int) -> np.ndarray:
    """(documents x bands) keys of bands of so many registers."""
    docs, m = bits.shape
    bands = m // rows
    with np.errstate(over="ignore"):
        x = bits[:, : bands * rows].reshape(docs, bands, rows) * _C[:rows]
        return mix(x.sum(2, dtype=U) + (np.arange(bands, dtype=U) + U(rows * 1000)) * _C[62])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, node (digest of the set), bands, strict, marks (register fingerprints)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, buf, off in text_chunks(b.column("text"), 1 << 21):
                x, soff = shingle_sets(buf, off)
                size = np.diff(soff)
                bits = mix(superminhash(x, soff).view(U))
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(x ^ _C[63]), dtype=U)])
                    node = mix(total[soff[1:]] - total[soff[:-1]] + size.astype(U)).view(np.int64)
                keys, strict = (band_keys(bits, r).view(np.int64) for r in (BAND, STRICT))
                marks = (bits >> U(48)).astype(np.uint16)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k.shape[1]), pa.array(k.reshape(-1))) for k in (keys, strict)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), pa.array(size.astype(np.int64)), pa.array(node), *lists, pa.array([r.tobytes() for r in marks], pa.binary())], names=["doc_id", "n", "node", "bands", "strict", "marks"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "doc_id long, n long, node long, bands array<long>, strict array<long>, marks binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """text -> node, items: the sets themselves."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, off in text_chunks(b.column("text")):
                x, soff = shingle_sets(buf, off)
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(x ^ _C[63]), dtype=U)])
                    node = mix(total[soff[1:]] - total[soff[:-1]] + np.diff(soff).astype(U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(soff.astype(np.int32)), pa.array(x.view(np.int64)))], names=["node", "items"])

    return docs.select("text").mapInArrow(emit, "node long, items array<long>")


def forest(edges: DataFrame) -> DataFrame:
    """a, b edges -> per partition, a node and the least node of its tree: union-find."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        for i in range(0, len(pairs), 50_000):
            a, b = zip(*pairs[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """a, b edges -> node, root: the least node of each connected component; nodes without edges are left out."""
    e = forest(edges)
    e = written(e.union(e.select("b", "a")).distinct(), "edges").toDF("a", "b")
    labels = written(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = e.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        fallen = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        fallen = written(fallen, "labels")
        # a label's own label: paths halve
        up = fallen.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        after = written(fallen.join(up, "root", "left").select("node", "old", F.least("root", "upper").alias("root")), "labels")
        if after.where("root < old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = pairs.join(b, "b").join(a, "a")
    inter = F.size(F.array_intersect("ia", "ib"))
    union = F.size("ia") + F.size("ib") - inter
    return both.where(100 * inter >= percent * union).select("a", "b")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending arrays of distinct items are as similar."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    inter = int((b[at] == a).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def compare_blocks(t: pa.Table, least: int, percent: int) -> tuple[list[int], list[int]]:
    """Links between the two sides of one task: one at most of a left member to a group.

    Members are tested in order of their agreeing registers, and only in the
    first band that a pair shares.
    """
    band = t["band"][0].as_py()
    side, nodes, roots = (t[c].to_numpy() for c in ("side", "node", "root"))
    marks = np.frombuffer(b"".join(t["marks"].to_pylist()), np.uint16).reshape(len(side), -1)
    items = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["items"]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = [], []
    for i in left:
        j = right[roots[right] != roots[i]]
        same = marks[j] == marks[i]
        agree = same.sum(1)
        keep = np.flatnonzero(agree >= least)
        keep = keep[same[keep].reshape(len(keep), REGISTERS // BAND, BAND).all(2).argmax(1) == band]
        done = set()
        for k in keep[np.argsort(-agree[keep], kind="stable")]:
            if roots[j[k]] not in done and similar(items[i], items[j[k]], percent):
                done.add(roots[j[k]])
                a.append(min(nodes[i], nodes[j[k]]))
                b.append(max(nodes[i], nodes[j[k]]))
    return a, b


def block_links(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """Members of blocks (task, band, side, node, root, marks, items) -> links a, b of different groups."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partitions are sorted by task; one task's members are held at a time
        held: pa.Table | None = None

        def done(t: pa.Table):
            task = t["task"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            a, b = [], []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                p, q = compare_blocks(t.slice(x, y - x), least, percent)
                a += p
                b += q
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            if len(b):
                held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held else pa.Table.from_batches([b])
                task = held["task"].to_numpy()
                if last := int(np.searchsorted(task, task[-1])):
                    yield done(held.slice(0, last).combine_chunks())
                    held = held.slice(last)
        if held:
            yield done(held.combine_chunks())

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(emit, "a long, b long")


def short_items(sets: DataFrame) -> DataFrame:
    """node, items -> node, items: the sets as 32-bit hashes, ascending; what they link is confirmed on the full sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.sort((np.asarray(x.values).view(U) >> U(32)).astype(np.uint32)).tobytes() for x in b.column("items")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], names=["node", "items"])

    return sets.mapInArrow(emit, "node long, items binary")


def left_links(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Links in buckets that still hold several groups.

    buckets: key, band, node; nodes: node, root, marks.
    """
    rooted = buckets.join(nodes.select("node", "root"), "node")
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    # groups of a bucket: their number, members, and the largest (ties: the least root)
    tops = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("c").alias("members"), F.max(F.struct("c", (-F.col("root")).alias("minus"))).alias("top")).where("groups > 1")
    tops = tops.select("key", (-F.col("top.minus")).alias("largest"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("members") - F.col("top.c")) / BLOCK).cast("int").alias("rest"))
    live = rooted.join(tops, "key").join(nodes.select("node", "marks"), "node").join(short_items(sets), "node")
    h = F.xxhash64("key", "node")
    common = ["band", "side", "node", "root", "marks", "items"]
    left = live.where("root <> largest").withColumns({"side": F.lit(0), "r": F.pmod(h, "rest").cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    right = live.withColumns({"side": F.lit(1), "b": F.pmod(h, "blocks").cast("int"), "r": F.explode(F.sequence(F.lit(0), F.col("rest") - 1))})
    dealt = [x.select(F.xxhash64("key", "r", "b").alias("task"), *common) for x in (left, right)]
    return block_links(dealt[0].union(dealt[1]), least, percent).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept."""
    sk = written(sketches(docs), "sketch")
    some = sk.where("n > 0 and doc_id is not null")
    mins = some.groupBy("node").agg(F.min("doc_id").alias("least"))
    # one row of each node carries its bands: the least document's
    reps = some.join(mins.select(F.col("node").alias("own"), F.col("least").alias("doc_id")), "doc_id").where("node = own").dropDuplicates(["node"])
    reps = written(reps.select("node", "doc_id", "n", "bands", "strict", "marks"), "nodes")

    def buckets(column: str) -> DataFrame:
        keyed = reps.select("node", F.posexplode(column).alias("band", "key"))
        shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1").select("key", "leader")
        return keyed.join(shared, "key")

    loose = written(buckets("bands"), "buckets")
    needed = loose.select("node").distinct().join(reps.select("node", "doc_id"), "node")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(needed.select(F.col("node").alias("own"), "doc_id"), "doc_id").select("own", "text")
    sets = written(full_sets(texts.select("text")).dropDuplicates(["node"]), "sets")
    stars = buckets("strict").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    stars = stars.union(loose.where("node <> leader").groupBy("node").agg(F.min("leader").alias("a")).select("a", F.col("node").alias("b"))).distinct()
    links = written(confirmed(stars, sets, percent), "links")
    first = components(links)
    state = written(reps.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "marks", "n"), "state")
    # five deviations of the estimate below the threshold
    p = percent / 100
    least = max(1, int(REGISTERS * p - 5 * (REGISTERS * p * (1 - p)) ** 0.5))
    more = confirmed(left_links(loose.select("key", "band", "node"), state, sets, least, percent), sets, percent)
    every = written(links.union(more), "links")
    roots = components(every)
    label = roots.join(mins, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    where = roots.join(label, "root").select("node", "component_id")
    by_node = mins.join(where, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = sk.select("doc_id", "n", "node").join(by_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that their group keeps."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
