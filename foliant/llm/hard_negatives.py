"""Hard-negative mining: a vantage-point tree over norm-augmented vectors.

With M at least every norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q
becomes (q, 0); then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so larger inner products are
smaller distances and a window of scores is an annulus around the anchor.  A
vantage-point tree bounds the distances of all rows below a node by the triangle
inequality.  The search takes the nodes nearest first, leaves out those that miss
the annulus, and ends when no node can hold a row before the k-th found.

The tree has two parts.  Its top is fitted on ``SAMPLE`` rows (lowest hash of the
row) and sent to all tasks, which route every row to one of at most ``LEAVES``
leaves; the least and largest distances of a leaf's rows to its vantage points are
counted over all rows.  A leaf of more than ``SHARD_ROWS`` rows is dealt into
several shards, whatever its rows have in common, so a vector that a third of all
rows share stays bounded in every task.  Each shard then builds the lower part of
the tree over its own rows.  Anchors go only to shards that can hold one of their k
rows: the sample, which are rows like others, gives a first k-th score.

All scores are integers and exact; float distances only prune, with a margin.
Every row is indexed and nothing is approximate.  Positives are found first, then
negatives of each distinct positive score.  Routed rows and found positives are
written to the shared folder.

Defined results: a row without label or vector, or with a null or non-finite
component, takes no part; nor does one whose squared norm (after scaling) is 2^58
or more, as scores would not fit a long.  Vectors of different lengths are compared
as if filled with zeros.  Rows of the same id, label and vector are one row; rows
that share only the id are different rows, but never each other's positives.  A
row without an id can be a positive or negative, last among ties, and is no anchor.
An anchor without positives, and a positive without negatives, give no rows; a
negative positive score has an empty window.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that the top of the tree is fitted on, and that give first k-th scores.
SAMPLE = 4096
#: Most leaves of the top; rows of a leaf of the lower tree; most rows of a shard, about.
LEAVES, LEAF_ROWS, SHARD_ROWS = 256, 128, 1 << 16
LIMIT = float(1 << 58)
#: A missing id, which stands after all others.
NO_ID = np.iinfo(np.int64).max


def scaled_rows(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """id, label, v (array of int: floor of each component times scale), row_hash, norm (squared)."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    norm = F.aggregate(F.transform(x, lambda c: F.floor(c * scale).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    rows = table.select(F.col(vec_id).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("x"), whole.alias("whole"), norm.alias("norm"))
    rows = rows.where(F.col("label").isNotNull() & F.col("whole") & (F.col("norm") < LIMIT))
    rows = rows.select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"), "norm")
    return rows.withColumn("row_hash", F.xxhash64("label", "v"))


def shifted_label() -> Column:
    """The label of the query's rows: one further, of ten, where 7 divides the id."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as int64 rows, short ones filled with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.asarray(col.value_lengths())
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = np.asarray(col.flatten())
    return out


def ids_of(col: pa.Array) -> np.ndarray:
    return np.asarray(col.fill_null(NO_ID))


class Space:
    """Scores and augmented distances for squared norms up to m2."""

    def __init__(self, m2: int, dim: int) -> None:
        self.m2, self.dim = m2, dim
        # doubles are exact below 2^53, and matrix products of them much faster
        self.kind = np.float64 if m2 < 1 << 52 else np.int64

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(self.kind) @ b.astype(self.kind).T).astype(np.int64)

    def extra(self, x: np.ndarray) -> np.ndarray:
        """The added component of rows."""
        return np.sqrt(np.maximum(float(self.m2) - (x.astype(float) ** 2).sum(1), 0))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of rows x to rows y, both augmented."""
        x, y = np.column_stack([x.astype(float), self.extra(x)]), np.column_stack([y.astype(float), self.extra(y)])
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T), 0))

    def squares(self, q: np.ndarray) -> np.ndarray:
        return (q.astype(float) ** 2).sum(1) + self.m2

    def from_queries(self, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose added component is 0, to rows y."""
        return np.sqrt(np.maximum(self.squares(q)[:, None] - 2.0 * self.dots(q, y), 0))

    def scores(self, squares: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest scores that distances from near to far allow."""
        margin = 1 + 1e-7 * squares
        return (squares - near**2) / 2 + margin, (squares - far**2) / 2 - margin


class Tree:
    """A vantage-point tree over rows x; ``depth`` bounds it, or the size of its leaves does."""

    def __init__(self, space: Space, x: np.ndarray, leaf_rows: int, depth: int = 64) -> None:
        self.space, self.x = space, x
        self.vantage: list[int] = []  # row
        self.radius: list[float] = []
        self.child: list[tuple[int, int]] = []  # nodes; a leaf k is -1 - k
        self.bounds: list[tuple[tuple[float, float], ...]] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(x)), leaf_rows, depth)

    def _grow(self, rows: np.ndarray, leaf_rows: int, depth: int) -> int:
        if len(rows) > leaf_rows and depth:
            # the row that is farthest from the first one tells the others apart best
            far = rows[np.argmax(self.space.between(self.x[rows], self.x[rows[:1]])[:, 0])]
            d = self.space.between(self.x[rows], self.x[far : far + 1])[:, 0]
            r = float(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
            inside = d <= r
            if not inside.all():
                k = len(self.vantage)
                for held, value in ((self.vantage, far), (self.radius, r), (self.child, (0, 0)), (self.bounds, ((d[inside].min(), r), (d[~inside].min(), d.max())))):
                    held.append(value)
                self.child[k] = tuple(self._grow(rows[m], leaf_rows, depth - 1) for m in (inside, ~inside))
                return k
        # rows that no distance tells apart stay in one leaf
        self.leaves.append(rows)
        return -len(self.leaves)

    def route(self, d: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The leaf of each row by its distances d to all vantage points."""
        node, leaf = np.full(len(d), self.root), np.full(len(d), -1)
        while (open_ := np.flatnonzero(node >= 0)).size:
            k = node[open_]
            out = (d[open_, k] > np.array(self.radius)[k]).astype(int)
            node[open_] = np.array(self.child)[k, out]
        leaf = -1 - node
        return leaf

    def paths(self) -> list[list[int]]:
        """The vantage points above each leaf."""
        found: list[list[int]] = [[] for _ in self.leaves]

        def walk(node: int, above: list[int]) -> None:
            if node < 0:
                found[-1 - node] = above
            else:
                for c in self.child[node]:
                    walk(c, [*above, node])

        walk(self.root, [])
        return found


class Shard:
    """The rows of a shard, searched nearest first."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, hashes: np.ndarray, x: np.ndarray, keep: int) -> None:
        # equal rows count once, and of rows that differ only in their ids the first ``keep`` are enough
        order = np.lexsort((ids, hashes))
        ids, labels, hashes, x = ids[order], labels[order], hashes[order], x[order]
        same = np.zeros(len(ids), bool)
        if len(ids):
            same[1:] = (hashes[1:] == hashes[:-1]) & (labels[1:] == labels[:-1]) & (x[1:] == x[:-1]).all(1)
        repeat = same & np.concatenate([[False], ids[1:] == ids[:-1]])
        ids, labels, hashes, x, same = (a[~repeat] for a in (ids, labels, hashes, x, same))
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
        few = np.arange(len(ids)) - start < keep
        self.ids, self.labels, self.hashes, self.x = (a[few] for a in (ids, labels, hashes, x))
        self.space, self.tree = space, Tree(space, self.x, LEAF_ROWS)
        t = self.tree
        self.rows = [self.x[r].astype(space.kind) for r in t.leaves]
        self.span = {}
        self._labels(t.root)

    def _labels(self, node: int) -> tuple[int, int]:
        """Least and largest label below a node."""
        if node < 0:
            own = self.labels[self.tree.leaves[-1 - node]]
            out = (int(own.min()), int(own.max())) if len(own) else (1, 0)
        else:
            a, b = (self._labels(c) for c in self.tree.child[node])
            out = (min(a[0], b[0]), max(a[1], b[1]))
        self.span[node] = out
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        return self.space.from_queries(q, self.x[self.tree.vantage])

    def first(self, q: np.ndarray, square: float, d: np.ndarray, own: int, label: int, same: bool, low: float, high: float, k: int, cache: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
        """The first k rows (score descending, then id) of the anchor's label, or of
        others, with scores from low to high, as (-score, id, hash)."""
        t, found, margin = self.tree, [], 1 + 1e-7 * square
        heap: list[tuple[float, int, float, float]] = [(-math.inf, t.root, 0.0, math.inf)]
        while heap:
            worst, node, near, far = heapq.heappop(heap)
            if len(found) == k and -worst < -found[-1][0]:
                break
            least, most = self.span[node]
            if (not least <= label <= most) if same else least == most == label:
                continue
            if node < 0:
                leaf = -1 - node
                rows = t.leaves[leaf]
                if leaf not in cache:
                    cache[leaf] = (self.rows[leaf] @ q).astype(np.int64)
                s = cache[leaf]
                ok = (s >= low) & (s <= high) & ((self.labels[rows] == label) == same) & (self.ids[rows] != own)
                if len(found) == k:
                    ok &= s >= -found[-1][0]
                if ok.any():
                    r = rows[ok]
                    found = sorted(found + list(zip((-s[ok]).tolist(), self.ids[r].tolist(), self.hashes[r].tolist(), strict=True)))[:k]
                continue
            at = d[node]
            for child, (a, b) in zip(t.child[node], t.bounds[node], strict=True):
                n, f = max(near, at - b, a - at), min(far, at + b)
                best = (square - n * n) / 2 + margin
                if best >= low and (f == math.inf or (square - f * f) / 2 - margin <= high):
                    heapq.heappush(heap, (-best, child, n, f))
        return found


class Top:
    """The top of the tree, fitted on a sample; its leaves' bounds hold for all rows."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaves: int) -> None:
        self.space, self.ids, self.labels, self.x = space, ids, labels, x
        tree = Tree(space, x, max(1, len(x) // (2 * leaves)), max(0, math.ceil(math.log2(leaves))))
        self.points, self.tree, self.paths = x[tree.vantage], tree, tree.paths()
        self.bounds: np.ndarray | None = None
        self.shards: list[range] = []

    def leaf_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, and its distances to all vantage points."""
        d = self.space.between(x, self.points)
        return self.tree.route(d), d

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest score that each leaf allows for each anchor."""
        d, squares = self.space.from_queries(q, self.points), self.space.squares(q)
        near, far = np.zeros((len(q), len(self.paths))), np.full((len(q), len(self.paths)), np.inf)
        for leaf, path in enumerate(self.paths):
            for k in path:
                a, b = self.bounds[leaf, k]
                near[:, leaf] = np.maximum(near[:, leaf], np.maximum(d[:, k] - b, a - d[:, k]))
                far[:, leaf] = np.minimum(far[:, leaf], d[:, k] + b)
        with np.errstate(invalid="ignore"):
            most, least = self.space.scores(squares[:, None], near, far)
        empty = np.array([not len(s) for s in self.shards])
        most[:, empty] = -np.inf
        return most, least


def fitted(rows: DataFrame) -> tuple[Top, DataFrame] | None:
    """The tree's top, and all rows with their shard; None for no rows."""
    n, m2, dim = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v"))).first()
    if not n:
        return None
    # a double's square sum is off by less than its dimension times 2^-52
    space = Space(int(m2 * (1 + 1e-9)) + 1, dim)
    sample = rows.orderBy(F.xxhash64("id", "row_hash"), "id", "row_hash").limit(SAMPLE).dropDuplicates(["id", "row_hash"]).select("id", "label", "v").toArrow()
    leaves = 1 << math.ceil(math.log2(min(LEAVES, max(8, n / 4096))))
    top = Top(space, ids_of(sample["id"].combine_chunks()), np.asarray(sample["label"]), matrix(sample["v"], dim), leaves)
    points = len(top.points)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            leaf, d = top.leaf_rows(matrix(b.column("v"), dim))
            # dealt by their place, so that rows that are equal in all are dealt as well
            deal = (np.arange(seen, seen + len(leaf)) + part * 7919) % (1 << 31)
            seen += len(leaf)
            near = pa.FixedSizeListArray.from_arrays(pa.array(d.reshape(-1)), points) if points else pa.array([[]] * len(leaf), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(deal, pa.int64()), near.cast(pa.list_(pa.float64())), *(b.column(c) for c in ("id", "label", "row_hash", "v"))], names=["leaf", "deal", "near", "id", "label", "row_hash", "v"])

    routed = rows.select("id", "label", "row_hash", "v").mapInArrow(route, "leaf int, deal long, near array<double>, id long, label long, row_hash long, v array<int>")
    depth = max(map(len, top.paths), default=0)
    above = F.array(*[F.array(*[F.lit(k) for k in p]).cast("array<int>") for p in top.paths])
    routed = routed.withColumn("near", F.transform(F.get(above, F.col("leaf")), lambda k: F.get("near", k)))
    routed = written(routed, "negatives-rows")
    counted = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(F.get("near", F.lit(i))).alias(f"{w}{i}") for i in range(depth) for w, f in (("a", F.min), ("b", F.max))]).collect()
    counted = {r["leaf"]: r for r in counted}
    top.bounds, first = np.zeros((len(top.paths), max(1, points), 2)), 0
    for leaf, path in enumerate(top.paths):
        r = counted.get(leaf)
        size = math.ceil(r["n"] / SHARD_ROWS) if r else 0
        top.shards.append(range(first, first + size))
        first += size
        for i, k in enumerate(path if r else []):
            top.bounds[leaf, k] = r[f"a{i}"], r[f"b{i}"]
    firsts, sizes = (F.array(*[F.lit(int(x)) for x in xs]) for xs in ([s.start for s in top.shards], [max(1, len(s)) for s in top.shards]))
    shard = F.get(firsts, F.col("leaf")) + F.col("deal") % F.get(sizes, F.col("leaf"))
    return top, routed.select(shard.cast("int").alias("shard"), "id", "label", "row_hash", "v")


def kth(scores: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row among those that are ok; minus infinity for fewer."""
    s = np.where(ok, scores.astype(float), -np.inf)
    return np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)


def window(p: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores from low to high hundredths of p, as whole numbers."""
    g = math.gcd(low, high, 100)
    low, high, base = low // g, high // g, 100 // g
    return -((-low * p) // base), (high * p) // base


def searched(top: Top, shards: DataFrame, queries: DataFrame, k: int, same: bool, low: int = 0, high: int = 0, keep: int = 10) -> DataFrame:
    """qid, anchor, p, id, score, row_hash: the first k rows of each query (qid, id,
    label, v, ps) and, for negatives, of each of its positive scores ps."""
    dim, n_shards = top.space.dim, max(1, sum(map(len, top.shards)))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                q, ids, labels = matrix(part.column("v"), dim), ids_of(part.column("id")), np.asarray(part.column("label"))
                most, least = top.reach(q)
                s = top.space.dots(q, top.x)
                alike = labels[:, None] == top.labels
                if same:
                    visit = most >= kth(s, alike & (ids[:, None] != top.ids), k)[:, None] - 1
                else:
                    visit = np.zeros(most.shape, bool)
                    n = np.asarray(part.column("ps").value_lengths())
                    own, p = np.repeat(np.arange(len(n)), n), np.asarray(part.column("ps").flatten())
                    lo, hi = window(p, low, high)
                    for j in range(0, len(own), 512):
                        o, a, z = own[j : j + 512], lo[j : j + 512, None], hi[j : j + 512, None]
                        floor = np.maximum(a, kth(s[o], ~alike[o] & (s[o] >= a) & (s[o] <= z), k)[:, None] - 1)
                        np.logical_or.at(visit, o, (most[o] >= floor) & (least[o] <= z) & (a <= z))
                for leaf in np.flatnonzero(visit.any(0)):
                    rows = part.take(pa.array(np.flatnonzero(visit[:, leaf])))
                    for shard in top.shards[leaf]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, shard, np.int32)), *rows.columns], names=["shard", *rows.schema.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = -1, [], None
        for b in batches:
            numbers, is_query = np.asarray(b.column("shard")), np.asarray(b.column("qid").is_valid())
            edge = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for i, j in zip([0, *edge], [*edge, len(numbers)], strict=True):
                part = b.slice(int(i), int(j - i))
                if numbers[i] != at:
                    at, held, shard = numbers[i], [], None
                if not is_query[i]:
                    held.append((ids_of(part.column("id")), np.asarray(part.column("label")), np.asarray(part.column("row_hash")), matrix(part.column("v"), dim)))
                elif held or shard:
                    if shard is None:
                        shard, held = Shard(top.space, *(np.concatenate(x) for x in zip(*held, strict=True)), keep), []
                    yield from answer(shard, part)

    def answer(shard: Shard, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, ids, labels = matrix(part.column("v"), dim), ids_of(part.column("id")), np.asarray(part.column("label"))
        d, squares, qk, out = shard.distances(q), top.space.squares(q), q.astype(top.space.kind), []
        qids, ps = part.column("qid").to_pylist(), part.column("ps").to_pylist()
        for i, qid in enumerate(qids):
            cache: dict[int, np.ndarray] = {}
            for p in [0] if same else ps[i]:
                lo, hi = (-math.inf, math.inf) if same else window(p, low, high)
                if lo <= hi:
                    found = shard.first(qk[i], squares[i], d[i], ids[i], labels[i], same, lo, hi, k, cache)
                    out += [(qid, int(ids[i]), p, None if x == NO_ID else x, -s, h) for s, x, h in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["qid", "anchor", "p", "id", "score", "row_hash"])

    asked = queries.select("qid", "id", "label", "v", "ps").mapInArrow(plan, "shard int, qid long, id long, label long, v array<int>, ps array<long>")
    both = shards.select("shard", F.lit(None).cast("long").alias("qid"), "id", "label", "v", F.lit(None).cast("array<long>").alias("ps"), "row_hash")
    both = both.unionByName(asked.withColumn("row_hash", F.lit(None).cast("long")))
    # a shard's rows stand before the anchors that visit it
    both = both.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", F.col("qid").isNotNull())
    found = both.mapInArrow(search, "qid long, anchor long, p long, id long, score long, row_hash long")
    best = F.row_number().over(Window.partitionBy("qid", "p").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row_hash"))
    # equal rows of several shards are one row
    return found.dropDuplicates(["qid", "p", "id", "row_hash"]).withColumn("rank", best).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """rows: id, label, v, row_hash, norm (``scaled_rows``) -> anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    keep = max(k, positives + 1)
    index = fitted(rows)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    top, shards = index
    queries = rows.where(anchors & F.col("id").isNotNull()).select("id", "label", "v", "row_hash").dropDuplicates(["id", "row_hash"])
    queries = written(queries.withColumn("qid", F.monotonically_increasing_id()), "negatives-anchors")
    none = F.lit(None).cast("array<long>")
    near = written(searched(top, shards, queries.withColumn("ps", none), positives, True, keep=keep), "negatives-positives")
    asked = near.groupBy("qid").agg(F.collect_set("score").alias("ps"))
    far = searched(top, shards, queries.join(asked, "qid"), k, False, low, high, keep)
    p, n = near.alias("p"), far.alias("n")
    both = p.join(n, (F.col("p.qid") == F.col("n.qid")) & (F.col("p.score") == F.col("n.p")))
    return both.select(F.col("p.anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def mined(table: DataFrame, every: int = 100) -> DataFrame:
    """The query's rows: shifted labels, 256ths, anchors whose id ``every`` divides."""
    return hard_negatives(scaled_rows(table, label=shifted_label()), F.col("id") % every == 0)


def oracle_sql(every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> str:
    """DuckDB SQL for op11: all scores of the anchors."""
    return f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor({scale} * cast(c as double))) as v from embeddings
where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c)))),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id % {every} = 0 and b.vec_id is distinct from a.vec_id),
p as (select * from s where label = own qualify row_number() over (partition by anchor_id order by score desc, vec_id nulls last) <= {positives})
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id nulls last) as integer) as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and n.label <> n.own and {low} * p.score <= 100 * n.score and 100 * n.score <= {high} * p.score
qualify rank <= {k}"""
