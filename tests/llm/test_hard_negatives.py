"""Hard negatives against all scores of the anchors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives as hn


def brute(rows, every=100, positives=5, k=10, low=30, high=90, scale=256):
    clean = set()
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        ints = tuple(math.floor(scale * float(np.float32(x))) for x in v)
        if sum(x * x for x in ints) < hn.LIMIT:
            clean.add((i, label, ints))
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, own, q in clean:
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, v, strict=False)), i, label) for i, label, v in clean if i != a]
        for p, pid, _ in sorted((s for s in scored if s[2] == own), key=key)[:positives]:
            window = sorted((s for s in scored if s[2] != own and low * p <= 100 * s[0] <= high * p), key=key)[:k]
            out += [(a, pid, r + 1, n, p, s) for r, (s, n, _) in enumerate(window)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def vectors(rng, n, dim=6):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, rng.randrange(10), [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = vectors(rng, 700)
    hot = out[5][2]
    # one vector that a third of all rows share, also among the anchors, and ties
    out += [(i, i % 3, hot) for i in range(700, 1050)]
    out += [(100_000 + i, 4, [float(i % 3)] * 6) for i in range(40)]
    # odd rows: repeats, one id twice, no id, nulls, short and empty vectors, huge values
    out += [out[3], out[3], (300, 4, hot), (None, 1, hot), (None, 2, out[9][2]), (11, None, hot), (12, 1, None), (13, 1, [None] * 6), (14, 1, [math.nan] * 6), (15, 1, [math.inf] * 6), (200, 3, [0.5, 0.25]), (17, 3, []), (18, 2, [3e37] * 6), (19, 2, [1e5] * 6), (400, -3, [-1.0] * 6)]
    return out


def test_mined_rows_equal_all_scores(spark, monkeypatch, rows):
    monkeypatch.setattr(hn, "SHARD_ROWS", 60)
    monkeypatch.setattr(hn, "SAMPLE", 64)
    # an extra column with the name of an inner one
    same(hn.mined(table(spark, rows).withColumn("v", F.lit(1)).repartition(3)).collect(), brute(rows))


def test_other_parameters(spark, rows):
    got = hn.hard_negatives(hn.scaled_rows(table(spark, rows), label=hn.shifted_label(), scale=16), F.col("id") % 50 == 0, positives=2, k=3, low=10, high=120)
    same(got.collect(), brute(rows, 50, 2, 3, 10, 120, 16))


def test_no_rows_no_anchors_and_lonely_anchors(spark):
    for odd in ([], [(1, 1, [1.0]), (2, 2, [1.0])], [(100, 1, [1.0]), (2, 2, [1.0])], [(100, 1, None)], [(100, 1, [1.0]), (1, 1, [1.0])]):
        same(hn.mined(table(spark, odd)).collect(), brute(odd))
    assert hn.mined(table(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def space_of(x):
    return hn.Space(int((x.astype(float) ** 2).sum(1).max()) + 1, x.shape[1])


def test_large_scores_stay_exact():
    x = np.array([[1 << 28, 3], [(1 << 28) - 1, 5], [7, -9]])
    assert hn.Space(1 << 57, 2).dots(x, x).tolist() == [[int(a) * int(c) + int(b) * int(d) for c, d in x.tolist()] for a, b in x.tolist()]


def test_window_of_scores():
    for p in range(-50, 400):
        lo, hi = hn.window(p, 30, 90)
        assert [s for s in range(-60, 400) if 30 * p <= 100 * s <= 90 * p] == list(range(lo, hi + 1))


def test_tree_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(hn, "LEAF_ROWS", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 300, (30, 4))
    x = np.floor(centres[rng.integers(0, 30, 600)] + rng.normal(0, 8, (600, 4))).astype(np.int64)
    x[:200] = x[0]  # no distance tells these apart
    ids, labels = np.arange(600), rng.integers(0, 4, 600)
    shard = hn.Shard(space_of(x), ids, labels, np.array([hash((int(a), *r)) for a, r in zip(labels, x.tolist(), strict=True)]), x, 10)
    assert len(shard.ids) < 460  # ten of each class of equal rows
    opened = []
    for a in range(0, 600, 13):
        q = x[a : a + 1]
        d, square = shard.distances(q)[0], shard.space.squares(q)[0]
        s = (x @ q[0]).tolist()
        for same_label, lo, hi in ((True, -math.inf, math.inf), (False, s[a] // 2, s[a] * 9 // 10), (False, 5, 4)):
            cache = {}
            got = shard.first(q[0].astype(shard.space.kind), square, d, a, labels[a], same_label, lo, hi, 10, cache)
            want = sorted((-s[i], i) for i in range(600) if i != a and (labels[i] == labels[a]) == same_label and lo <= s[i] <= hi)[:10]
            assert [g[:2] for g in got] == want
            opened.append(len(cache) / len(shard.tree.leaves))
    assert sum(opened) / len(opened) < 0.5


def test_top_reach_covers_all_rows():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (800, 5))
    top = hn.Top(space_of(x), np.arange(64), np.zeros(64, int), x[:64], 8)
    leaf, d = top.leaf_rows(x)
    top.bounds = np.zeros((len(top.paths), len(top.points), 2))
    for i, path in enumerate(top.paths):
        for k in path:
            top.bounds[i, k] = d[leaf == i, k].min(), d[leaf == i, k].max()
    top.shards = [range(i, i + 1) for i in range(len(top.paths))]
    q = x[::50]
    most, least = top.reach(q)
    s = q @ x.T
    assert len(top.paths) >= 8
    for i in range(len(top.paths)):
        assert (s[:, leaf == i].max(1) <= most[:, i]).all() and (s[:, leaf == i].min(1) >= least[:, i]).all()
