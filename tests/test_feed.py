"""Replicas converge without echoes; feeds replay once, whatever breaks off."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.streaming import feed

ROW = "k string, v string, at long, origin string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_is_commutative_and_idempotent(spark):
    a = rows(spark, ("x", "1", 1, "a"), ("y", "1", 5, "a"), ("z", "1", 3, "a"), ("n", "1", None, "a"), (None, "1", 1, "a"))
    b = rows(spark, ("x", "2", 2, "b"), ("y", "2", 4, "b"), ("z", "2", 3, "b"), ("n", "2", 0, "b"))
    m = feed.merged(a, b, ["k"])
    assert held(m) == held(feed.merged(b, a, ["k"])) == held(feed.merged(m, b, ["k"])) == sorted([("x", "2", 2, "b"), ("y", "1", 5, "a"), ("z", "2", 3, "b"), ("n", "2", 0, "b"), (None, "1", 1, "a")], key=repr)


def test_any_interleaving_converges_without_bounces(spark):
    for seed in range(2):
        rng, stores, pushed, at = random.Random(seed), {"a": rows(spark), "b": rows(spark)}, [], 0
        log = []
        for _ in range(5):
            me = rng.choice("ab")
            other = "b" if me == "a" else "a"
            if rng.random() < 0.6:
                at += rng.randrange(2)
                log.append((rng.choice("xy"), f"{me}{len(log)}", at, me))
                stores[me] = feed.merged(stores[me], rows(spark, log[-1]), ["k"])
            else:
                out = feed.outgoing(stores[me], stores[other], ["k"], me)
                pushed += [r.origin == me for r in out.collect()]
                stores[other] = feed.merged(stores[other], out, ["k"])
            stores = {k: spark.createDataFrame(held(v), ROW) for k, v in stores.items()}
        for me, other in ("ab", "ba"):
            stores[other] = feed.merged(stores[other], feed.outgoing(stores[me], stores[other], ["k"], me), ["k"])
        assert held(stores["a"]) == held(stores["b"]) == held(feed.merged(rows(spark, *log), rows(spark), ["k"]))
        assert all(pushed)
        for me, other in ("ab", "ba"):  # nothing bounces
            assert feed.outgoing(stores[me], stores[other], ["k"], me).isEmpty()


def test_replay_over_a_restart_in_the_middle_of_a_batch(spark, tmp_path, monkeypatch):
    path, checkpoint = f"{tmp_path}/feed", f"{tmp_path}/check"
    for i in range(4):
        rows(spark, ("x", f"v{i}", i + 1, "a"), (f"k{i}", "v", 1, "a")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    snapshot = rows(spark, ("x", "old", 0, "a"), ("s", "old", 0, "a"))
    broken = []

    def changes(fail):
        s = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        # the third batch breaks off while it is written
        return s.withColumn("v", F.when(F.lit(fail) & (F.col("k") == "x") & (F.col("at") == 3), F.raise_error(F.lit("broken off")).cast("string")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="broken off"):
        feed.replay(snapshot, changes(True), path, checkpoint, once=True).awaitTermination()
    got = feed.delivered(spark, path)
    broken = {r.batch for r in got.collect()}
    assert feed.SNAPSHOT in broken and len(broken) < 5
    # again, with another snapshot that must not be taken
    feed.replay(snapshot.limit(0), changes(False), path, checkpoint, once=True).awaitTermination()
    got = sorted((r.batch, r.k, r.v) for r in feed.delivered(spark, path).collect())
    assert [x for x in got if x[0] == -1] == [(-1, "s", "old"), (-1, "x", "old")]
    changes_ = [(k, v) for b, k, v in got if b >= 0]
    assert sorted(changes_) == sorted([("x", f"v{i}") for i in range(4)] + [(f"k{i}", "v") for i in range(4)])
    assert {r.k: r.v for r in feed.current(spark, path, ["k"]).collect()} == {"x": "v3", "s": "old", **{f"k{i}": "v" for i in range(4)}}
    seen = max(b for b, *_ in got) - 1
    assert {r.batch for r in feed.delivered(spark, path, seen).collect()} == {seen + 1}
    # nothing new: nothing is delivered again
    feed.replay(snapshot, changes(False), path, checkpoint, once=True).awaitTermination()
    assert feed.delivered(spark, path).count() == len(got)
