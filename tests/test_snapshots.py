"""Versions of tables: failed and concurrent writes, pinned readers, change feeds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.sources import snapshots


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.Store(spark, f"file://{tmp_path}/store")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, v long")


def held(store, table, at=None):
    return sorted(tuple(r) for r in store.read(table, at).collect())


def test_commit_read_and_no_change(spark, store):
    assert store.version() == snapshots.Version(0, {})
    one = store.commit({"papers": rows(spark, ("a", 1)), "terms": rows(spark, ("t", 1))})
    assert one.number == 1 and held(store, "papers") == [("a", 1)]
    # the same rows in another order and number of partitions are no change
    again = store.commit({"papers": rows(spark, ("a", 1)).repartition(3)})
    assert again == one and store.numbers() == [1]
    two = store.commit({"papers": rows(spark, ("a", 2), ("b", 1))})
    assert two.number == 2 and two.tables["terms"] == one.tables["terms"]
    assert held(store, "papers", one) == [("a", 1)] and held(store, "papers") == [("a", 2), ("b", 1)]


def test_a_failed_write_leaves_the_last_version(spark, store):
    one = store.commit({"papers": rows(spark, ("a", 1)), "terms": rows(spark, ("t", 1))})
    bad = rows(spark, ("a", 2)).withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("no")).cast("long")))
    with pytest.raises(Exception, match="no"):
        store.commit({"terms": rows(spark, ("t", 9)), "papers": bad})
    # neither table of the failed commit is seen
    assert store.version() == one and held(store, "terms") == [("t", 1)]
    assert store.vacuum(1) >= 1 and held(store, "papers") == [("a", 1)]


def test_a_half_written_version_is_none(spark, store, tmp_path):
    one = store.commit({"papers": rows(spark, ("a", 1))})
    (tmp_path / "store/versions" / f"{2:012d}.json").write_text('{"tables": {"pap')
    assert store.version() == one
    three = store.commit({"papers": rows(spark, ("a", 3))})
    assert three.number == 3 and held(store, "papers") == [("a", 3)]


def test_writers_that_meet(spark, store):
    base = store.commit({"papers": rows(spark, ("a", 1)), "terms": rows(spark, ("t", 1))})
    theirs = store.commit({"terms": rows(spark, ("t", 2))}, on=base)
    # another table: on top of theirs
    ours = store.commit({"papers": rows(spark, ("a", 2))}, on=base)
    assert ours.number == theirs.number + 1 and held(store, "terms") == [("t", 2)] and held(store, "papers") == [("a", 2)]
    # the same table: told, and nothing is lost
    with pytest.raises(snapshots.Conflict, match="papers"):
        store.commit({"papers": rows(spark, ("a", 9))}, on=base)
    assert held(store, "papers") == [("a", 2)]


def test_the_number_goes_to_one_of_two(spark, store, monkeypatch):
    base = store.commit({"papers": rows(spark, ("a", 1))})
    create, raced = store._create, []

    def other_first(v):
        if not raced:
            raced.append(1)
            other = snapshots.Store(spark, store.root)
            other.commit({"terms": rows(spark, ("t", 5))})
        return create(v)

    monkeypatch.setattr(store, "_create", other_first)
    mine = store.commit({"papers": rows(spark, ("a", 2))}, on=base)
    assert mine.number == 3 and held(store, "terms") == [("t", 5)] and held(store, "papers") == [("a", 2)]


def test_vacuum_keeps_what_versions_name(spark, store):
    for n in range(4):
        store.commit({"papers": rows(spark, ("a", n))})
    assert store.vacuum(2) == 2 and store.numbers() == [3, 4] and held(store, "papers", store.version(3)) == [("a", 2)]


def test_fingerprints(spark):
    one = lambda df: tuple(snapshots.fingerprint(df).first())
    a = spark.createDataFrame([("x", None), (None, "x"), ("y", "y")], "p string, q string")
    assert one(a) == one(a.orderBy("q").repartition(3)) == one(a.select("q", "p"))
    # nulls, places, copies and names count
    assert len({one(a), one(a.union(a)), one(a.limit(0)), one(a.where("p is not null").union(a.where("p = 'x'"))), one(a.toDF("q", "p").select("p", "q")), one(a.toDF("p", "r")), one(a.fillna(""))}) >= 6
    m = spark.range(2).select(F.create_map(F.lit("k"), "id").alias("m"), F.array("id").alias("l"))
    assert one(m)[0] == 2


def test_changes_between_versions(spark, store):
    one = store.commit({"p": rows(spark, ("a", 1), ("b", 1), ("n", None), (None, 7))})
    two = store.commit({"p": rows(spark, ("a", 1), ("b", 2), ("c", 1), ("n", None))})
    feed = lambda a, b: sorted(((r.k, r.v, r.change) for r in snapshots.changes(store, "p", ["k"], a, b).collect()), key=repr)
    assert feed(one, two) == sorted([("b", 2, "changed"), ("c", 1, "added"), (None, None, "removed")], key=repr)
    assert feed(two, two) == [] and len(feed(snapshots.Version(0, {}), one)) == 4
