"""Streams give what the batch forms give."""

from __future__ import annotations

import datetime as dt
import random

from foliant.operators import activity
from foliant.streaming import state


def test_throttle_changes_and_counts(spark, tmp_path):
    rng, start, rows = random.Random(3), dt.datetime(2024, 1, 1), []
    for i in range(120):
        rows.append((rng.choice("abc"), start + dt.timedelta(seconds=240 * i), rng.choice("xyz")))
    schema = "k string, ts timestamp, v string"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(make, name, mode="append"):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    batch = spark.createDataFrame(rows, schema)
    assert run(lambda s: state.throttled(s, "k", "ts"), "throttled") == sorted((r.k, r.ts) for r in activity.throttle(batch, "k", "ts").collect())
    assert run(lambda s: state.changed_values(s, "k", "ts", "v"), "changed") == sorted((r.k, r.ts, r.v) for r in activity.changes(batch, "k", ["ts"], "v").collect())
    assert run(lambda s: state.daily_counts(s, "ts"), "daily", "complete") == [(dt.date(2024, 1, 1), 120)]


def test_debounced_upserts(spark, tmp_path):
    schema = "k string, at long, v string"
    for i, rows in enumerate([[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 3, "w")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = state.debounced(s, ["k"], "at", state.upsert_table(f"{tmp_path}/out", ["k"], "at"), f"{tmp_path}/c", once=True)
    q.awaitTermination()
    assert {(r.k, r.v) for r in state.upserted(spark, f"{tmp_path}/out", ["k"], "at").collect()} == {("a", "w"), ("b", "z")}
