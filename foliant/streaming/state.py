"""Structured Streaming forms of the event-driven operators.

The library has no event-time windows; a watermark here is an extension that
only bounds state.  Each operator has a batch form with the same result, named
in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.sync import latest


def throttled(events: DataFrame, key: str, ts: str, seconds: int = 600) -> DataFrame:
    """key, ts of events at least so long after the last emitted one (batch: ``activity.throttle``).

    State: the last emitted time of each key.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for f in frames for t in f["_us"]):
            if last is None or t - last >= seconds * 1_000_000:
                out.append(t)
                last = t
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({key: [k[0]] * len(out), "us": out})

    kind = events.schema[key].dataType.simpleString()
    us = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    done = us.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, us long", "last long", "append", GroupStateTimeout.NoTimeout)
    return done.select(key, F.timestamp_micros("us").alias("ts"))


def changed_values(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key, ts, value where the value differs from the key's last one; the first counts, null is a value (batch: ``activity.changes``)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.exists, state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("_us", kind="stable")
        values = rows[value].astype(object).where(rows[value].notna(), None)
        out = []
        for t, v in zip(rows["_us"], values, strict=True):
            if not seen or v != last:
                out.append((k[0], t, v))
            seen, last = True, v
        if seen:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "us", value])

    types = [events.schema[c].dataType.simpleString() for c in (key, value)]
    us = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), value)
    done = us.groupBy(key).applyInPandasWithState(step, f"{key} {types[0]}, us long, {value} {types[1]}", f"last {types[1]}", "append", GroupStateTimeout.NoTimeout)
    return done.select(key, F.timestamp_micros("us").alias("ts"), value)


def daily_counts(events: DataFrame, ts: str, watermark: str | None = None) -> DataFrame:
    """day, n: a running counter of each day; the watermark, if given, drops the state of old days."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, "1 day").start.cast("date").alias("day")).agg(F.count("*").alias("n"))


def debounced(stream: DataFrame, keys: list[str], order: str, save: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 2.0, once: bool = False):
    """Starts a query that saves the last row of each key per trigger: a trailing debounce of the trigger's length."""

    def batch(df: DataFrame, batch_id: int) -> None:
        save(latest(df, keys, order), batch_id)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()


def flush(query) -> None:
    """Everything that has arrived is saved."""
    query.processAllAvailable()


def upsert_table(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A save for ``debounced``: an append log whose view is its latest rows; a batch that runs again replaces its own part."""

    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return save


def upserted(spark, path: str, keys: list[str], order: str) -> DataFrame:
    return latest(spark.read.parquet(path), keys, order, "batch").drop("batch")
