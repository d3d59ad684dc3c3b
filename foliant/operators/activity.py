"""Activity and calendar: buckets, zero fill, throttling, change detection.

``now`` and the time zone are parameters, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMATS = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def local_date(ts: Column, zone: str) -> Column:
    """ISO date of a UTC timestamp in a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def monday(d: Column) -> Column:
    return F.trunc(d, "week")


def bucket_key(day: Column, unit: str) -> Column:
    """Key of a day's bucket; weeks by their Monday; invalid days give ''."""
    return F.coalesce(F.date_format(F.date_trunc(unit, day.try_cast("date")), FORMATS[unit]), F.lit(""))


def last_keys(now: Column, unit: str, n: int) -> Column:
    """The last n keys of a unit, ascending, with the current one."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "year": "interval 1 year"}[unit]
    end = F.date_trunc(unit, now).cast("date")
    back = {"day": F.date_sub(end, n - 1), "week": F.date_sub(end, 7 * (n - 1)), "month": F.add_months(end, -(n - 1)), "year": F.add_months(end, -12 * (n - 1))}[unit]
    return F.transform(F.sequence(back, end, F.expr(step)), lambda d: F.date_format(d, FORMATS[unit]))


def per_day(events: DataFrame, day: Column, mine: Column) -> DataFrame:
    """day, mine, ai."""
    return events.groupBy(day.alias("day")).agg(F.count_if(mine).alias("mine"), F.count_if(~mine).alias("ai"))


#: Parts of the paths of files that a reader writes, not the ingestion.
MINE = (".我的笔记.", "_web批注", "_生词", "_活动日志")


def collected(found: DataFrame, log: DataFrame, markers: tuple[str, ...] = MINE) -> DataFrame:
    """day, mine, ai: files by the day they were written, and a log's entries as the reader's own.

    found: path, mtime (``files.whole_listing``: no content is read); files of settings folders
    are left out.  log: date (``files.json_log``); entries without one don't count.
    """
    mine = F.lit(False)
    for m in markers:
        mine = mine | F.col("path").contains(m)
    f = found.where(~F.array_contains(F.split("path", "/"), ".obsidian")).select(F.date_format("mtime", "yyyy-MM-dd").alias("d"), mine.alias("m"))
    own = log.select(F.substring(F.col("date"), 1, 10).alias("d"), F.lit(True).alias("m")).where("d <> ''")
    return per_day(f.unionByName(own), F.col("d"), F.col("m"))


def merged(server: DataFrame, local: DataFrame) -> DataFrame:
    """Server days and local counts, which are added to mine."""
    both = server.select("day", "mine", "ai").unionByName(local.select("day", F.col("n").alias("mine"), F.lit(0).alias("ai")))
    return both.groupBy("day").agg(F.sum("mine").alias("mine"), F.sum("ai").alias("ai"))


def rebucket(days: DataFrame, unit: str, now: Column, window_days: int = 365) -> DataFrame:
    """key, mine, ai; days whose midnight lies before now - window_days, time of day included, are dropped."""
    midnight = F.col("day").try_cast("date").cast("timestamp")
    kept = days.where(midnight >= now - F.make_dt_interval(F.lit(window_days)))
    return kept.groupBy(bucket_key(F.col("day"), unit).alias("key")).agg(F.sum("mine").alias("mine"), F.sum("ai").alias("ai")).where("key <> ''")


def series(days: DataFrame, unit: str, now: Column, n: int, window_days: int = 365) -> DataFrame:
    """The last n buckets, zero-filled.  The window holds for all units, so old years read 0."""
    axis = days.sparkSession.range(1).select(F.explode(last_keys(now, unit, n)).alias("key"))
    got = rebucket(days, unit, now, window_days)
    return axis.join(got, "key", "left").select("key", F.coalesce("mine", F.lit(0)).alias("mine"), F.coalesce("ai", F.lit(0)).alias("ai"))


def chart_series(days: DataFrame, now: Column) -> DataFrame:
    """unit, key, mine, ai: 8 weeks, 9 months and 4 years."""
    parts = [series(days, u, now, n).select(F.lit(u).alias("unit"), "key", "mine", "ai") for u, n in (("week", 8), ("month", 9), ("year", 4))]
    return parts[0].union(parts[1]).union(parts[2])


def week_label(d: Column) -> Column:
    return F.date_format(d.cast("date"), "M/d")


def month_label(ym: Column) -> Column:
    return F.concat(F.substring(ym, 6, 2).cast("int").cast("string"), F.lit("月"))


def iso_now(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def throttle(events: DataFrame, key: str, ts: str, seconds: int = 600, tie: str | None = None) -> DataFrame:
    """Per key, the events at least so long after the last one that was kept.

    An event that follows a pause of that length is always kept, so a key's events
    fall into sessions that don't depend on each other.  Sessions are dealt over
    tasks and folded as sorted batches stream by: a task keeps one time, no group.
    """
    order = [ts, *([tie] if tie else [])]
    w = Window.partitionBy(key).orderBy(*order)
    start = F.lag(ts).over(w).isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) >= seconds * 1_000_000)
    session = F.max(F.when(start, F.col(ts))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("_session", session).repartition(F.col(key), F.col("_session")).sortWithinPartitions(key, "_session", *order)

    columns = events.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = last = None
        for rows in batches:
            keep = []
            for k, s, t in zip(rows[key], rows["_session"], rows[ts], strict=True):
                ok = (k, s) != now or (t - last).total_seconds() >= seconds
                now, last = (k, s), t if ok else last
                keep.append(ok)
            yield rows.loc[keep, columns]

    return rows.mapInPandas(fold, events.schema)


def changes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The first event of each key, and those whose value differs from the one before; null is a value."""
    w = Window.partitionBy(key).orderBy(*order)
    e = events.withColumns({"_b": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return e.where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b", "_n")
