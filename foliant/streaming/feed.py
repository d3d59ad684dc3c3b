"""Replicas and subscribers: two-way merges without echoes, and feeds that replay a
snapshot and then every change once.

A replica's rows carry ``at`` (when they were written) and ``origin`` (which replica
wrote them).  Of two rows of a key the later one holds, of two of one time that of the
greater origin; so merging is commutative, associative and idempotent, and replicas
that have seen the same rows hold the same, in whatever order they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The batch number under which a feed holds its snapshot.
SNAPSHOT = -1


def merged(local: DataFrame, remote: DataFrame, keys: list[str], at: str = "at", origin: str = "origin") -> DataFrame:
    """The row of each key that holds: a partial aggregate, so a key of many rows is no
    hot task.  A row without a time is older than all others.  Rows that differ though
    time and origin are the same are decided by their values."""
    rest = [c for c in local.columns if c not in (*keys, at, origin)]
    row = F.struct(at, origin, *rest)
    rows = local.select(*keys, row.alias("_r")).unionByName(remote.select(*keys, row.alias("_r")))
    held = rows.groupBy(*keys).agg(F.max("_r").alias("_r"))
    return held.select(*[k if k in keys else F.col(f"_r.{k}").alias(k) for k in local.columns])


def outgoing(local: DataFrame, seen: DataFrame, keys: list[str], me: str, at: str = "at", origin: str = "origin") -> DataFrame:
    """Rows of the replica ``me`` that the other side lacks: those that it wrote itself
    and that hold against what was seen there.  What came from elsewhere never goes
    back, so a pull is followed by no push (the echo of its own writes)."""
    row = F.struct(at, origin, *[c for c in local.columns if c not in (*keys, at, origin)])
    there = seen.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(row).alias("_there"))
    local = local.withColumn("_row", row)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    mine = local.where(F.col(origin) == me).join(there, same, "left")
    return mine.where(F.col("_there").isNull() | (F.col("_row") > F.col("_there"))).drop("_row", "_there", *[f"_{k}" for k in keys])


def replay(snapshot: DataFrame, changes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a feed: the snapshot as batch -1, then each batch of the stream ``changes``
    under its own number.

    The snapshot is written when the feed starts for the first time, before any change.
    A batch that runs again after a failure has the same rows (the checkpoint holds
    its extent) and replaces its own folder, so a restart leaves no gap and no repeat;
    a snapshot that was broken off is written again.
    """
    spark = snapshot.sparkSession
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = file(f"{path}/batch={SNAPSHOT}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        snapshot.write.mode("overwrite").parquet(f"{path}/batch={SNAPSHOT}")

    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def delivered(spark, path: str, after: int | None = None) -> DataFrame:  # noqa: ANN001
    """What a subscriber gets: rows with batch, all or those after the batch it has seen."""
    rows = spark.read.parquet(path)
    return rows if after is None else rows.where(F.col("batch") > after)


def current(spark, path: str, keys: list[str], at: str = "at", origin: str = "origin") -> DataFrame:  # noqa: ANN001
    """The table that the feed so far amounts to."""
    rows = delivered(spark, path).drop("batch")
    return merged(rows, rows.limit(0), keys, at, origin)
