"""A store of tables that change together: versions that are committed in one step.

    <root>/data/<table>-<random>/   Parquet, written once and never changed
    <root>/versions/<number>.json   which folder each table of a version is

A writer writes its tables beside the others, then creates the next version's file,
which fails if that file is there.  So a version is whole or absent: a job that fails
leaves only folders that no version names, and of two writers one gets the number and
the other is told, or tries again on top if they changed different tables.  A reader
takes the last version once and reads its folders, whatever is committed meanwhile.

A table whose fingerprint is what it was keeps its folder, and a commit that changes
no table makes no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a version's file name, so that names sort as numbers.
DIGITS = 12


class Conflict(RuntimeError):
    """Another writer committed a table that this one also writes."""


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, sum, mix: one row that depends on the rows and how often each stands, not on
    their order or partitions.  Two 64-bit hashes of each row, nulls and places of the
    columns included, are added up and mixed in partial aggregates."""
    cols = sorted(df.columns)
    fields = [F.col(f"`{c}`") for c in cols]
    kinds = [f.cast("string") if "map" in df.schema[c].dataType.simpleString() else f for c, f in zip(cols, fields, strict=True)]
    flags = F.concat_ws("", F.lit(",".join(cols)), *[F.when(f.isNull(), "0").otherwise("1") for f in fields])
    first, second = F.xxhash64(flags, *kinds), F.xxhash64(F.lit(1), flags, *kinds)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(first.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.sum(second.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("mix"))


@dataclass(frozen=True)
class Version:
    """What a reader is pinned to: number (0: nothing yet) and table -> {path, rows, sum, mix}."""

    number: int
    tables: Mapping[str, dict]


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, number: int):  # noqa: ANN202
        return self._path(f"{self.root}/versions/{number:0{DIGITS}d}.json")

    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        top = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, or the last whole one.  A file that a broken writer left half
        written is no version: the one before it holds."""
        for n in [number] if number is not None else reversed(self.numbers()):
            stream = self._fs.open(self._file(n))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return Version(n, json.loads(text)["tables"])
            except (ValueError, KeyError):
                if number is not None:
                    raise
        return Version(0, {})

    def read(self, table: str, at: Version | None = None) -> DataFrame:
        return self.spark.read.parquet((at or self.version()).tables[table]["path"])

    def _write(self, table: str, df: DataFrame, old: dict | None) -> dict:
        """The table's entry: its old one if the rows are the same."""
        path = f"{self.root}/data/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        # what was written is counted, not what would be worked out again
        entry = {"path": path, **fingerprint(self.spark.read.schema(df.schema).parquet(path)).first().asDict()}
        if old and all(old[k] == entry[k] for k in ("rows", "sum", "mix")):
            self._fs.delete(self._path(path), True)
            return old
        return entry

    def commit(self, tables: Mapping[str, DataFrame], on: Version | None = None, tries: int = 5) -> Version:
        """Replaces the tables in one step and returns the version that holds.

        ``on`` is the version the new tables were worked out from, by default the last
        one.  If another writer has committed since, this commit goes on top of theirs,
        unless both changed one of these tables: then ``Conflict`` is raised.
        """
        base = on or self.version()
        new = {k: self._write(k, df, base.tables.get(k)) for k, df in tables.items()}
        changed = {k for k, v in new.items() if v != base.tables.get(k)}
        for _ in range(tries):
            last = self.version()
            both = {k for k in changed if last.tables.get(k) != base.tables.get(k)}
            if both:
                raise Conflict(f"{', '.join(sorted(both))}: changed since version {base.number}")
            if not changed:
                return last
            after = Version(max([last.number, *self.numbers()]) + 1, {**last.tables, **{k: new[k] for k in changed}})
            if self._create(after):
                return after
        raise Conflict(f"no version number was free in {tries} tries")

    def _create(self, v: Version) -> bool:
        """Creates the version's file unless there is one."""
        try:
            out = self._fs.create(self._file(v.number), False)
        except Exception:
            if self._fs.exists(self._file(v.number)):
                return False
            raise
        try:
            out.write(bytearray(json.dumps({"tables": dict(v.tables)}).encode()))
        finally:
            out.close()
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Drops all but the last versions, and folders that none of these names; only when
        no writer is at work and no reader is pinned to an older version."""
        numbers = self.numbers()
        kept = {t["path"].rsplit("/", 1)[-1] for n in numbers[-keep:] for t in self.version(n).tables.values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._file(n), False)
        top, dropped = self._path(f"{self.root}/data"), 0
        for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
            if s.getPath().getName() not in kept:
                dropped += bool(self._fs.delete(s.getPath(), True))
        return dropped


def changes(store: Store, table: str, keys: list[str], since: Version, upto: Version) -> DataFrame:
    """keys, change ('added', 'removed', 'changed') and the row after it: what a reader of
    ``since`` must apply to hold ``upto``.  Null keys are keys."""
    new = store.read(table, upto)
    if table not in since.tables:
        return new.withColumn("change", F.lit("added"))
    old = store.read(table, since)
    if since.tables[table] == upto.tables[table]:
        return new.limit(0).withColumn("change", F.lit("added"))
    rest = [c for c in new.columns if c not in keys]
    o = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(F.lit(1), *rest).alias("_old"))
    n = new.select(*keys, F.struct(F.lit(1), *rest).alias("_new"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = n.join(o, same, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    key = [F.when(F.col("_new").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*key, *[F.col(f"_new.{c}").alias(c) for c in rest], change.alias("change"))
