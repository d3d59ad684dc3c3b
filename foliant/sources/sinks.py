"""Writers: catalogue files, incremental mirrors, upserts, checked overwrites."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_lines(rows: DataFrame, part: int, key: str, value: Column) -> DataFrame:
    """part, key, value: elements of a JSON array, one a line in the order of a unique key,
    all but the first after a comma."""
    first = rows.agg(F.min(key).alias("_first"))
    r = rows.select(F.col(key).alias("_key"), value.alias("_value")).join(F.broadcast(first), F.lit(True))
    comma = F.when(F.col("_key") == F.col("_first"), "").otherwise(",")
    return r.select(F.lit(part).alias("part"), F.col("_key").cast("string").alias("key"), F.concat(comma, "_value").alias("value"), F.col("_key").alias("ord"))


def _fixed(one: DataFrame, part: int, value: Column, ord_type: str) -> DataFrame:
    return one.select(F.lit(part).alias("part"), F.lit("").alias("key"), value.alias("value"), F.lit(None).cast(ord_type).alias("ord"))


def catalog_lines(papers: DataFrame, topics: DataFrame, generated_at: str, paper_key: str, topic_key: str) -> DataFrame:
    """part, key, value, ord: the lines of one document {generatedAt, count, papers, topicDocs}
    in the order of (part, ord).  Only the count of papers passes through one task."""
    p = array_lines(papers, 1, paper_key, F.to_json(F.struct(*papers.columns)))
    t = array_lines(topics, 3, topic_key, F.to_json(F.struct(*topics.columns)))
    if dict(p.dtypes)["ord"] != dict(t.dtypes)["ord"]:
        p, t = (x.withColumn("ord", F.col("ord").cast("string")) for x in (p, t))
    kind = dict(p.dtypes)["ord"]
    n = papers.agg(F.count("*").alias("n"))
    open_ = _fixed(n, 0, F.concat(F.lit('{"generatedAt":' + json.dumps(generated_at) + ',"count":'), F.col("n").cast("string"), F.lit(',"papers":[')), kind)
    one = papers.sparkSession.range(1)
    return open_.union(p).union(_fixed(one, 2, F.lit('],"topicDocs":['), kind)).union(t).union(_fixed(one, 4, F.lit("]}"), kind))


def link_map_lines(papers: DataFrame, aliases: DataFrame) -> DataFrame:
    """part, key, value, ord: the lines of {papers: pid -> slug, terms: alias -> key}; of rows of one pid the least slug."""
    pair = lambda k, v: F.concat(F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", ""), F.lit(":"), F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""))
    p = papers.groupBy("pid").agg(F.min("slug").alias("slug"))
    a = aliases.groupBy("alias").agg(F.min("key").alias("key"))
    one = papers.sparkSession.range(1)
    return (
        _fixed(one, 0, F.lit('{"papers":{'), "string")
        .union(array_lines(p, 1, "pid", pair("pid", "slug")))
        .union(_fixed(one, 2, F.lit('},"terms":{'), "string"))
        .union(array_lines(a, 3, "alias", pair("alias", "key")))
        .union(_fixed(one, 4, F.lit("}}"), "string"))
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes the lines as text files whose contents, one after another by name, are the
    document: sorted by range over all tasks, gathered in none."""
    lines.repartitionByRange(F.col("part").asc(), F.col("ord").asc_nulls_first()).sortWithinPartitions(F.col("part").asc(), F.col("ord").asc_nulls_first()).select("value").write.mode("overwrite").text(path)


def changed(new: DataFrame, old: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content is new or differs from what was written."""
    had = old.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_h"))
    both = new.join(had, key, "left")
    return both.where(~F.sha2(F.col(content).cast("binary"), 256).eqNullSafe(F.col("_h"))).drop("_h")


def repeated_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """digest, kept, copies: contents that stand more than once, by their hash, with the least key."""
    return rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.min(key).alias("kept"), F.count("*").alias("copies")).where("copies > 1")


def orphans(existing: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """What this run did not produce."""
    return existing.join(produced.select(key).distinct(), key, "left_anti")


def stale_images(mirror: DataFrame, source: DataFrame, name: str = "name") -> DataFrame:
    """Mirrored images whose source is gone; variants count as their original."""
    m = mirror.withColumn("_n", F.regexp_replace(name, r"(?i)\.webp$", ""))
    s = source.select(F.regexp_replace(name, r"(?i)\.webp$", "").alias("_n")).distinct()
    return m.join(s, "_n", "left_anti").drop("_n")


def non_empty_documents(docs: DataFrame) -> DataFrame:
    """User documents worth exporting."""
    return docs.where((F.coalesce("note", F.lit("")) != "") | (F.size("highlights") > 0) | (F.size("vocab") > 0))


def vocab_lines(docs: DataFrame, none: str = "（无上下文）") -> DataFrame:
    """slug, value: a Markdown list of a document's words with their contexts."""
    one = lambda v: F.concat(F.lit("- **"), v["word"], F.lit("** "), F.when(F.trim(F.coalesce(v["context"], F.lit(""))) != "", v["context"]).otherwise(none))
    return docs.select("slug", F.array_join(F.transform("vocab", one), "\n").alias("value"))


def publish_status(errors: int, synced: bool | None) -> str:
    """failed with errors or a failed sync, assembled without a sync, else ready."""
    return "failed" if errors or synced is False else "assembled" if synced is None else "ready"


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the old table, then renames; a job that fails leaves the old one.

    Between the two renames there is no table, and where a rename is a copy neither is
    one step: readers that must not see that take ``snapshots.Store``.
    """
    spark, top = df.sparkSession, path.rstrip("/")
    new, old = f"{top}.new-{uuid.uuid4().hex}", f"{top}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path
    fs = file(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(file(top))
    if had and not fs.rename(file(top), file(old)):
        raise OSError(f"{top} can't be moved")
    if not fs.rename(file(new), file(top)):
        if had:
            fs.rename(file(old), file(top))
        raise OSError(f"{new} can't be moved to {top}")
    if had:
        fs.delete(file(old), True)


def overwrite_checked(df: DataFrame, path: str, ok: DataFrame) -> bool:
    """Replaces the table only if ``ok`` (findings) is empty; a failure leaves the old output."""
    if not ok.isEmpty():
        return False
    replace_table(df, path)
    return True
