"""File sources and incremental copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def copy_plan(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    """key, action: copy what is missing, of another size, or over two seconds older at the target."""
    d = dst.select(key, F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.lit(True).alias("_there"))
    both = src.join(d, key, "left")
    stale = F.col("_there").isNull() | (F.col("size") != F.col("_s")) | (F.col("_m") < F.col("mtime") - F.make_dt_interval(secs=F.lit(2)))
    return both.select(key, F.when(stale, "copy").otherwise("skip").alias("action"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, size, mtime of the files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return f.select("path", name_of(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def whole_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime of all files below a folder, those included whose names begin
    with ``_`` or a point, which Spark's sources pass over; a missing folder has none.
    The file system's own listing: the driver sees names and times, nobody contents."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows, found = [], fs.listFiles(top, True) if fs.exists(top) else None
    while found is not None and found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, "path string, size long, ms long").select("path", "size", F.timestamp_millis("ms").alias("mtime"))


def name_of(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, name, stem, text of whole files; names that start with _ are left out."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    t = t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("name", name_of(F.col("path")))
    return t.where(~F.col("name").startswith("_")).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def json_rows(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of a JSON file, or of an array in it; a missing or broken file gives none."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True)
        raw.schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([], schema)
    rows = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    return raw.select(F.inline(F.from_json(rows, f"array<struct<{schema}>>")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; malformed lines are skipped."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def json_log(spark: SparkSession, path: str, schema: str = "date string, type string") -> DataFrame:
    """Rows of a log of JSON lines with bad: the line itself where it is broken, else null;
    empty lines are no rows, a missing log has none."""
    from pyspark.errors import AnalysisException

    # the lines are read as text, so that a query of bad alone sees the broken ones too
    try:
        lines = spark.read.text(path).where(F.trim("value") != "")
        lines.schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([], schema + ", bad string")
    row = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.select(row.alias("r"), "value").select("r.*", "value")
    return out.withColumn("bad", F.when(F.col("_bad").isNotNull(), F.col("value"))).drop("_bad", "value")
