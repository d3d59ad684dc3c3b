"""Ordered-row operators: gaps, islands, sections, captions, repeated lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliant.functions.text import CJK, line_key, natural_key, prose_length, strip_math, sub, text


def lines(docs: DataFrame, id_: str, column: str = "text") -> DataFrame:
    """id, line_no (from 0), line."""
    return docs.select(id_, F.posexplode(F.split(text(column), r"\r?\n")).alias("line_no", "line"))


def gaps(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """key, present, missing: numbers of min..max that don't occur; the range starts at 1 if the least is 3 or less."""
    have = F.array_sort(F.collect_set(number))
    g = rows.groupBy(*key).agg(have.alias("present"))
    low, high = F.array_min("present"), F.array_max("present")
    return g.withColumn("missing", F.array_except(F.sequence(F.when(low <= 3, F.lit(1).cast("long")).otherwise(low), high), F.col("present")))


def label_gaps(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """key, missing: labels (see ``text.equation_id``) that are left out, by their prefix: 4.2 between 4.1 and 4.3.

    A primed label counts as its number; a prefix whose least number is 3 or less starts at 1.
    """
    base = sub(label, r"[′']$")
    each = rows.select(*key, F.regexp_extract(base, r"^(.*?)(\d+)$", 1).alias("_p"), F.regexp_extract(base, r"^(.*?)(\d+)$", 2).try_cast("long").alias("_n")).where("_n is not null")
    g = gaps(each, [*key, "_p"], "_n").select(*key, F.transform("missing", lambda n: F.concat(F.col("_p"), n.cast("string"))).alias("m"))
    by_key = lambda a, b: F.when(natural_key(a) < natural_key(b), -1).when(natural_key(a) > natural_key(b), 1).otherwise(0)
    return g.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("m")), by_key).alias("missing"))


def set_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, side: what was expected and isn't found (missing), what is found and wasn't expected (extra), and what is both."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("both").alias("side"))


def islands(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """key, lo, hi: runs of consecutive numbers."""
    d = rows.select(*key, F.col(number).alias("n")).distinct().withColumn("_g", F.col("n") - F.row_number().over(Window.partitionBy(*key).orderBy("n")))
    return d.groupBy(*key, "_g").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).drop("_g")


def format_runs(runs: DataFrame, key: list[str]) -> DataFrame:
    """key, runs: ``1–3、5``."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat(r["lo"].cast("string"), F.lit("–"), r["hi"].cast("string"))))
    return runs.groupBy(*key).agg(F.array_join(one, "、").alias("runs"))


def sections(docs: DataFrame, id_: str, column: str = "text", level: str = "##") -> DataFrame:
    """id, line_no, line, section: each line with the latest heading at or above it."""
    ls = lines(docs, id_, column)
    head = F.when(F.col("line").rlike(rf"^{level}\s+\S"), F.trim(sub("line", rf"^{level}\s+", "")))
    w = Window.partitionBy(id_).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return ls.withColumn("section", F.last(head, True).over(w))


def section_key(title: Column | str) -> Column:
    """The number of a heading, else its ASCII letters and CJK in lower case."""
    t = title if isinstance(title, Column) else F.col(title)
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", number).otherwise(sub(F.lower(text(t)), rf"[^a-z{CJK}]"))


def section_lengths(docs: DataFrame, id_: str, column: str = "text") -> DataFrame:
    """id, key, chars: the length of each section's prose (see ``text.prose_length``); what stands before the first heading is ``_front``."""
    body = sections(docs, id_, column).where(~F.col("line").rlike(r"^##\s+\S"))
    key = F.when(F.col("section").isNull(), "_front").otherwise(section_key("section"))
    own = body.groupBy(id_, key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return own.select(id_, "key", prose_length(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).cast("long").alias("chars"))


def empty_sections(docs: DataFrame, id_: str, column: str = "text", least: int = 20) -> DataFrame:
    """id, line_no, title: headings with under ``least`` non-space characters up to the next heading of their level or above."""
    ls = lines(docs, id_, column).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)))
    w = Window.partitionBy(id_).orderBy("line_no")
    size = F.when(F.col("level") > 0, 0).otherwise(F.length(sub("line", r"\s+")))
    ls = ls.withColumn("before", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    # the next heading of each level or above, and the characters before it
    ends = [F.min(F.when((F.col("level") > 0) & (F.col("level") <= k), F.struct("line_no", "before"))).over(after)["before"] for k in range(1, 7)]
    total = F.max("before").over(Window.partitionBy(id_))
    heads = ls.withColumn("_end", F.coalesce(F.when(F.col("level") > 0, F.element_at(F.array(*ends), F.greatest(F.col("level"), F.lit(1)))), total))
    return heads.where((F.col("level") > 0) & (F.col("_end") - F.col("before") < least)).select(id_, "line_no", F.trim(sub("line", r"^#+\s+", "")).alias("title"))


def figure_captions(docs: DataFrame, id_: str, column: str = "text", reach: int = 7, caption: str = r"^\*\*(?:图|Fig\.?|Figure)\s*[A-Z]?\d+[^*]*\*\*") -> DataFrame:
    """id, line_no, image, ordinal, caption: each embed's caption, the first non-blank line within reach that is no embed, if it is one."""
    ls = lines(docs, id_, column).withColumn("image", F.regexp_extract("line", r"!\[\[([^\]|#]+?)(?:\|[^\]]*)?\]\]", 1))
    w = Window.partitionBy(id_).orderBy("line_no")
    nearest = F.first(F.when((F.col("image") == "") & (F.trim("line") != ""), F.trim("line")), True).over(w.rowsBetween(1, reach))
    ordinal = F.sum(F.when(F.col("image") != "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = ls.withColumns({"caption": F.when(nearest.rlike(caption), nearest), "ordinal": ordinal}).where("image <> ''")
    return out.select(id_, "line_no", "image", "ordinal", "caption")


def repeated_lines(docs: DataFrame, group: str, id_: str, column: str = "text", share: float = 0.3, least: int = 3, longest: int = 160) -> DataFrame:
    """group, key, n: lines (as keys) in at least max(least, ceil(share * documents)) of a group's documents."""
    ls = docs.select(group, id_, F.explode(F.array_distinct(F.transform(F.split(text(column), r"\r?\n"), line_key))).alias("key"))
    ls = ls.where(F.length("key").between(4, longest)).withColumn("key", F.substring("key", 1, 120))
    n = ls.groupBy(group, "key").agg(F.countDistinct(id_).alias("n"))
    size = docs.groupBy(group).agg(F.countDistinct(id_).alias("docs")).where("docs >= 3")
    return n.join(size, group).where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("docs") * share))).select(group, "key", "n")


def paragraphs(docs: DataFrame, id_: str, column: str = "text") -> DataFrame:
    """id, start (line), para: prose between blank lines; math blocks, headings, tables, quotes, lists and embeds left out."""
    ls = lines(docs, id_, column)
    w = Window.partitionBy(id_).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.regexp_count("line", F.lit(r"\$\$"))
    inside = F.sum(fence).over(w) % 2 == 1
    skip = inside | (fence > 0) | F.col("line").rlike(r"^\s*(?:#|\||>|[-*+]\s|\d+\.\s|!\[\[|\*\*(?:图|表|Fig|Table))")
    blank = (F.trim("line") == "") | skip
    ls = ls.withColumns({"_b": blank, "_g": F.sum(F.when(blank, 1).otherwise(0)).over(w)})
    out = ls.where("not _b").groupBy(id_, "_g").agg(F.min("line_no").alias("start"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return out.select(id_, "start", F.array_join(F.transform("ls", lambda x: F.trim(x["line"])), " ").alias("para"))


def weighted_mode(rows: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """key, mode, weight: the value of the largest total weight; ties to the lowest value."""
    s = rows.groupBy(*key, value).agg(F.sum(weight).alias("w"))
    return s.groupBy(*key).agg(F.max_by(value, F.struct("w", (-F.col(value)).alias("m"))).alias("mode"), F.max("w").alias("weight"))


#: Fixed set of punctuation marks.
PUNCTUATION = "，。；：！？、（）「」『』《》〈〉…—,.;:!?()[]"


def filler_stats(docs: DataFrame, id_: str, column: str = "text", letters: str = f"[{CJK}]", least: int = 60) -> DataFrame:
    """id, seq, punct, top20 of texts with so many letters: the share of neighbouring characters whose
    code points differ by one, punctuation per 100 characters, the share of the 20 most frequent letters.

    Math and white space don't count.  Code points are counted in Arrow batches.
    """
    s = sub(strip_math(column), r"\s+")
    only = F.length(sub(s, rf"[^{letters[1:-1]}]"))
    rows = docs.select(id_, s.alias("s"), sub(s, rf"[^{letters[1:-1]}]").alias("c")).where(only >= least)
    marks = np.array(sorted(map(ord, PUNCTUATION)), np.uint32)

    @pandas_udf("struct<seq:double,punct:double,top20:double>")
    def stats(s: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(s, c, strict=True):
            p, q = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
            near = np.abs(np.diff(p.astype(np.int64))) == 1
            top = np.sort(np.unique(q, return_counts=True)[1])[::-1][:20].sum()
            out.append((near.sum() / max(1, len(p) - 1), np.isin(p, marks).sum() / len(p) * 100, top / len(q)))
        return pd.DataFrame(out, columns=["seq", "punct", "top20"])

    return rows.select(id_, stats("s", "c").alias("x")).select(id_, "x.seq", "x.punct", "x.top20")


def nearest(events: DataFrame, others: DataFrame, key: str, at: str, id_: str, other_id: str, within: float) -> DataFrame:
    """Each event with the nearest other of its key by time, if within so many seconds: one merge of both sides, no pairs.

    Ties go to the earlier one, then to the lower id.
    """
    a = events.select(key, F.col(at).alias("t"), F.col(id_).alias("id"), F.lit(None).cast("long").alias("o"))
    b = others.select(key, F.col(at).alias("t"), F.lit(None).cast("long").alias("id"), F.col(other_id).alias("o"))
    both = a.unionByName(b)
    mark = F.when(F.col("o").isNotNull(), F.struct("t", "o"))
    # others stand before events of their time; of equal times the lowest id stands last before, first after
    w = Window.partitionBy(key).orderBy("t", F.col("o").isNull(), F.desc("o"))
    v = Window.partitionBy(key).orderBy(F.desc("t"), F.col("o").isNull(), F.desc("o"))
    both = both.withColumns({"b": F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.last(mark, True).over(v.rowsBetween(Window.unboundedPreceding, 0))})
    gap = lambda x: F.abs(F.unix_micros(F.col(x + ".t").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 1e6
    ev = both.where("id is not null").withColumns({"gb": gap("b"), "gn": gap("n")})
    use_b = F.col("gb").isNotNull() & (F.col("gn").isNull() | (F.col("gb") <= F.col("gn")))
    out = ev.select(key, F.col("id"), F.when(use_b, F.col("b.o")).otherwise(F.col("n.o")).alias("nearest"), F.when(use_b, F.col("gb")).otherwise(F.col("gn")).alias("gap"))
    return out.where(F.col("gap") <= within)
