"""All checks of a work as one report.

A work is a row: its texts, what its layout expects, its images and records.  Its
lines are exploded once and shuffled once, by the work; every rule on lines is a
window or an aggregate over that one distribution, rules on whole texts are
expressions of the row, and differences are taken between the work's own sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import cjk_ratio, equation_id, letter_count, strip_math, text
from foliant.operators.links import EMBED
from foliant.operators.rules import DOC_RULES, DUMP, EN_CAP, EN_RULES, EN_TAB, MATH_RULES, TAG, ZH_CAP, ZH_RULES, ZH_TAB, Rule, rx

EN, ZH, NOTES = "en.md", "zh.md", "notes.md"
STRINGS = "array<string>"
FINDING = "struct<level:string,file:string,rule:string,item:string>"
# Headings that must have words below, sections of a whole paper, and what is a table's or figure's own line.
MUST_HOLD = r"(?i)^(?:\d|abstract$|摘要$|亮点$|highlights$)"
FRONT = {"article": ("Abstract", ("亮点", "摘要")), "book": ("Preface", ("前言",)), "editorial": (None, ("亮点",))}
ITEM_LINE = r"^\*\*(?:Fig\.?|Figure|图|Table|表)\s*\d"
LEAST_BELOW, ABOVE, BELOW, BALANCE = 20, 4, 5, 2


def finding(level: str, file: Column | str, rule: Column | str, item: Column | str = "") -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(level).alias("level"), col(file).alias("file"), col(rule).alias("rule"), col(item).alias("item"))


def kept(*each: Column) -> Column:
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast(f"array<{FINDING}>")


def items(level: str, file: Column | str, rule: str, labels: Column) -> Column:
    """A finding for each label, in order."""
    return F.transform(F.array_sort(labels), lambda x: finding(level, file, rule, x))


def of_text(x: Column, file: str, rules: list[Rule]) -> list[Column]:
    return [F.when((x != "") & r[2](x), finding(r[1], file, r[0])) for r in rules]


def of_texts() -> Column:
    """Findings of whole texts of a row: lang, kind, en, zh, notes."""
    en, zh, notes = text("en"), text("zh"), text("notes")
    english = F.col("lang") == "en"
    kind = F.when(F.col("kind").isin(*FRONT), F.col("kind")).otherwise("article")
    math = [r for r in MATH_RULES if r[0] not in {d[0] for d in DOC_RULES}]
    gone = [F.when(cond & (F.trim(x) == ""), finding("E", f, "absent")) for cond, x, f in ((english, en, EN), (F.lit(True), zh, ZH), (F.lit(True), notes, NOTES))]
    title = [F.when((x != "") & ~F.ltrim(x).startswith("# "), finding("E", f, "title")) for x, f in ((en, EN), (zh, ZH))]
    has = lambda x, name: rx(x, rf"(?m)^## {name}\s*$")
    front = [F.when((en != "") & (kind == k) & ~has(en, e), finding("E", EN, "section", e)) for k, (e, _) in FRONT.items() if e]
    front += [F.when((zh != "") & (kind == k) & ~has(zh, z), finding("E", ZH, "section", z)) for k, (_, zs) in FRONT.items() for z in zs]
    letters = cjk_ratio(strip_math(zh))
    language = [F.when((zh != "") & (F.coalesce(letters, F.lit(0.0)) < 0.4), finding("E", ZH, "language")), *[F.when(rx(x, r"(?<!!)\[\[[^\]\n]+\]\]"), finding("W", f, "wikilink")) for x, f in ((en, EN), (zh, ZH))]]
    return kept(*gone, *of_text(en, EN, [*DOC_RULES, *math, *EN_RULES]), *of_text(zh, ZH, [*DOC_RULES, *math, *ZH_RULES]), *of_text(notes, NOTES, [*DOC_RULES, *math]), *title, *front, *language)


def marked_lines(works: DataFrame, id_: str) -> DataFrame:
    """One row a line with what the rules need of it and of its neighbours; dealt by the work, once."""
    english = F.col("lang") == "en"
    whole = F.struct("lang", "figures", "tables", "equations", "images", "files", "found")
    part = lambda x, file: F.transform(F.split(x, r"\r?\n"), lambda s, i: F.struct(F.lit(file).alias("file"), i.alias("no"), s.alias("line")))
    en = F.when(english, text("en")).otherwise("")
    all_ = F.concat(part(en, EN), part(text("zh"), ZH), part(text("notes"), NOTES))
    # what belongs to the work as a whole travels with its first line alone
    rows = works.withColumn("found", of_texts()).select(id_, whole.alias("_whole"), F.posexplode(all_).alias("_k", "l")).select(id_, F.when(F.col("_k") == 0, F.col("_whole")).alias("whole"), "l.*")
    s = F.trim("line")
    number = lambda e, z: F.when(F.col("file") == EN, F.regexp_extract(s, e, 1)).when(F.col("file") == ZH, F.regexp_extract(s, z, 1))
    all_of = lambda sign, p: F.when(F.contains("line", F.lit(sign)), F.regexp_extract_all("line", F.lit(p))).otherwise(F.array().cast(STRINGS))
    level = F.when(F.col("file") != NOTES, F.length(F.regexp_extract("line", r"^(#{2,3})\s+\S", 1)))
    dense = F.col("line")
    for blank in " \t\n\x0b\f\r":
        dense = F.replace(dense, F.lit(blank), F.lit(""))
    rows = rows.withColumns({"s": s, "fig": F.nullif(number(EN_CAP, ZH_CAP), F.lit("")), "tab": F.nullif(number(EN_TAB, ZH_TAB), F.lit("")), "embeds": all_of("![[", EMBED), "tags": all_of("\\tag{", TAG), "level": F.when(level > 0, level)})
    x = strip_math(F.col("s"))
    foreign = (F.col("file") == ZH) & (F.col("fig").isNotNull() | F.col("tab").isNotNull()) & (letter_count(x) >= 20) & (cjk_ratio(x) < 0.3)
    title = F.when(F.col("level").isNotNull(), F.regexp_extract("line", r"^#{2,3}\s+(.+?)\s*$", 1))
    # the shuffle takes what was found in a line, not the line
    rows = rows.select(
        id_, "whole", "file", "no", "fig", "tab", "embeds", "tags", "level", (F.col("s") != "").alias("full"), F.col("s").startswith("|").alias("bar"), F.length(dense).alias("size"),
        title.alias("title"), foreign.alias("foreign"), F.col("s").rlike(ITEM_LINE).alias("item"),
    ).repartition(id_)
    down = Window.partitionBy(id_, "file").orderBy("no")
    to_here, up = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(id_, "file").orderBy(F.desc("no")).rowsBetween(Window.unboundedPreceding, -1)
    form = F.when(~F.col("full"), 0).when(F.size("embeds") > 0, 2).otherwise(1)
    rows = rows.withColumns({
        **{f"_{i}": F.lag(form, i, 0).over(down) for i in range(1, ABOVE + 1)},
        "near": F.last(F.when(F.col("full"), F.col("embeds")), True).over(down.rowsBetween(-ABOVE, -1)),
        "table": F.coalesce(F.first(F.when(F.col("full"), F.col("bar")), True).over(down.rowsBetween(1, BELOW)), F.lit(False)),
        "head": F.count("level").over(to_here), "below": F.last("title", True).over(to_here), "sum": F.sum("size").over(to_here),
    })
    two = F.slice(F.filter(F.array(*[f"_{i}" for i in range(1, ABOVE + 1)]), lambda x: x > 0), 1, 2)
    rows = rows.withColumn("embedded", F.array_contains(two, 2)).drop(*[f"_{i}" for i in range(1, ABOVE + 1)])
    # upwards the first line of a file is its last, with the sum of all
    last = F.first("sum").over(up.rowsBetween(Window.unboundedPreceding, 0))
    ends = {f"_end{n}": F.last(F.when(F.col("level") <= n, F.col("sum") - F.col("size")), True).over(up) for n in (2, 3)}
    rows = rows.withColumns({**ends, "_all": last})
    return rows.drop("bar", "full").withColumn("held", F.coalesce(F.when(F.col("level") == 2, F.col("_end2")).otherwise(F.col("_end3")), F.col("_all")) - F.col("sum"))


def gathered(rows: DataFrame, id_: str) -> DataFrame:
    """One row a work: sets and lists of what its lines hold, of a section first, so that a section's own sums need no shuffle."""
    some = lambda cond, x: F.collect_list(F.when(cond, x))
    both = lambda num: F.struct("file", equation_id(num).alias("label"), num.alias("num"), "embedded", "table", F.col("near").alias("embeds"))
    held = finding("E", F.col("file"), "empty_section", F.col("title"))
    empty = F.when(F.col("title").rlike(MUST_HOLD), held).otherwise(held.withField("level", F.lit("W")))
    dumped = F.col("below").rlike(DUMP) & F.col("level").isNull()
    in_dump = F.sum(F.when(dumped, F.size("tags") + F.col("item").cast("int")).otherwise(0))
    by_section = rows.groupBy(id_, "file", "head", "below").agg(
        F.first("whole", True).alias("whole"), some(F.col("fig").isNotNull(), both(F.col("fig"))).alias("figs"), some(F.col("tab").isNotNull(), both(F.col("tab"))).alias("tabs"),
        F.flatten(some(F.size("embeds") > 0, F.col("embeds"))).alias("embeds"), F.flatten(some(F.size("tags") > 0, F.transform("tags", equation_id))).alias("tags"),
        F.collect_list(F.nullif(F.regexp_extract("title", r"^(\d+(?:\.\d+)*)", 1), F.lit(""))).alias("numbers"),
        F.flatten(F.array(some(F.col("held") < LEAST_BELOW, F.when(F.col("level").isNotNull(), empty)), some(F.col("foreign"), finding("E", ZH, "untranslated_caption", F.coalesce("fig", "tab"))))).alias("found"), in_dump.alias("dump"), F.count("*").alias("lines"),
    )
    own = by_section.withColumn("found", F.concat("found", kept(F.when(F.col("dump") > 1, finding("E", F.col("file"), "dump", F.col("below"))))))
    put = lambda c, file: F.flatten(F.collect_list(F.when(F.col("file") == file, F.col(c))))
    cols = {f"{c}_{file[:2]}": put(c, file) for c in ("figs", "tabs", "embeds", "tags", "numbers") for file in (EN, ZH)}
    return own.groupBy(id_).agg(F.first("whole", True).alias("whole"), put("embeds", NOTES).alias("embeds_no"), *[v.alias(k) for k, v in cols.items()], F.flatten(F.collect_list("found")).alias("found"), *[F.sum(F.when(F.col("file") == f, F.col("lines")).otherwise(0)).alias(f"lines_{f[:2]}") for f in (EN, ZH, NOTES)])


def verify(works: DataFrame, id_: str) -> DataFrame:
    """id, ok, errors, warnings (``file:rule`` or ``file:rule:item``, sorted), counts: all checks of works.

    works: lang, kind (article, book, editorial), en, zh, notes, figures, tables and equations (arrays of the labels that
    the layout expects), images (names of files) and files (map of a figure's number to its reviewed file; null: not
    checked).  Null texts are absent, null arrays empty.  An id that stands twice is one work of undefined texts.
    """
    g = gathered(marked_lines(works, id_), id_)
    array = lambda x: F.coalesce(x, F.array().cast(STRINGS))
    english = F.col("whole.lang") == "en"
    none = F.array().cast(f"array<{FINDING}>")
    labels = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    where = lambda c, name: F.filter(c, lambda x: x[name])
    out = [F.col("whole.found"), F.col("found")]
    sides = ((EN, english), (ZH, F.lit(True)))
    for file, cond in sides:
        side = file[:2]
        for kind, c, placed in (("figures", f"figs_{side}", "embedded"), ("tables", f"tabs_{side}", "table")):
            want, have = array(F.col(f"whole.{kind}")), labels(c)
            right = labels(where(c, placed))
            out += [F.when(cond, F.concat(items("E", file, f"no_{kind}", F.array_except(want, have)), items("E", file, f"not_{placed}", F.array_except(F.array_intersect(want, have), right)))).otherwise(none)]
        tags = F.array_distinct(f"tags_{side}")
        out += [F.when(cond, items("E", file, "no_equation", F.array_except(array(F.col("whole.equations")), tags))).otherwise(none)]
        used = F.array_distinct(f"embeds_{side}")
        out += [items("E", file, "own_image", F.filter(used, lambda x: x.startswith("_"))), items("E", file, "no_image", F.filter(F.array_except(used, array(F.col("whole.images"))), lambda x: ~x.startswith("_")))]
        of = lambda x: F.try_element_at(F.col("whole.files"), x["num"])
        wrong = F.filter(f"figs_{side}", lambda x: of(x).isNull() | ~array(x["embeds"]).eqNullSafe(F.array(of(x))))
        # a number stands twice where the sorted list holds it beside itself
        nums = F.array_sort(F.transform(f"figs_{side}", lambda x: x["num"]))
        twice = F.array_distinct(F.filter(F.transform(nums, lambda x, i: F.when(F.get(nums, i - 1) == x, x)), lambda x: x.isNotNull()))
        checked = F.concat(items("E", file, "caption_file", F.array_distinct(F.transform(wrong, lambda x: x["num"]))), items("E", file, "caption_twice", twice))
        out += [F.when(F.col("whole.files").isNotNull() & cond, checked).otherwise(none)]
    notes = F.array_distinct("embeds_no")
    out += [items("E", NOTES, "no_image", F.array_except(notes, array(F.col("whole.images"))))]
    shown = F.concat("embeds_en", "embeds_zh")
    out += [items("W", "images", "unused", F.array_except(F.filter(array(F.col("whole.images")), lambda x: ~x.startswith("_")), shown))]
    te, tz, ne, nz = (F.array_distinct(c) for c in ("tags_en", "tags_zh", "numbers_en", "numbers_zh"))
    extra = items("W", EN, "unexpected_equation", F.array_except(te, array(F.col("whole.equations"))))
    apart = items("W", ZH, "unmatched_equation", F.array_union(F.array_except(te, tz), F.array_except(tz, te)))
    sections = F.concat(items("E", ZH, "no_section", F.array_except(ne, nz)), items("W", ZH, "more_section", F.array_except(nz, ne)))
    some_zh = F.size("embeds_zh") > 0
    balance = kept(F.when(some_zh & (F.abs(F.size("embeds_zh") - F.size("embeds_en")) > BALANCE), finding("W", ZH, "balance")))
    out += [F.when(english, F.concat(extra, apart, sections, balance)).otherwise(none)]
    count = lambda c: F.size(F.array_distinct(c))
    counts = F.struct(*[f"lines_{x}" for x in ("en", "zh", "no")], *[F.size(labels(f"{c}_{x}")).alias(f"{n}_{x}") for n, c in (("figures", "figs"), ("tables", "tabs")) for x in ("en", "zh")], *[count(f"tags_{x}").alias(f"equations_{x}") for x in ("en", "zh")])
    g = g.select(id_, F.concat(*out).alias("f"), counts.alias("counts"))
    of_level = lambda level: F.array_sort(F.array_distinct(F.transform(F.filter("f", lambda x: x["level"] == level), lambda x: F.concat_ws(":", x["file"], x["rule"], F.nullif(x["item"], F.lit(""))))))
    return g.select(id_, (F.size(of_level("E")) == 0).alias("ok"), of_level("E").alias("errors"), of_level("W").alias("warnings"), "counts")
