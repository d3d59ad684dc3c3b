"""Column layout: spans of pages to paragraphs in reading order.

A page's spans come into lines by baseline, small print beside a line becomes its
sub- or superscripts, the gutter of each line is found from what covers the page
around it, lines are cut there, and the pieces are joined into paragraphs, band by
band.  Spans are shuffled by document once, or not at all where they are ``dealt``: all
of a document's stand together, as when its row was exploded into them.  ``paged`` goes
through them in Arrow batches of whole documents (see ``pages``); a page's lines are then
one array, in which its paragraphs are joined.  ``baselines``, ``scripted``,
``text_lines``, ``gutters`` and ``cut_lines`` are the same rules as windows, in which a
page of any length is streamed, at several times the cost.

spans: doc, page, width (of the page), x0, x1, by (baseline), t, size, bold, italic,
font.  Blank spans are left out; other columns take no part.  Ties of the body size
go to the larger; a document without spans over 3 points has 10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators import pages
from foliant.operators.layout import WIDE, despaced

PAGE = ("doc", "page")

# How captions, table titles, their sentences and formulas are recognised.
FIGURE_START = r"(?i)^(?:Fig\.?|Figure|FIGURE|图)\s*[A-Z]?\d{1,3}"
TABLE_START = r"(?i)^(?:Table|TABLE|表)\s*[A-Z]?\d{1,3}"
FIGURE_VERB = r"(?iU)^\s*(?:Fig\.?|Figure|图)\s*[A-Z]?\d{1,3}[a-z]?\s*[.:]?\s*(?:(?:shows?|illustrates?|depicts?|displays?|presents?|gives?|compares?|demonstrates?|plots?|summarizes?|indicates?|reveals?|provides?|reports?|and|to|in|of|for|is|are|was|were|also)\b|中|所示|给出|显示|为|展示|反映|表明|可见|可以看出|说明|对比|描述|绘出|示出)"
TABLE_VERB = r"(?iU)^\s*(?:Table|表)\s*[A-Z]?\d{1,3}\s*[.:]?\s*(?:shows?|lists?|summarizes?|presents?|gives?|compares?|and|to|in|of|for|is|are|中|所示|给出|列出)\b"
CAPTION = r"(?iU)^\s*(Fig\.?|Figure|FIG\.?|图)\s*([A-Z]?\d{1,3}[a-z]?)\b\.?"
TABLE_CAPTION = r"(?iU)^\s*(Table|TABLE|表)\s*([A-Z]?\d{1,3})\b\.?"
LABEL_ONLY = r"(?iU)^\s*(?:Fig\.?|Figure|FIG\.?|Table|TABLE|图|表)\s*(?:[A-Z]?\d{1,3}[a-z]?)?\s*[.:：]?\s*$"
EQUATION_NUMBER = r"[(（]\s*(\d{1,3}[a-z]?)\s*[)）]"
MATH_FONT = r"(?i)math|symbol|cmmi|cmsy|cmex|mtmi|mtsy|mtex|euclid|msam|msbm|stix"
MATHY = r"[=∕∑∫∂∇√≈≤≥×÷{}]|_\{|\^\{"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: First parts of words whose hyphen stays at the end of a line.
KEEP_HYPHEN = (
    "non fluid particle two one three self quasi semi multi inter intra cross co pre post well sub super micro macro ultra anti half full"
    " long short high low large small time space real wall gas solid liquid free in coarse fine grid drag shape size density volume fixed finite"
    " lattice single double mass stress second first data field model based depth flow water debris rain soil rock ice snow land sea wind"
).split()
#: A whole word that begins like one of them; the first letter is tried once for all of its words.
KEPT_WORD = "(?i)(?<![A-Za-z])((?:" + "|".join(f"{a}(?:{'|'.join(w[1:] for w in KEEP_HYPHEN if w[0] == a)})" for a in sorted({w[0] for w in KEEP_HYPHEN})) + ")[A-Za-z]*)"
HEADS = ("[BOLD] ", "[ITAL] ", "[BIG] ")

#: Points: lines of one baseline; bins of the page's width; least gutter; reach of scripts.
BASELINE, BIN, GUTTER = 1.6, 2.0, 8.0
#: Lines above and below a line whose ink says where its gutter is.
AROUND = 8


def like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cleaned(spans: DataFrame) -> DataFrame:
    """Spans with ligatures as letters, without blank ones."""
    t = F.col("t")
    for k, v in LIGATURES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    cols = ("width", "x0", "x1", "by", "size")
    return spans.select(*PAGE, *[F.col(c).cast("double").alias(c) for c in cols], "bold", "italic", "font", t.alias("t")).where(like(F.col("t"), r"(?U)\S"))


def span_body(spans: DataFrame) -> DataFrame:
    """doc, body: the size, to a tenth, of most spans over 3 points."""
    n = spans.groupBy("doc", F.round("size", 1).alias("s")).agg(F.count("*").alias("n"))
    body = F.max_by("s", F.when(F.col("s") > 3, F.struct("n", "s")))
    return n.groupBy("doc").agg(F.coalesce(body, F.lit(10.0)).alias("body"))


def baselines(spans: DataFrame) -> DataFrame:
    """spans with line: the first baseline of their line, which reaches 1.6 points on."""
    down = Window.partitionBy(*PAGE).orderBy("by", "x0")
    far = F.col("by") - F.lag("by").over(down) > BASELINE
    chained = spans.withColumn("_i", F.sum(F.when(far, 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    # a chain of close baselines may be longer than a line: lines begin anew along it
    own = F.array_sort(F.filter(F.collect_set("by").over(Window.partitionBy(*PAGE, "_i")), lambda y: y <= F.col("by")))
    first = F.aggregate(own, F.lit(None).cast("double"), lambda a, y: F.when(a.isNull() | (y - a > BASELINE), y).otherwise(a))
    return chained.withColumn("line", first).drop("_i")


def scripted(spans: DataFrame) -> DataFrame:
    """spans(line, body) with script ('', 'sup' or 'sub'): lines of small spans alone
    join the nearest other line from 3.5 points above to 4.5 below them, if they begin
    within 20 points of it; the upper of two that are as near."""
    small = F.col("body") * 0.82
    of = Window.partitionBy(*PAGE, "line")
    s = spans.withColumns({"_n": F.max(F.col("size") >= small).over(of), "_lo": F.min("x0").over(of), "_hi": F.max("x1").over(of), "_end": F.max("x0").over(of)})
    near = Window.partitionBy(*PAGE).orderBy(F.col("line") * 2).rangeBetween(-7, 9)  # half points
    found = F.collect_set(F.when(F.col("_n"), F.struct(F.col("line").alias("y"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))).over(near)
    fits = F.filter(found, lambda n: (F.col("_lo") >= n["lo"] - 20) & (F.col("_end") <= n["hi"] + 20))
    best = F.array_min(F.transform(fits, lambda n: F.struct(F.abs(n["y"] - F.col("line")).alias("d"), n["y"].alias("y"))))["y"]
    s = s.withColumn("_best", F.when(~F.col("_n"), best))
    dy = F.col("line") - F.col("_best")
    script = F.when(dy < -0.8, "sup").when(dy > 0.8, "sub").otherwise("")
    return s.withColumns({"script": script, "line": F.coalesce("_best", "line")}).drop("_n", "_lo", "_hi", "_end", "_best")


def text_lines(spans: DataFrame) -> DataFrame:
    """spans(line, script, body) -> doc, page, line, width, body, spans (by x0): one row a line."""
    row = F.struct("x0", "x1", "script", "t", "size", "bold", "italic", "font")
    return spans.groupBy(*PAGE, "line").agg(F.first("width").alias("width"), F.first("body").alias("body"), F.sort_array(F.collect_list(row)).alias("spans"))


def bin_of(x: Column) -> Column:
    return (x / BIN).cast("int")


def gutters(lines: DataFrame) -> DataFrame:
    """lines with gutter: the x of the gutter of each line's surroundings, null for none.

    Over the line and the eight above and below it, the spans are counted by bins of
    two points.  Runs of eight points or more between 20 % and 80 % of the width that
    at most one span crosses are candidates.  Of those with words of three lines or
    more on either side the one nearest the middle is taken, then the widest; else
    the widest candidate, if there are words of three lines on one side at least.
    """
    lo, hi = bin_of(F.col("width") * 0.2), bin_of(F.col("width") * 0.8)
    event = lambda b, d: F.struct(b.alias("b"), F.lit(d).alias("d"))
    within = F.filter("spans", lambda s: (bin_of(s["x0"]) < hi) & (bin_of(s["x1"]) >= lo))
    # a line's room by bins is 1 less its spans there; only where that changes is carried,
    # so a whole line is no event and a cut one has two
    ends = F.flatten(F.transform(within, lambda s: F.array(event(F.greatest(bin_of(s["x0"]), lo), -1), event(F.least(bin_of(s["x1"]) + 1, hi), 1))))
    ends = F.concat(F.array(event(lo, 1), event(hi, -1)), ends)
    net = lambda es: F.filter(F.transform(F.array_distinct(F.transform(es, lambda e: e["b"])), lambda b: F.struct(b.alias("b"), F.aggregate(es, F.lit(0), lambda n, e: n + F.when(e["b"] == b, e["d"]).otherwise(0)).alias("d"))), lambda e: e["d"] != 0)
    ink = lines.withColumns({"_ink": let(ends, net), "_l": F.array_min(F.transform("spans", lambda s: s["x1"])), "_r": F.array_max(F.transform("spans", lambda s: s["x0"])), "_lo": lo, "_hi": hi})
    around = Window.partitionBy(*PAGE).orderBy("line").rowsBetween(-AROUND, AROUND)
    ink = ink.withColumns({"_inks": F.flatten(F.collect_list("_ink").over(around)), "_ls": F.collect_list("_l").over(around), "_rs": F.collect_list("_r").over(around)}).drop("_ink", "_l", "_r")
    # beyond the last bin nothing is free, so that the last run ends there
    events = F.concat(F.array_sort("_inks"), F.array(event(F.col("_hi"), -1000), event(F.col("_hi") + 1, 0)))
    enough = F.size("_ls") - 1
    least = int(GUTTER / BIN)

    def sweep(acc: Column, e: Column) -> Column:
        """acc: last place, room of all lines behind it, begin of the free run, runs."""
        moved, free = e["b"] > acc["at"], acc["n"] >= enough
        ended = moved & ~free & acc["from"].isNotNull()
        run = F.array(F.struct((acc["from"] * BIN).alias("a"), (acc["at"] * BIN).alias("z")))
        return F.struct(
            e["b"].alias("at"),
            (acc["n"] + e["d"]).alias("n"),
            F.when(~moved, acc["from"]).when(free, F.coalesce(acc["from"], acc["at"])).alias("from"),
            F.when(ended & (acc["at"] - acc["from"] >= least), F.concat(acc["runs"], run)).otherwise(acc["runs"]).alias("runs"),
        )

    start = F.struct(F.col("_lo").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("from"), F.array().cast("array<struct<a:double,z:double>>").alias("runs"))
    ink = ink.withColumn("_runs", F.when(F.col("_hi") > F.col("_lo"), F.aggregate(events, start, sweep)["runs"]).otherwise(F.array().cast("array<struct<a:double,z:double>>"))).drop("_inks", "_lo", "_hi")
    count = lambda col, test: F.size(F.filter(col, test))
    both = F.filter("_runs", lambda r: (count("_ls", lambda v: v <= r["a"] + 1) >= 3) & (count("_rs", lambda v: v >= r["z"] - 1) >= 3))
    scored = F.array_min(F.transform(both, lambda r: F.struct(F.abs((r["a"] + r["z"]) / 2 - F.col("width") / 2).alias("far"), (r["a"] - r["z"]).alias("wide"), ((r["a"] + r["z"]) / 2).alias("x"))))["x"]
    widest = F.array_min(F.transform("_runs", lambda r: F.struct((r["a"] - r["z"]).alias("wide"), r["a"].alias("a"), ((r["a"] + r["z"]) / 2).alias("x"))))["x"]
    ink = ink.withColumns({"_both": scored, "_one": widest})
    one = F.when((count("_ls", lambda v: v < F.col("_one")) >= 3) | (count("_rs", lambda v: v > F.col("_one")) >= 3), F.col("_one"))
    return ink.withColumn("gutter", F.coalesce("_both", one)).drop("_ls", "_rs", "_runs", "_both", "_one")


def rendered(spans: Column) -> Column:
    """Text of spans from left to right: scripts marked, a space where there is room
    of more than a point and neither side is CJK, spaced words and marks closed up."""
    # most texts have no white space but single spaces between ASCII words
    own = lambda s: F.when(like(s["t"], r"^[^!-~]|[^!-~]\z"), stripped(s["t"])).otherwise(s["t"])

    def add(s: Column, i: Column) -> Column:
        before = F.get(spans, i - 1)
        apart = (i > 0) & (s["x0"] - before["x1"] > 1.0) & ~((before["script"] == "") & like(own(before), WIDE + r"\z")) & ~((s["script"] == "") & like(own(s), "^" + WIDE))
        t = F.when(s["script"] == "sup", F.concat(F.lit("^{"), own(s), F.lit("}"))).when(s["script"] == "sub", F.concat(F.lit("_{"), own(s), F.lit("}"))).otherwise(own(s))
        return F.when(apart, F.concat(F.lit(" "), t)).otherwise(t)

    return let(F.array_join(F.transform(spans, add), ""), closed)


def closed(t: Column) -> Column:
    """A line's text with single spaces, spaced words and marks closed up."""
    odd = like(t, r"[^ -~]|  |^ | \z")
    t = despaced(F.when(odd, stripped(F.regexp_replace(t, r"(?U)\s+", " "))).otherwise(t))
    return let(t, lambda t: F.when(like(t, r"\s[_^]\{|[^ -~]"), F.regexp_replace(F.regexp_replace(t, r"\s+([_^]\{)", "$1"), r"\s*([，。；：！？、（）《》「」【】])\s*", "$1")).otherwise(t))


def mark_of(t: Column, line) -> Column:  # noqa: ANN001
    """What kind of line this may be: ``[CAP] `` and so on, with a space behind it, or
    nothing.  ``line`` has flags: whether it has spans that are no scripts (plain), and
    whether half of these, or all, are ``math``, ``bold``, ``italic``, ``small`` or ``large``."""
    wordy = (F.regexp_count(t, F.lit(r"[A-Za-z]{3,}")) >= 4) & ~like(t, MATHY) & ~like(F.right(t, F.lit(8)), EQUATION_NUMBER)
    short = F.length(t) < 140
    return (
        F.when(~line["plain"], "")
        .when(like(t, FIGURE_START) & ~like(t, FIGURE_VERB), "[CAP] ")
        .when(like(t, TABLE_START) & ~like(t, TABLE_VERB), "[TAB] ")
        .when(line["math"] & ~wordy, "[MATH] ")
        .when(line["bold"] & short, "[BOLD] ")
        .when(line["italic"] & short, "[ITAL] ")
        .when(line["small"], "[small] ")
        .when(line["large"], "[BIG] ")
        .otherwise("")
    )


def line_mark(spans: Column, t: Column, body: Column) -> Column:
    """The mark of a line of these spans."""
    big = F.filter(spans, lambda s: s["script"] == "")
    n = F.size(big)
    n_math = F.size(F.filter(big, lambda s: like(s["font"], MATH_FONT)))
    every = lambda test: F.forall(big, test)
    line = {"plain": n > 0, "math": n_math >= F.greatest(F.lit(1), F.floor(n / 2)), "bold": every(lambda s: s["bold"]), "italic": every(lambda s: s["italic"])}
    return mark_of(t, line | {"small": every(lambda s: s["size"] < body - 1.0), "large": every(lambda s: s["size"] > body + 1.5)})


def cut_lines(lines: DataFrame) -> DataFrame:
    """doc, page, body, by, kind, x0, x1, text, mark: lines cut at their gutter into L
    and R; whole lines (F) where there is none, a span crosses it, or the halves are
    less than 6 points apart."""
    g = F.col("gutter")
    crossing = lambda s: (s["x0"] < g - 3) & (s["x1"] > g + 3)
    lines = lines.withColumns({"_l": F.filter("spans", lambda s: (s["x1"] <= g + 3) & ~crossing(s)), "_r": F.filter("spans", lambda s: (s["x0"] >= g - 3) & ~crossing(s))})
    room = F.array_min(F.transform("_r", lambda s: s["x0"])) - F.array_max(F.transform("_l", lambda s: s["x1"]))
    whole = g.isNull() | F.exists("spans", crossing) | F.coalesce((F.size("_l") > 0) & (F.size("_r") > 0) & (room < 6), F.lit(False))
    piece = lambda kind, spans: F.struct(F.lit(kind).alias("kind"), spans.alias("spans"))
    pieces = F.when(whole, F.array(piece("F", F.col("spans")))).otherwise(F.filter(F.array(piece("L", F.col("_l")), piece("R", F.col("_r"))), lambda p: F.size(p["spans"]) > 0))
    items = lines.select(*PAGE, "body", F.col("line").alias("by"), F.explode(pieces).alias("p")).select(*PAGE, "body", "by", "p.kind", "p.spans")
    items = items.withColumns({"x0": F.array_min(F.transform("spans", lambda s: s["x0"])), "x1": F.array_max(F.transform("spans", lambda s: s["x1"])), "text": rendered(F.col("spans"))})
    return items.withColumn("mark", line_mark(F.col("spans"), F.col("text"), F.col("body"))).drop("spans")


#: What the pages' lines are found by (see ``pages``).
RULES = {"baseline": BASELINE, "bin": BIN, "gutter": GUTTER, "around": AROUND, "wide": WIDE, "math": MATH_FONT, "kept": KEPT_WORD, "ligatures": LIGATURES}


def paged(spans: DataFrame, dealt: bool = False) -> DataFrame:
    """doc, page, body, words, items: a row a page with its cut lines, by bands (runs of whole
    lines and of cut ones, down the page) and columns: by, kind, x0, x1, band, raw (what the
    spans say), whether there is more room above than in a paragraph (gap), the line before
    in its column ends short (ragged) or this one begins farther in (indent), and the flags
    of ``mark_of``.  words: see ``hyphen_closed``.

    dealt: the spans of each document stand together already, so nothing is shuffled.
    """
    numbers = ("width", "x0", "x1", "by", "size")
    s = spans.select(*PAGE, *[F.col(c).cast("double").alias(c) for c in numbers], "t", "bold", "italic", "font")
    if not dealt:
        s = s.repartition("doc").sortWithinPartitions("doc")
    item = "struct<by:double,kind:string,x0:double,x1:double,band:bigint,raw:string," + ",".join(f"{c}:boolean" for c in pages.FLAGS) + ">"
    of = ",".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in PAGE)

    def each(batches):
        return (b for b in pages.whole(batches, "doc", lambda t: pages.laid_out(t, RULES)) if b is not None)

    return s.mapInArrow(each, f"{of},body double,words array<string>,items array<{item}>")


def page_items(spans: DataFrame, dealt: bool = False) -> DataFrame:
    """The cut lines of all pages, from their spans: as ``cut_lines``, and with band, gap, ragged and indent (see ``paged``)."""
    items = paged(spans, dealt).select(*PAGE, "body", F.explode("items").alias("i")).withColumn("text", closed(F.col("i.raw")))
    own = [F.col(f"i.{c}").alias(c) for c in ("by", "kind", "x0", "x1", "band", "gap", "ragged", "indent")]
    return items.select(*PAGE, "body", *own, "text", mark_of(F.col("text"), F.col("i")).alias("mark"))


def begins(line: Column, before: Column) -> Column:
    """Whether a paragraph begins with a line, after the line before it in the order of columns.

    It does at the top of a column, after more than 1.75 body sizes of room, where the mark
    changes, at a caption or title, after a line that ends short of the column's right edge by
    more than 12 % (not beside formulas or between headings), and at an indent of more
    than 4.5 points: from the column's left edge, or for whole lines from the line before.
    """
    mark, was = line["mark"], before["mark"]
    top = was.isNull() | (line["band"] != before["band"]) | (line["kind"] != before["kind"])
    heads = mark.isin(*HEADS) & was.isin(*HEADS)
    math_before = was == "[MATH] "
    ragged = line["ragged"] & ~heads & ~math_before & (mark != "[MATH] ")
    indent = line["indent"] & ((line["kind"] != "F") | ~heads) & ~math_before
    return top | line["gap"] | (mark != was) | mark.isin("[CAP] ", "[TAB] ") | ragged | indent


def hyphen_closed(before: Column, text: Column, words: Column) -> Column:
    """Whether the hyphen at the end of the line before goes, as its first part isn't one that
    keeps it, or the whole word is one of the document's ``words`` that begin like these parts."""
    stem = F.lower(F.regexp_extract(before, r"([A-Za-z]+)-$", 1))
    head = F.lower(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    return (stem != "") & (head != "") & (~stem.isin(*KEEP_HYPHEN) | F.coalesce(F.array_contains(words, F.concat(stem, head)), F.lit(False)))


def paragraphs(spans: DataFrame, dealt: bool = False) -> DataFrame:
    """doc, page, pos (from 1), kind, mark, text: the paragraphs of each page in reading
    order: band by band, in a band the left column before the right."""
    row = lambda i, t: F.struct(*[i[c].alias(c) for c in ("kind", "band", "gap", "ragged", "indent")], t.alias("text"), mark_of(t, i).alias("mark"))
    rows = paged(spans, dealt).select(*PAGE, "words", F.transform("items", lambda i: let(closed(i["raw"]), lambda t: row(i, t))).alias("lines"))
    at = lambda i: F.get("lines", i)
    first = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: begins(at(i), at(i - 1)))

    def add(a: Column, i: Column) -> Column:
        t, before = at(i)["text"], at(i - 1)["text"]
        hyphen = a.endswith("-") & like(t, r"^\p{Ll}")
        tight = like(a, WIDE + r"\z") & like(t, "^" + WIDE)
        return F.when(a.isNull(), t).when(hyphen & hyphen_closed(before, t, F.col("words")), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), t)).when(hyphen | tight, F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t))

    def text(i: Column, n: Column) -> Column:
        plain = F.array_join(F.transform(F.slice("lines", i + 1, n), lambda x: x["text"]), " ")
        one_by_one = F.aggregate(F.sequence(i, i + n - 1), F.lit(None).cast("string"), add)
        # most have neither a hyphen at the end of a line nor a wide letter
        return let(plain, lambda t: F.when(like(t, r"- |[^\x00-\x7f]"), one_by_one).otherwise(t))

    para = lambda i, n: F.struct(at(i)["kind"].alias("kind"), at(i)["mark"].alias("mark"), text(i, n).alias("text"))
    rows = rows.withColumn("first", first)
    paras = F.transform("first", lambda i, k: para(i, F.coalesce(F.get("first", k + 1), F.size("lines")) - i))
    return rows.select(*PAGE, F.posexplode(paras).alias("pos", "p")).select(*PAGE, (F.col("pos") + 1).alias("pos"), "p.kind", "p.mark", "p.text")


def column_text(paras: DataFrame) -> DataFrame:
    """doc, text: the paragraphs of a document as one text, with a mark before each page."""
    head = F.when(F.col("pos") == 1, F.concat(F.lit("\n<!-- ===== p"), F.col("page").cast("string"), F.lit(" ===== -->\n\n\n"))).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("page", "pos", F.concat(head, "mark", "text").alias("t"))))
    return paras.groupBy("doc").agg(F.concat(F.ltrim(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n"), F.lit("\n")), F.lit("\n")).alias("text"))


def column_hints(paras: DataFrame) -> DataFrame:
    """doc, figures, tables, equations: the numbers that captions, titles and formulas show, in order."""
    number = lambda p: F.when(like(F.col("text"), p), F.regexp_extract(F.regexp_extract("text", p, 0), r"\d{1,3}", 0).cast("int"))
    formula = (F.col("mark") == "[MATH] ") | (like(F.col("text"), MATHY) & like(F.right("text", F.lit(8)), EQUATION_NUMBER))
    equations = F.when(formula, F.transform(F.regexp_extract_all("text", F.lit(EQUATION_NUMBER), F.lit(1)), lambda x: F.regexp_extract(x, r"\d{1,3}", 0).cast("int")))
    p = paras.select("doc", F.when(F.col("mark") == "[CAP] ", number(FIGURE_START)).alias("f"), F.when(F.col("mark") == "[TAB] ", number(TABLE_START)).alias("t"), equations.alias("e"))
    return p.groupBy("doc").agg(F.array_sort(F.collect_set("f")).alias("figures"), F.array_sort(F.collect_set("t")).alias("tables"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("e")))).alias("equations"))


def two_column_pages(items: DataFrame) -> DataFrame:
    """doc, pages: how many pages have more than ten cut lines."""
    n = items.groupBy(*PAGE).agg(F.count_if(F.col("kind") != "F").alias("n"))
    return n.groupBy("doc").agg(F.count_if(F.col("n") > 10).alias("pages"))
