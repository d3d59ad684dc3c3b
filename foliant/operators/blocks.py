"""Blocks of a page: spans to lines of text, lines to segments, segments in reading order.

spans: doc, page, block, line, seq (order in the line), t, size, y (baseline), font,
bold, raised (flags of the font), and the line's x0, y0, x1, y1.  What is gathered
into an array is one line's spans or one block's lines; the rest are windows over
(doc, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators.columns import CAPTION, LABEL_ONLY, PAGE, TABLE_CAPTION, WIDE, like, stripped
from foliant.operators.layout import despaced, label_like

#: Fixed value: fonts whose names say that they are bold.
BOLD_FONT = r"(?i)bold|black|heavy|semibold|demibold|hei\b|hei[-_]|_hei|BL$|-B$|\.B$|Bd$"
RECT = ("x0", "y0", "x1", "y1")
#: Characters that a bare label has at most.
BARE = 60


def marked_text(spans: Column, main: Column) -> Column:
    """Text of a line's spans in order, small or raised ones as ^{} and _{} by their
    baseline against the middle one of the spans of the main size."""
    mains = F.filter(spans, lambda s: (s["size"] >= main - 0.6) | (s["size"] <= 0.5))
    ys = F.array_sort(F.transform(mains, lambda s: s["y"]))
    base = F.get(ys, F.floor(F.size(ys) / 2).cast("int"))

    def add(out: Column, s: Column) -> Column:
        size = F.when(s["size"] > 0.5, s["size"]).otherwise(main)
        small = (main - size >= 1.0) & (size <= main * 0.85)
        up = s["raised"] | (small & (s["y"] - base < -1.2))
        down = small & (s["y"] - base > 1.2)
        script = F.concat(F.regexp_replace(out, r"(?U)\s+$", ""), F.when(up, "^{").otherwise("_{"), stripped(s["t"]), F.lit("}"))
        return F.when(like(s["t"], r"(?U)\S") & (up | down), script).otherwise(F.concat(out, s["t"]))

    return F.aggregate(spans, F.lit(""), add)


def marked_lines(spans: DataFrame, body: float = 10.0) -> DataFrame:
    """doc, page, block, line, text, size, bold, font, x0, y0, x1, y1: one row for each
    line with text; the size is the largest, bold means more than 60 % of the characters."""
    row = F.struct("seq", "t", F.col("size").cast("double").alias("size"), F.col("y").cast("double").alias("y"), (F.col("bold") | like(F.col("font"), BOLD_FONT)).alias("bold"), "raised", "font")
    # dealt by the document: this one shuffle serves what is gathered by line, and then by block
    lines = spans.where(F.col("t") != "").repartition("doc").groupBy(*PAGE, "block", "line", *RECT).agg(F.array_sort(F.collect_list(row)).alias("spans"))
    sizes = F.filter(F.transform("spans", lambda s: s["size"]), lambda v: v > 0.5)
    lines = lines.withColumn("size", F.coalesce(F.array_max(sizes), F.lit(float(body))))
    count = lambda test: F.aggregate("spans", F.lit(0), lambda a, s: a + F.when(test(s), F.length(s["t"])).otherwise(0))
    bold = count(lambda s: s["bold"]) / count(lambda s: F.lit(True)) > 0.6
    out = lines.select(*PAGE, "block", "line", stripped(marked_text(F.col("spans"), F.col("size"))).alias("text"), "size", bold.alias("bold"), F.get("spans", F.lit(0))["font"].alias("font"), *RECT)
    return out.where(F.col("text") != "")


def joined(lines: Column) -> Column:
    """Lines to one text: CJK neighbours and hyphened words without a space."""

    def add(a: Column, t: Column) -> Column:
        tight = like(a, WIDE + r"\z") & like(t, "^" + WIDE)
        hyphen = a.endswith("-") & like(t, r"^\p{Ll}")
        return F.when(a.isNull(), t).when(tight, F.concat(a, t)).when(hyphen, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), t)).otherwise(F.concat(a, F.lit(" "), t))

    return F.aggregate(lines, F.lit(None).cast("string"), add)


def most_common(values: Column) -> Column:
    """The value that stands most often; of several the one that comes first."""
    n = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(n)["v"]


def segments(lines: DataFrame) -> DataFrame:
    """doc, page, block, seg, text, lines, size, bold, font, x0, y0, x1, y1: a block's
    lines cut where a heading, caption or other paragraph begins.

    A line begins a segment if its boldness or size (by a point) differs from the line
    before, and the segment has two lines at most or the line 120 characters at most;
    if it looks like a label and the line before ends a sentence; if the segment is
    one short line that looks like a label, and this line doesn't; or if more than
    nine tenths of the larger size lie between them.  A segment that is a bare label
    (``Fig. 2.``) takes the next one in.
    """
    line = F.struct("line", "text", "size", "bold", "font", *RECT, label_like(F.col("text")).alias("label"))
    blocks = lines.groupBy(*PAGE, "block").agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def told(x: Column, k: Column) -> Column:
        """A line with what speaks for a cut before it."""
        was = F.get(F.col("lines"), k - 1)
        style = (x["bold"] != was["bold"]) | (F.abs(x["size"] - was["size"]) >= 1.0)
        after_end = x["label"] & like(was["text"], r"[.!?:。！？；;)]$|^\s*$")
        under_label = was["label"] & (F.length(was["text"]) <= 60) & ~like(was["text"], LABEL_ONLY) & ~x["label"]
        gap = x["y0"] - was["y1"] > F.greatest(x["size"], was["size"]) * 0.9
        marks = ((style & (F.length(x["text"]) <= 120)).alias("always"), style.alias("early"), (after_end | gap).alias("cut"), under_label.alias("one"))
        return F.struct(*marks, *[x[c].alias(c) for c in ("text", "size", "bold", "font", *RECT)])

    blocks = blocks.withColumn("rows", F.transform("lines", told))

    def step(acc: Column, r: Column) -> Column:
        """acc: lines of the open segment, text of what a bare label may still take in, and
        a mark for each line: 1 if it begins a segment."""
        cut = (acc["n"] > 0) & F.coalesce(r["always"] | r["cut"] | (r["early"] & (acc["n"] <= 2)) | (r["one"] & (acc["n"] == 1)), F.lit(False))
        taken = cut & F.coalesce(like(acc["open"], LABEL_ONLY), F.lit(False))
        new = (acc["n"] == 0) | (cut & ~taken)
        text = F.when(new, r["text"]).when(acc["open"].isNotNull(), joined(F.array(acc["open"], r["text"])))
        return F.struct(
            F.when(cut, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(F.length(text) <= BARE, text).alias("open"),
            F.concat(acc["marks"], F.when(new, "1").otherwise("0")).alias("marks"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("open"), F.lit("").alias("marks"))
    blocks = blocks.withColumn("marks", F.aggregate("rows", start, step)["marks"])
    flags = F.filter(F.transform(F.split("marks", ""), lambda m, i: F.when(m == "1", i)), lambda i: i.isNotNull())
    own = let(flags, lambda at: F.transform(at, lambda a, j: F.slice("rows", a + 1, F.coalesce(F.get(at, j + 1), F.size("rows")) - a)))
    s = blocks.select(*PAGE, "block", F.posexplode(own).alias("seg", "rows"))
    field = lambda c: F.transform("rows", lambda r: r[c])
    bold = F.size(F.filter("rows", lambda r: r["bold"])) >= F.greatest(F.lit(1.0), F.size("rows") * 0.6)
    rect = [(F.array_min if c[1] == "0" else F.array_max)(field(c)).alias(c) for c in RECT]
    return s.select(*PAGE, "block", "seg", joined(field("text")).alias("text"), F.size("rows").alias("lines"), most_common(F.transform("rows", lambda r: F.round(r["size"], 1))).alias("size"), bold.alias("bold"), most_common(field("font")).alias("font"), *rect)


def kept_segments(segs: DataFrame, regions: DataFrame, pages: DataFrame, body: float) -> DataFrame:
    """Segments without what regions (figures, tables) hold by more than 60 % of its
    area, unless it is a caption; without running heads in the outer 4.5 % of a page;
    without small print of up to four lines in its lowest 18 %.  pages: doc, page, height."""
    r = regions.select(*[F.col(c).alias("r" + c) for c in (*PAGE, *RECT)])
    across = F.least("x1", "rx1") - F.greatest("x0", "rx0")
    down = F.least("y1", "ry1") - F.greatest("y0", "ry0")
    held = (across > 0) & (down > 0) & (across * down > 0.6 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    t = despaced(F.col("text"))
    s = segs.withColumn("_cap", like(t, CAPTION) | like(t, TABLE_CAPTION))
    s = s.join(r, (F.col("doc") == F.col("rdoc")) & (F.col("page") == F.col("rpage")) & held & ~F.col("_cap"), "left_anti")
    s = s.join(pages.select(*PAGE, "height"), [*PAGE])
    h = F.col("height")
    edge = ((F.col("y1") <= h * 0.045) | (F.col("y0") >= h * 0.955)) & (F.col("lines") <= 2) & (F.length("text") < 160)
    foot = (F.col("y0") >= h * 0.82) & (F.col("size") <= body - 1.5) & (F.col("lines") <= 4) & ~like(F.col("text"), TABLE_CAPTION) & ~F.col("text").startswith("|")
    return s.where(~edge & ~foot).drop("_cap", "height")


def ordered_blocks(blocks: DataFrame, ids: tuple[str, ...] = ("block", "seg")) -> DataFrame:
    """blocks with pos (from 1): their reading order on the page.

    Blocks under 62 % of the text's width are narrow.  Where they hold less than 45 %
    of the characters, order is by rows of four points, then from left to right.
    Otherwise wide blocks close bands, and in a band the left column comes before
    the right one; the columns part 3 points before the first narrow block that
    begins right of the middle less 15 % of the width, else in the middle.
    """
    of = Window.partitionBy(*PAGE)
    left = F.min("x0").over(of)
    b = blocks.withColumns({"_x": left, "_w": F.greatest(F.max("x1").over(of) - left, F.lit(1.0))})
    narrow = F.col("x1") - F.col("x0") < 0.62 * F.col("_w")
    b = b.withColumns({"_narrow": narrow, "_mid": F.col("_x") + F.col("_w") / 2})
    n = F.length("text")
    share = F.sum(F.when(F.col("_narrow"), n).otherwise(0)).over(of) / F.greatest(F.sum(n).over(of), F.lit(1))
    right = F.min(F.when(F.col("_narrow") & (F.col("x0") > F.col("_mid") - 0.15 * F.col("_w")), F.col("x0"))).over(of)
    b = b.withColumns({"_rows": share < 0.45, "_split": F.coalesce(right - 3, F.col("_mid"))})
    down = Window.partitionBy(*PAGE).orderBy("y0", *ids)
    band = F.sum(F.when(F.col("_narrow"), 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, -1))
    side = F.when(~F.col("_narrow"), 2).when(F.col("x0") >= F.col("_split"), 1).otherwise(0)
    key = F.when(F.col("_rows"), F.struct(F.bround(F.col("y0") / 4).alias("a"), F.col("x0").alias("b"), F.lit(0.0).alias("c"))).otherwise(F.struct(F.coalesce(band, F.lit(0)).cast("double").alias("a"), side.cast("double").alias("b"), F.col("y0").alias("c")))
    b = b.withColumn("_key", key)
    return b.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("_key", *ids)).cast("int")).drop("_x", "_w", "_narrow", "_mid", "_rows", "_split", "_key")
