"""Page layout: reading order, paragraphs, captions and regions on span tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import let


def reading_order(blocks: DataFrame, page: list[str], id_: str, middle: float) -> DataFrame:
    """blocks with pos: bands end at wide blocks; in a band left before right, then down."""
    down = Window.partitionBy(*page).orderBy("y0", id_).rowsBetween(Window.unboundedPreceding, 0)
    band = F.sum(F.when(F.col("wide"), 1).otherwise(0)).over(down)
    column = F.when(F.col("wide"), 0).when(F.col("x0") >= middle, 2).otherwise(1)
    b = blocks.withColumns({"band": band, "column": column})
    return b.withColumn("pos", F.row_number().over(Window.partitionBy(*page).orderBy("band", "column", "y0", id_)))


def body_size(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, size: the font size of most characters, to a tenth of a point; ties to the smaller."""
    s = spans.groupBy(doc, F.round("size", 1).alias("s")).agg(F.sum(F.length("t")).alias("n"))
    return s.groupBy(doc).agg(F.max_by("s", F.struct("n", (-F.col("s")).alias("m"))).alias("size"))


def title(spans: DataFrame, body: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, title: the largest font group of the first page with 8 characters or more, above 1.35 times the body or 3 points over it, down the page, 300 characters at most."""
    s = spans.where("page = 1").join(body.withColumnRenamed("size", "body"), doc)
    s = s.where((F.col("size") > F.col("body") * 1.35) | (F.col("size") > F.col("body") + 3))
    g = s.groupBy(doc, F.round("size", 1).alias("s")).agg(F.sum(F.length("t")).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "t"))), lambda x: F.trim(x["t"])).alias("ts"))
    return g.where("n >= 8").groupBy(doc).agg(F.max_by("ts", "s").alias("ts")).select(doc, F.substring(F.array_join("ts", " "), 1, 300).alias("title"))


def valid_rect(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Four finite numbers, of positive size, inside the page."""
    ok = F.lit(True)
    for v in (x0, y0, x1, y1):
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(ok & (x1 > x0) & (y1 > y0) & (x0 >= 0) & (y0 >= 0) & (x1 <= width) & (y1 <= height), F.lit(False))


def figure_label(num: Column) -> Column:
    return F.regexp_like(num, F.lit(r"^(?:[A-Za-z]\.?)?\d{1,3}(?:\.\d{1,3})*[a-z]?$"))


def to_points(v: Column, dpi: float) -> Column:
    return v * 72.0 / dpi


def nearest_captions(captions: DataFrame, regions: DataFrame, page: list[str]) -> DataFrame:
    """regions with num: the nearest caption of their page, null for none.

    Distance: the gap below a region (6 points of overlap allowed), the gap above plus
    60, 0 inside; 180 at most, and the two overlap by more than -20 across.  Ties go to
    the caption that comes first (column ord, else num).
    """
    first = "ord" if "ord" in captions.columns else "num"
    c = captions.select(*page, "num", F.col(first).alias("_o"), *[F.col(k).alias("c" + k) for k in ("x0", "y0", "x1", "y1")])
    both = regions.join(c.hint("merge"), page, "left")
    overlap = F.least("x1", "cx1") - F.greatest("x0", "cx0")
    below, above = F.col("cy0") >= F.col("y1") - 6, F.col("cy1") <= F.col("y0") + 6
    gap = F.when(below, F.col("cy0") - F.col("y1")).when(above, F.col("y0") - F.col("cy1") + 60).otherwise(0)
    near = F.when((overlap > -20) & (gap <= 180), F.struct(gap.alias("d"), F.col("_o").alias("o")))
    return both.groupBy(*page, "x0", "y0", "x1", "y1").agg(F.min_by("num", near).alias("num"))


def assign_regions(captions: DataFrame, regions: DataFrame, page: list[str]) -> DataFrame:
    """page, num, x0..y1: each region goes to its nearest caption (``nearest_captions``), and
    a caption's regions are united.  A union that holds its caption 20 points or more
    below its top ends 2 points above it."""
    return united_regions(captions, nearest_captions(captions, regions, page), page)


def united_regions(captions: DataFrame, near: DataFrame, page: list[str]) -> DataFrame:
    c = captions.select(*page, "num", *[F.col(k).alias("c" + k) for k in ("x0", "y0", "x1", "y1")])
    u = near.where("num is not null").groupBy(*page, "num").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    meets = (F.least("x1", "cx1") > F.greatest("x0", "cx0")) & (F.least("y1", "cy1") > F.greatest("y0", "cy0")) & (F.col("cy0") > F.col("y0") + 20)
    cut = u.join(c.hint("merge"), [*page, "num"]).groupBy(*page, "num", "x0", "y0", "x1", "y1").agg(F.min(F.when(meets, F.col("cy0") - 2)).alias("_cut"))
    return cut.withColumn("y1", F.least("y1", "_cut")).drop("_cut")


def unite_rects(rects: DataFrame, page: list[str], gap: float = 12.0) -> DataFrame:
    """page, x0..y1: rectangles within ``gap`` of each other, united until none are.  One page at a time."""

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        boxes = rows[["x0", "y0", "x1", "y1"]].values.tolist()
        grown = True
        while grown:
            grown, out = False, []
            for b in boxes:
                for o in out:
                    if b[0] <= o[2] + gap and o[0] <= b[2] + gap and b[1] <= o[3] + gap and o[1] <= b[3] + gap:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
                        grown = True
                        break
                else:
                    out.append(list(b))
            boxes = out
        done = pd.DataFrame(boxes, columns=["x0", "y0", "x1", "y1"])
        for k in page:
            done[k] = rows[k].iloc[0]
        return done[[*page, "x0", "y0", "x1", "y1"]]

    slim = rects.select(*page, "x0", "y0", "x1", "y1")
    return slim.groupBy(*page).applyInPandas(unite, slim.schema)


def coverage(rects: DataFrame, words: DataFrame, page: list[str], id_: str) -> DataFrame:
    """page, id, share of each rectangle's area that words cover."""
    w = words.select(*page, *[F.col(k).alias("w" + k) for k in ("x0", "y0", "x1", "y1")])
    across = F.greatest(F.lit(0.0), F.least("x1", "wx1") - F.greatest("x0", "wx0"))
    down = F.greatest(F.lit(0.0), F.least("y1", "wy1") - F.greatest("y0", "wy0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    both = rects.join(w, page, "left")
    return both.groupBy(*page, id_).agg((F.sum(F.coalesce(across * down, F.lit(0.0))) / F.first(area)).alias("share"))


def attach_scripts(spans: DataFrame, page: list[str], id_: str, small: str = "small") -> DataFrame:
    """id, base, role: small spans with the nearest normal one within -4.5..3.5 points of its baseline and 20 points across."""
    s = spans.where(small).select(*page, F.col(id_).alias("id"), "x0", "x1", "by")
    b = spans.where(f"not {small}").select(*page, F.col(id_).alias("base"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("by").alias("bby"))
    dy = F.col("by") - F.col("bby")
    near = s.join(b, page).where(dy.between(-4.5, 3.5) & (F.col("x0") >= F.col("bx0") - 20) & (F.col("x1") <= F.col("bx1") + 20))
    best = near.withColumn("dy", dy).groupBy(*page, "id").agg(F.min_by(F.struct("base", "dy"), F.struct(F.abs("dy").alias("a"), "base")).alias("m"))
    return best.select(*page, "id", "m.base", F.when(F.col("m.dy") < 0, "sup").otherwise("sub").alias("role"))


# Fixed forms of headings.
NUMBERED = r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+([A-Za-zÀ-ɏ(].{1,140})$"
CN_NUMBERED = r"^(\d{1,2}(?:\.\d{1,2}){0,3})\s*[、.]?\s*([一-鿿].{0,60})$"
APPENDIX_PART = r"^([A-H](?:\.\d{1,2}){1,2})\.?\s+([A-Za-z(].{1,120})$"
NAMED = r"(?i)^(?:abstract|keywords?|key\s*words|highlights|introduction|conclusions?|concluding remarks|summary|acknowledg?e?ments?|references|bibliography|literature cited|nomenclature|list of symbols|notation|funding|data availability(?: statement)?|declaration of competing interest|conflicts? of interest(?: statement)?|credit authorship contribution statement|author contributions?|supplementary (?:material|data|information)|appendix(?:\s+[A-Z])?(?:[.:]\s*.*)?|methods?|methodology|results?|discussion|results and discussion|materials and methods|background|related work|引言|结论|摘要|关键词|参考文献|致谢|结语|讨论)(?![\p{L}\p{N}_])"
ALWAYS = ("abstract", "references", "keywords", "highlights")
MATHY = r"[=∕∑∫∂∇√≈≤≥×÷{}]|_\{|\^\{"


# Fixed forms of letter-spaced labels.
SPACED_LABEL = r"(?i)^(F\s?I\s?G\s?U\s?R\s?E|T\s?A\s?B\s?L\s?E)(?=\s|\d)"
SPACED_WORD = r"^((?:[A-Za-z]\s){2,}[A-Za-z])(?=\s|$)"


def despaced(x: Column) -> Column:
    """Letter-spaced words at the beginning, and the number after them, closed up."""

    def closed_up(t: Column, word: Column) -> Column:
        return F.when(word != "", F.concat(F.regexp_replace(word, r"\s", ""), t.substr(F.length(word) + 1, F.length(t)))).otherwise(t)

    def numbered(t: Column, closed: Column) -> Column:
        number = r"^([A-Za-z]+)\s*(\d(?:\s\d){1,2})(?=\s|$)"
        digits = F.regexp_replace(F.regexp_extract(t, number, 2), r"\s", "")
        return F.when(closed & F.regexp_like(t, F.lit(number)), F.concat(F.regexp_extract(t, number, 1), F.lit(" "), digits, F.regexp_replace(t, number, ""))).otherwise(t)

    def word_closed(t: Column, label: Column) -> Column:
        return let(F.regexp_extract(t, SPACED_WORD, 1), lambda word: let(closed_up(t, word), lambda t2: numbered(t2, (label != "") | (word != ""))))

    # only a lone letter, a label that is cut, or digits apart behind a label can be closed up
    maybe = lambda t: F.regexp_like(t, F.lit(r"^(?:[A-Za-z]\s|(?i:FI|TA)(?:[A-Za-z]{0,4}\s[A-Za-z]|[A-Za-z]+\s*\d\s\d))"))
    return let(F.trim(x), lambda t: F.when(maybe(t), let(F.regexp_extract(t, SPACED_LABEL, 1), lambda label: let(closed_up(t, label), lambda t1: word_closed(t1, label)))).otherwise(t))


def despaced_anywhere(x: Column) -> Column:
    """Letter-spaced words closed up wherever they stand."""
    words = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z0-9_])((?:[A-Za-z]\s){2,}[A-Za-z])(?![A-Za-z0-9_])")))
    return F.aggregate(words, x, lambda t, w: F.replace(t, w, F.regexp_replace(w, r"\s", "")))


def heading_level(x: Column, size: Column, bold: Column, body: Column, lines: Column | None = None) -> Column:
    """0 for no heading, else its level: numbered ones by depth below 1, named ones 2, appendix parts by depth, other large or bold ones 3."""
    t = despaced(x)
    big = size >= body + 1.4
    depth = lambda p: F.size(F.split(F.regexp_extract(t, p, 1), r"\."))
    is_ = lambda p: F.regexp_like(t, F.lit(p))
    rest = F.trim(F.regexp_extract(t, NUMBERED, 2))
    sentence = rest.endswith(".") & (F.size(F.split(rest, r"\s+")) > 10)
    plain = (F.length(t) <= 90) & (F.size(F.split(t, r"\s+")) <= 14) & ~is_(r"[.。:：,]$") & ~is_(r"(?<![A-Za-z])et al(?![A-Za-z])|@|\d{4}\)")
    out = (
        F.when((F.length(t) > 160) | is_(MATHY), 0)
        .when(is_(NUMBERED) & (big | bold | (size >= body + 0.5)), F.when((depth(NUMBERED) > 4) | sentence, 0).otherwise(F.least(depth(NUMBERED) + 1, F.lit(5))))
        .when(is_(CN_NUMBERED) & (big | bold), F.least(depth(CN_NUMBERED) + 1, F.lit(5)))
        .when(is_(APPENDIX_PART) & (big | bold), depth(APPENDIX_PART) + 1)
        .when(is_(NAMED) & (F.length(t) <= 80) & (big | bold | F.lower(t).isin(*ALWAYS)), 2)
        .when(is_(r"(?i)^Appendix(?![A-Za-z0-9_])") & (big | bold), 2)
        .when(((big & (size >= body + 2.5)) | (bold & (size >= body + 1.0))) & plain, 3)
        .otherwise(0)
    )
    return out if lines is None else F.when(lines > 3, 0).otherwise(out)


def junk_heading(x: Column) -> Column:
    """What looks like a heading but is a name or a journal's line."""
    is_ = lambda p: F.regexp_like(x, F.lit(p))
    return is_(r"(?i)(?<![A-Za-z])et al(?![A-Za-z])") | is_(r"^([A-Z]\.\s?)+[A-Z][a-z]+(,|$)") | (is_(r"(?<![A-Za-z])(Journal|Vol\.?|Volume|Issue|pp\.)(?![A-Za-z])") & (F.length(x) < 90))


def equation_number(x: Column, math_font: Column) -> Column:
    """The number at the end of an equation's text, else null: under 500 characters, a math font or two marks, two common words at most."""
    num = F.regexp_extract(x, r"[(（]\s*(\d{1,3}[a-z]?)\s*[)）]\s*$", 1)
    mathy = math_font | (F.regexp_count(x, F.lit(r"[=+−∑∫∂∇√≈≤≥×÷^_{}λμρσθαβγδεφψωΔΩπ]")) >= 2)
    words = F.regexp_count(x, F.lit(r"(?i)(?<![A-Za-z])(?:the|and|of|is|are|with|for|that|this|which)(?![A-Za-z])"))
    return F.when((num != "") & mathy & (F.length(x) < 500) & (words <= 2), num)


def label_like(x: Column) -> Column:
    """Captions, numbered headings and short named ones."""

    def is_label(t: Column) -> Column:
        is_ = lambda p: F.regexp_like(t, F.lit(p))
        return is_(r"(?i)^(?:Fig\.?|Figure|图|Table|表)\s*[A-Z]?\.?\d") | is_(NUMBERED) | is_(CN_NUMBERED) | is_(APPENDIX_PART) | (is_(NAMED) & (F.length(t) <= 40))

    return let(despaced(x), is_label)


def citation_brackets(x: Column) -> Column:
    """Superscripts after a word or mark as ``[12,13]``; those of single letters are left to formulas."""
    return F.regexp_replace(x, r"((?<![A-Za-z])(?:by|of|in|on|to|as|at|is|et|al)(?![A-Za-z])\.?|[A-Za-z]{3}|[.,;)\]])\^\{(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)\}", "$1[$2]")


def gap_above(captions: DataFrame, blocks: DataFrame, page: list[str], top: str = "page_y0") -> DataFrame:
    """page, num, x0..y1: the room between a caption and the paragraph or caption above it; 50 by 60 points at least.

    captions: num, x0..y1 and the page's top; blocks: x0..y1, text, caption (boolean).
    """
    c = captions.select(*page, "num", F.col(top).alias("_t"), *[F.col(k).alias("c" + k) for k in ("x0", "y0", "x1", "y1")])
    b = blocks.select(*page, *[F.col(k).alias("b" + k) for k in ("x0", "x1", "y1")], F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("_n"), F.col("caption").alias("_c"))
    width = F.col("cx1") - F.col("cx0")
    over = F.least(F.col("bx1"), F.col("cx1") + 4) - F.greatest(F.col("bx0"), F.col("cx0") - 4)
    stop = (F.col("by1") <= F.col("cy0") - 4) & (over > width * 0.4) & (((F.col("_n") > 80) & (F.col("bx1") - F.col("bx0") > width * 0.5)) | F.col("_c"))
    both = c.join(b.hint("merge"), page, "left").groupBy(*page, "num", "_t", "cx0", "cy0", "cx1", "cy1").agg(F.max(F.when(stop, F.col("by1") + 2)).alias("_y"))
    out = both.select(*page, "num", (F.col("cx0") - 4).alias("x0"), F.greatest(F.col("_t") + 36, F.coalesce("_y", F.col("_t") + 36)).alias("y0"), (F.col("cx1") + 4).alias("x1"), (F.col("cy0") - 2).alias("y1"))
    return out.where("y1 - y0 >= 50 and x1 - x0 >= 60")


def find_caption(figures: DataFrame, captions: DataFrame, doc: list[str], letters: int = 24) -> DataFrame:
    """figures (num, caption) with the caption line (cap_num, cap_y0) of their number, else the first that begins with the first letters of theirs."""
    norm = lambda x: F.substring(F.lower(F.regexp_replace(F.coalesce(F.col(x), F.lit("")), r"[^\p{L}\p{N}]", "")), 1, letters)
    c = captions.select(*doc, F.col("num").alias("_n"), F.col("y0").alias("_y"), norm("text").alias("_k"))
    by_num = c.groupBy(*doc, F.col("_n").alias("num")).agg(F.min("_y").alias("_y1"))
    by_text = c.where("_k <> ''").groupBy(*doc, "_k").agg(F.min(F.struct("_y", "_n")).alias("_2"))
    f = figures.withColumn("_k", norm("caption")).join(by_num, [*doc, "num"], "left").join(by_text, [*doc, "_k"], "left")
    own = F.col("_y1").isNotNull()
    return f.withColumns({"cap_num": F.when(own, F.col("num")).otherwise(F.col("_2._n")), "cap_y0": F.when(own, F.col("_y1")).otherwise(F.col("_2._y"))}).drop("_k", "_y1", "_2")


def page_body(blocks: DataFrame, page: list[str], regions: DataFrame, height: str = "height") -> DataFrame:
    """Blocks without those whose centre is in a region (figure or table), in the outer 4.5 % of the page, or small print in its lowest 18 %."""
    r = regions.select(*page, *[F.col(k).alias("r" + k) for k in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = x.between(F.col("rx0"), F.col("rx1")) & y.between(F.col("ry0"), F.col("ry1"))
    h = F.col(height)
    edge = (F.col("y1") < h * 0.045) | (F.col("y0") > h * 0.955)
    foot = (F.col("y0") > h * 0.82) & (F.col("size") < F.col("body") * 0.9)
    b = blocks.where(~edge & ~foot)
    return b.join(r, [b[k].eqNullSafe(r[k]) for k in page] + [inside], "left_anti") if page else b


#: Fixed value: characters of CJK text and its marks.
WIDE = r"[　-〿一-鿿＀-￯]"


def merge_paragraphs(elements: DataFrame, doc: str, ord_: str) -> DataFrame:
    """doc, ord, text (and kind, if given): a paragraph joins the one before if that has no
    end mark, also before a closing quote or bracket, and it goes on in lower case, with
    a bracket or mark, or from CJK to CJK.  List items don't, and elements of another
    kind than ``para`` stand alone and part their neighbours."""
    from foliant.operators.blocks import joined

    kind = F.col("kind") if "kind" in elements.columns else F.lit("para")
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    w = Window.partitionBy(doc).orderBy(ord_)
    e = elements.select(doc, F.col(ord_).alias("_o"), F.col("text").alias("_t"), kind.alias("_k"))
    w = Window.partitionBy(doc).orderBy("_o")
    before = F.lag("_t").over(w)
    ended = like(before, r"""[.!?:。！？；;]\s*["'”’)\]]?$""")
    goes = like(F.col("_t"), r"^[\p{Ll}(,;]") | (like(before, WIDE + r"\z") & like(F.col("_t"), "^" + WIDE))
    joins = (F.col("_k") == "para") & (F.lag("_k").over(w) == "para") & ~F.col("_t").startswith("- ") & ~ended & goes
    g = e.withColumn("_g", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    g = g.withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = g.groupBy(doc, "_g").agg(F.min("_o").alias(ord_), F.first("_k").alias("kind"), F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_ls"))
    out = out.select(doc, ord_, "kind", joined(F.transform("_ls", lambda x: x["_t"])).alias("text"))
    return out if "kind" in elements.columns else out.drop("kind")


def degenerate(lines: Column, words: Column) -> Column:
    """Text that came as one line per word."""
    return (lines > 40) & (lines >= 0.6 * words)


def regroup_lines(spans: DataFrame, page: list[str], look_back: int = 8, blocks_back: int = 4) -> DataFrame:
    """page, block, line, text, x0, y0, x1, y1, by: spans that came as a word each put into
    lines and blocks.  spans: t, x0, y0, x1, y1, by, size; one page at a time.

    Down the page in steps of two points and across, a span joins the last of eight
    lines whose baseline is within 2 points or 35 % of its size, and that ends from 1.5
    sizes behind to 2.5 before its begin; a space stands where more than 12 % of the
    size is free.  A line joins the last of four blocks that ends from half a line's
    height below to nine tenths above it, and shares 30 % of the narrower's width.
    """
    import numpy as np

    rect = ["x0", "y0", "x1", "y1"]

    def grow(box: list, r: list) -> None:
        box[:] = [min(box[0], r[0]), min(box[1], r[1]), max(box[2], r[2]), max(box[3], r[3])]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["t"].str.strip() != ""]
        rows = rows.assign(_y=np.round(rows["by"] / 2)).sort_values(["_y", "x0"], kind="stable")
        lines: list[dict] = []
        for t, by, size, *box in rows[["t", "by", "size", *rect]].itertuples(index=False):
            h = size if size > 0.5 else 8.0
            for ln in lines[: -look_back - 1 : -1]:
                if abs(ln["by"] - by) <= max(2.0, 0.35 * h) and -1.5 * h <= box[0] - ln["end"] <= 2.5 * h:
                    free = box[0] - ln["last"] > 0.12 * h and not ln["text"].endswith(" ")
                    ln["text"] += (" " if free else "") + t
                    ln["last"], ln["end"] = box[2], max(ln["end"], box[2])
                    grow(ln["box"], box)
                    break
            else:
                lines.append({"by": by, "end": box[2], "last": box[2], "text": t, "box": box})
        lines.sort(key=lambda ln: (ln["box"][1], ln["box"][0]))
        blocks: list[dict] = []
        for k, ln in enumerate(lines):
            x0, y0, x1, y1 = ln["box"]
            h = max(y1 - y0, 1.0)
            for b in blocks[: -blocks_back - 1 : -1]:
                gap, shared = y0 - b["bottom"], min(x1, b["box"][2]) - max(x0, b["box"][0])
                if -0.5 * h <= gap <= 0.9 * h and shared > 0.3 * min(x1 - x0, b["box"][2] - b["box"][0]):
                    grow(b["box"], ln["box"])
                    break
            else:
                b = {"box": list(ln["box"]), "no": len(blocks)}
                blocks.append(b)
            b["bottom"] = y1
            ln["block"], ln["line"] = b["no"], k
        out = pd.DataFrame([(ln["block"], ln["line"], ln["text"], *ln["box"], ln["by"]) for ln in lines], columns=["block", "line", "text", *rect, "by"])
        for k in page:
            out[k] = rows[k].iloc[0] if len(rows) else None
        return out[[*page, "block", "line", "text", *rect, "by"]]

    slim = spans.select(*page, "t", *[F.col(c).cast("double").alias(c) for c in (*rect, "by", "size")])
    fields = ", ".join(f"{k} {spans.schema[k].dataType.simpleString()}" for k in page)
    return slim.groupBy(*page).applyInPandas(fold, f"{fields}, block int, line int, text string, x0 double, y0 double, x1 double, y1 double, by double")
