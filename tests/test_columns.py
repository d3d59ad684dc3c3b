"""Column layout and blocks against plain folds over lists, on made-up pages."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from foliant.operators import blocks, columns

SPANS = "doc long, page int, width double, x0 double, x1 double, by double, t string, size double, bold boolean, italic boolean, font string"


def spans_of(spark, rows):
    return spark.createDataFrame(rows, SPANS)


def span(by, x0, x1, t, size=10.0, bold=False, italic=False, font="Serif", doc=1, page=1, width=600.0):
    return (doc, page, width, float(x0), float(x1), float(by), t, size, bold, italic, font)


def two_columns(n=20, top=100, word="w", lefts=(50, 290), rights=(310, 550)):
    out = []
    for r in range(n):
        out.append(span(top + 12 * r, *lefts, f"{word}l{r}"))
        out.append(span(top + 12 * r, *rights, f"{word}r{r}"))
    return out


def text_of(spark, rows):
    return [(r.kind, r.mark, r.text) for r in columns.paragraphs(spans_of(spark, rows)).orderBy("doc", "page", "pos").collect()]


def test_one_two_and_mixed_columns(spark):
    full = [span(100 + 12 * r, 50, 550, f"f{r}") for r in range(12)]
    assert text_of(spark, full) == [("F", "", " ".join(f"f{r}" for r in range(12)))]
    left, right = " ".join(f"wl{r}" for r in range(20)), " ".join(f"wr{r}" for r in range(20))
    assert text_of(spark, two_columns()) == [("L", "", left), ("R", "", right)]
    # a title over two columns: one line across is not enough to close the gutter
    assert text_of(spark, [span(70, 50, 550, "A title", 16.0), *two_columns()]) == [("F", "[BIG] ", "A title"), ("L", "", left), ("R", "", right)]
    # columns below whole lines: the first seven rows still see two lines across
    got = text_of(spark, [*[span(16 + 12 * r, 50, 550, f"f{r}") for r in range(7)], *two_columns()])
    whole = " ".join([*[f"f{r}" for r in range(7)], *[f"wl{r} wr{r}" for r in range(7)]])
    assert got == [("F", "", whole), ("L", "", " ".join(f"wl{r}" for r in range(7, 20))), ("R", "", " ".join(f"wr{r}" for r in range(7, 20)))]


def test_one_side_only_and_narrow_room(spark):
    rows = [span(100 + 12 * r, 50, 290, f"l{r}") for r in range(6)]
    assert [x[0] for x in text_of(spark, rows)] == ["L"]  # the other column is a picture
    near = [x for r in range(6) for x in (span(100 + 12 * r, 50, 298, "a"), span(100 + 12 * r, 302, 550, "b"))]
    assert [x[0] for x in text_of(spark, near)] == ["F"]


RULES = [
    ([(0, 50, 550, "one"), (18, 50, 550, "two")], ["one", "two"]),  # room of more than 1.75 sizes
    ([(0, 50, 550, "one"), (17, 50, 550, "two")], ["one two"]),
    ([(0, 50, 480, "short"), (12, 50, 550, "two"), (24, 50, 550, "three")], ["short", "two three"]),  # ends short
    ([(0, 50, 550, "one"), (12, 56, 550, "indented")], ["one", "indented"]),
    ([(0, 50, 550, "Fig. 3. Caption"), (12, 50, 550, "more")], ["[CAP] Fig. 3. Caption", "more"]),
    ([(0, 50, 550, "Figure 3 shows more"), (12, 50, 550, "more")], ["Figure 3 shows more more"]),
    ([(0, 50, 550, "Table 2. Title"), (12, 50, 550, "Table 3. Title")], ["[TAB] Table 2. Title", "[TAB] Table 3. Title"]),
    ([(0, 50, 550, "the exam-"), (12, 50, 550, "ple of this")], ["the example of this"]),
    ([(0, 50, 550, "a non-"), (12, 50, 550, "linear one")], ["a non-linear one"]),
    ([(0, 50, 550, "a non-"), (12, 50, 550, "linear, Nonlinear one")], ["a nonlinear, Nonlinear one"]),  # the word stands elsewhere
    ([(0, 50, 550, "of Smith-"), (12, 50, 550, "Jones here")], ["of Smith- Jones here"]),
    ([(0, 50, 550, "中文的"), (12, 50, 550, "句子")], ["中文的句子"]),
    ([(0, 50, 550, "ﬁne ﬂow"), (12, 50, 550, "x")], ["fine flow x"]),
]


def test_paragraph_rules(spark):
    rows = [span(100 + y, a, b, t, doc=d) for d, (lines, _) in enumerate(RULES) for y, a, b, t in lines]
    got = {}
    for r in columns.paragraphs(spans_of(spark, rows)).orderBy("doc", "page", "pos").collect():
        got.setdefault(r.doc, []).append(r.mark + r.text)
    assert got == {d: want for d, (_, want) in enumerate(RULES)}


def test_marks(spark):
    rows = [
        span(100, 50, 550, "Heading in bold", bold=True), span(112, 50, 550, "Slanted", italic=True), span(124, 50, 550, "E = mc (3)", font="CMMI10"),
        span(136, 50, 550, "smaller print here", 8.5), span(148, 50, 550, "larger print here", 11.6), span(160, 50, 550, "nearly so", 11.4), span(172, 50, 550, "a whole sentence with many words", font="STIXGeneral"),
        *[span(300 + 12 * r, 50, 550, f"body{r}") for r in range(9)],
    ]
    got = text_of(spark, rows)
    assert [m for _, m, _ in got][:5] == ["[BOLD] ", "[ITAL] ", "[MATH] ", "[small] ", "[BIG] "]
    assert got[5][1] == "" and got[5][2].startswith("nearly so a whole sentence")


def test_scripts_join_the_nearest_line(spark):
    rows = [span(100 + 12 * r, 50, 290, f"line{r}") for r in range(4)]
    rows += [span(120, 290.2, 294, "7", 6.0), span(114, 290.2, 294, "i", 6.0), span(127, 400, 404, "lost", 6.0)]
    t = " ".join(x[2] for x in text_of(spark, rows))
    assert "line2^{7}" in t and "line1_{i}" in t and "^{lost}" not in t and "lost" in t


def test_text_and_hints(spark):
    rows = [span(100, 50, 550, "Fig. 2. A"), span(130, 50, 550, "Table 4. B"), span(160, 50, 550, "E = mc (3a)", font="CMMI10"), *[span(200 + 12 * r, 50, 550, f"b{r}") for r in range(5)]]
    rows += [span(100, 50, 550, "next", page=2), span(100, 50, 550, "other", doc=2)]
    p = columns.paragraphs(spans_of(spark, rows))
    texts = {r.doc: r.text for r in columns.column_text(p).collect()}
    assert texts[2] == "<!-- ===== p1 ===== -->\n\n\nother\n"
    assert texts[1].startswith("<!-- ===== p1 ===== -->\n\n\n[CAP] Fig. 2. A\n\n[TAB] Table 4. B\n\n[MATH] E = mc (3a)\n\nb0 b1") and texts[1].endswith("b4\n\n\n<!-- ===== p2 ===== -->\n\n\nnext\n")
    hints = {r.doc: (r.figures, r.tables, r.equations) for r in columns.column_hints(p).collect()}
    assert hints == {1: ([2], [4], [3]), 2: ([], [], [])}
    items = columns.page_items(spans_of(spark, two_columns(4) + [span(100 + 12 * r, 50, 550, "x", doc=2) for r in range(20)]))
    assert {r.doc: r.pages for r in columns.two_column_pages(items).collect()} == {1: 0, 2: 0}
    assert columns.paragraphs(spans_of(spark, [span(1, 1, 2, " ")])).collect() == []


def plain_gutter(lines, width):
    """lines: lists of (x0, x1), down the page -> gutter of each."""
    lo, hi, out = int(width * 0.2 / 2), int(width * 0.8 / 2), []
    for i in range(len(lines)):
        near = lines[max(0, i - 8) : i + 9]
        ink = "".join("." if sum(int(a / 2) <= b <= int(z / 2) for ln in near for a, z in ln) <= 1 else "#" for b in range(lo, hi))
        runs = [((m.start() + lo) * 2.0, (m.end() + lo) * 2.0) for m in re.finditer(r"\.{4,}", ink)]
        left = lambda x: sum(min(z for _, z in ln) <= x for ln in near)
        right = lambda x: sum(max(a for a, _ in ln) >= x for ln in near)
        both = [(abs((a + z) / 2 - width / 2), a - z, (a + z) / 2) for a, z in runs if left(a + 1) >= 3 and right(z - 1) >= 3]
        if both:
            out.append(min(both)[2])
        elif runs:
            a, z = max(runs, key=lambda r: r[1] - r[0])
            x = (a + z) / 2
            out.append(x if sum(min(q for _, q in ln) < x for ln in near) >= 3 or sum(max(p for p, _ in ln) > x for ln in near) >= 3 else None)
        else:
            out.append(None)
    return out


def test_gutters_equal_a_plain_histogram(spark):
    rng, rows, pages = random.Random(8), [], {}
    for page in range(12):
        width, y, lines = rng.choice([420.0, 600.0, 612.5]), 60.0, []
        gap = width / 2 + rng.uniform(-30, 30)
        for _ in range(rng.randrange(1, 45)):
            kind = rng.random()
            if kind < 0.25 * (page % 3):
                ln = [(40.0, width - 40)]
            elif kind < 0.9:
                ln = [(40.0 + rng.choice([0, 9]), gap - rng.uniform(3, 60)), (gap + rng.uniform(3, 12), width - 40 - rng.choice([0, 90]))]
            else:
                ln = [rng.choice([(40.0, gap - 6), (gap + 6, width - 40), (gap - 20, gap + 20)])]
            lines.append(ln)
            rows += [span(y, a, z, "x", page=page, width=width) for a, z in ln]
            y += rng.choice([9.0, 12.0, 24.0])
        pages[page] = plain_gutter(lines, width)
    s = columns.cleaned(spans_of(spark, rows)).withColumn("body", F.lit(10.0))
    got = {}
    for r in columns.gutters(columns.text_lines(columns.scripted(columns.baselines(s)))).orderBy("page", "line").collect():
        got.setdefault(r.page, []).append(r.gutter)
    assert got == pages


def test_baselines_along_a_chain(spark):
    ys = [100, 101, 102.5, 103, 104.7, 120]
    got = columns.baselines(columns.cleaned(spans_of(spark, [span(y, i, i + 1, "x") for i, y in enumerate(ys)]))).orderBy("by").collect()
    assert [r.line for r in got] == [100, 100, 102.5, 102.5, 104.7, 120]


def test_pages_in_batches_equal_windows(spark):
    """Cut lines by Arrow batches of whole pages, of any size, are those of the windows, and take far fewer of them."""
    rng, rows = random.Random(5), []
    for page in range(20):
        width = rng.choice([420.0, 600.0])
        for r in range(rng.choice([0, 1, 3, 30, 60])):
            y = 60 + 11.0 * r + rng.choice([0, 0, 0.7, 1.5, 3])
            for a, z in rng.choice([[(40, width - 40)], [(40, width / 2 - 9), (width / 2 + 9, width - 40)], [(40, width / 2 - 9), (width / 2 + 9, width - 80)], [(width / 2 - 2, width / 2 + 2)], [(40, 90), (40, 90), (95, 140)]]):
                rows.append(span(y, a, z, rng.choice(["word", "a  b", "ﬁne ", "图 1", "中文", "n-"]), rng.choice([10.0, 10.0, 16.0]), page=page // 2 if page % 5 else None, doc=page % 2, width=width))
                if rng.random() < 0.3:
                    rows.append(span(y + rng.choice([-4, 3, -0.5, 9]), z, z + 5, "2", 6.0, page=page // 2 if page % 5 else None, doc=page % 2, width=width))
    # a page whose spans all have one width
    width = {}
    rows = [(*r[:2], width.setdefault(r[:2], r[2]), *r[3:]) for r in rows]
    spans = spans_of(spark, rows)
    s = columns.cleaned(spans)
    cols = ["doc", "page", "body", "by", "kind", "x0", "x1", "text", "mark"]
    want = sorted(map(repr, columns.cut_lines(columns.gutters(columns.text_lines(columns.scripted(columns.baselines(s.join(columns.span_body(s), "doc")))))).select(cols).collect()))
    assert {"F", "L", "R"} <= {r.split("kind='")[1][0] for r in want}
    for size in (7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            items = columns.page_items(spans)
            assert sorted(map(repr, items.select(cols).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in items._jdf.queryExecution().executedPlan().toString()


# -- blocks

BLOCK = "doc long, page int, block int, line int, seq int, t string, size double, y double, font string, bold boolean, raised boolean, x0 double, y0 double, x1 double, y1 double"


def block_line(line, *parts, block=1, y=None, x=(50, 300), font="Serif"):
    """parts: (text, size, dy, bold, raised)."""
    y = 100 + 12 * line if y is None else y
    out = []
    for k, p in enumerate(parts):
        t, size, dy, bold, raised = (*p, *(10.0, 0.0, False, False)[len(p) - 1 :])
        out.append((1, 1, block, line, k, t, size, y + dy, font, bold, raised, float(x[0]), y - 9.0, float(x[1]), float(y)))
    return out


def test_marked_lines(spark):
    rows = block_line(0, ("x",), ("2", 6.0, -4.0), (" and y",), ("i", 6.0, 2.0), (" z",), ("5", 6.0, 0.5))
    rows += block_line(1, ("cite",), (" 12 ", 10.0, 0.0, False, True), (".",)) + block_line(2, ("all bold", 10.0, 0.0, True), (" no",)) + block_line(3, ("   ",)) + block_line(4, ("no size", 0.0), (" a", 0.2))
    got = {r.line: r for r in blocks.marked_lines(spark.createDataFrame(rows, BLOCK), body=9.0).collect()}
    assert got[0].text == "x^{2} and y_{i} z5" and got[0].size == 10.0 and not got[0].bold
    assert got[1].text == "cite^{12}." and got[2].bold and 3 not in got and got[4].size == 9.0


def plain_segments(rows, label, bare):
    """rows: (text, size, bold, y0, y1) -> lists of texts."""
    segs = []
    for k, cur in enumerate(rows):
        new = not segs
        if segs:
            prev, own = rows[k - 1], len(segs[-1])
            new = ((cur[2] != prev[2] or abs(cur[1] - prev[1]) >= 1) and (own <= 2 or len(cur[0]) <= 120)) or (label(cur[0]) and prev[0][-1] in ".!?:;)") or (own == 1 and label(prev[0]) and len(prev[0]) <= 60 and not bare(prev[0]) and not label(cur[0])) or cur[3] - prev[4] > max(cur[1], prev[1]) * 0.9
        if new:
            segs.append([])
        segs[-1].append(cur[0])
    out = []
    for s in segs:
        if out and bare(" ".join(out[-1])):
            out[-1] += s
        else:
            out.append(s)
    return out


def test_segments_equal_a_plain_fold(spark):
    rng, rows, want = random.Random(2), [], {}
    texts = ["Fig. 2.", "Fig. 2. What it shows", "Table 1", "plain words go on", "they end here.", "1.2 Methods", "long " * 30, "Abstract", "then (so)"]
    label = lambda t: bool(re.match(r"(Fig\.|Table) |1\.2 M|Abstract$", t))
    bare = lambda t: bool(re.match(r"(Fig\.|Table) \d\.?$", t))
    for b in range(60):
        own, y = [], 100.0
        for k in range(rng.randrange(1, 9)):
            t, size, bold = rng.choice(texts).strip(), rng.choice([10.0, 10.0, 10.6, 12.0]), rng.random() < 0.2
            rows += block_line(k, (t, size, 0.0, bold), block=b, y=y)
            own.append((t, size, bold, y - 9, y))
            y += rng.choice([11.0, 12.0, 24.0])
        want[b] = [" ".join(s) for s in plain_segments(own, label, bare)]
    got = {}
    segs = blocks.segments(blocks.marked_lines(spark.createDataFrame(rows, BLOCK)))
    for r in segs.orderBy("block", "seg").collect():
        got.setdefault(r.block, []).append(r.text)
    assert got == want


def test_each_segment_rule(spark):
    cases = {
        1: ([("Heading", 12.0, 0.0, True), ("body goes on",), ("and on",)], ["Heading", "body goes on and on"]),
        2: ([("one",), ("two",), ("three",), ("L" * 130, 12.0)], ["one two three " + "L" * 130]),  # a long line after three
        3: ([("it ends here.",), ("Fig. 4. Next",)], ["it ends here.", "Fig. 4. Next"]),
        4: ([("2.1 Part",), ("text of it",)], ["2.1 Part", "text of it"]),
        5: ([("Table 3",), ("Its title",)], ["Table 3 Its title"]),
        6: ([("hyphen-",), ("ated 中",), ("文",)], ["hyphenated 中文"]),
    }
    rows = [x for b, (lines, _) in cases.items() for k, p in enumerate(lines) for x in block_line(k, p, block=b)]
    got = {}
    for r in blocks.segments(blocks.marked_lines(spark.createDataFrame(rows, BLOCK))).orderBy("block", "seg").collect():
        got.setdefault(r.block, []).append(r.text)
    assert got == {b: want for b, (_, want) in cases.items()}


def test_kept_segments(spark):
    s = "doc long, page int, block int, seg int, text string, lines int, size double, bold boolean, font string, x0 double, y0 double, x1 double, y1 double"
    make = lambda b, t, y0, y1, lines=1, size=10.0, x0=50.0, x1=150.0: (1, 1, b, 0, t, lines, size, False, "f", x0, y0, x1, y1)
    rows = [make(1, "head", 10.0, 30.0), make(2, "in figure", 100.0, 110.0), make(3, "Fig. 1. Own", 100.0, 110.0), make(4, "half in", 100.0, 110.0, x0=250.0, x1=350.0), make(5, "note", 850.0, 860.0, 2, 8.0), make(6, "body", 850.0, 860.0, 2), make(7, "foot", 970.0, 980.0), make(8, "| cell", 850.0, 860.0, 2, 8.0), make(9, "long " * 40, 10.0, 30.0)]
    regions = spark.createDataFrame([(1, 1, 40.0, 90.0, 300.0, 200.0)], "doc long, page int, x0 double, y0 double, x1 double, y1 double")
    got = blocks.kept_segments(spark.createDataFrame(rows, s), regions, spark.createDataFrame([(1, 1, 1000.0)], "doc long, page int, height double"), 10.0)
    assert sorted(r.block for r in got.collect()) == [3, 4, 6, 8, 9]


def test_order_of_blocks(spark):
    s = "doc long, page int, block int, seg int, text string, x0 double, y0 double, x1 double, y1 double"
    make = lambda page, b, x0, y0, x1, n=50: (1, page, b, 0, "x" * n, float(x0), float(y0), float(x1), y0 + 10.0)
    rows = [make(1, 1, 50, 100, 280), make(1, 2, 320, 100, 550), make(1, 3, 50, 200, 550, 20), make(1, 4, 320, 210, 550), make(1, 5, 50, 300, 280), make(1, 6, 50, 50, 550, 20)]
    # mostly wide text: by rows of four points, then across
    rows += [make(2, 1, 300, 100, 400, 10), make(2, 2, 50, 101, 200, 10), make(2, 3, 50, 50, 550, 90)]
    # a right column that begins left of the middle
    rows += [make(3, 1, 50, 100, 250), make(3, 2, 262, 90, 550), make(3, 3, 50, 300, 250)]
    got = {}
    for r in blocks.ordered_blocks(spark.createDataFrame(rows, s)).orderBy("page", "pos").collect():
        got.setdefault(r.page, []).append(r.block)
    assert got == {1: [6, 1, 2, 3, 5, 4], 2: [3, 2, 1], 3: [1, 3, 2]}
