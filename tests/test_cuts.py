"""Cutting figures out of pages: every tier, carry over two pages, no region twice."""

from __future__ import annotations

from foliant.operators import cuts

FIGURES = "doc long, num string, page int, caption string"
CAPTIONS = "doc long, page int, num string, text string, x0 double, y0 double, x1 double, y1 double"
REGIONS = "doc long, page int, x0 double, y0 double, x1 double, y1 double"
BLOCKS = "doc long, page int, text string, caption boolean, x0 double, y0 double, x1 double, y1 double"
PAGES = "doc long, page int, width double, height double"


def cut(spark, figures, captions, regions, blocks=(), done=None, size=(400.0, 500.0)):
    df = spark.createDataFrame
    pages = [(1, p, *size) for p in range(1, 8)]
    out = cuts.cut_figures(df([(1, *f) for f in figures], FIGURES), df([(1, *c) for c in captions], CAPTIONS), df([(1, *r) for r in regions], REGIONS), df([(1, *b) for b in blocks], BLOCKS), df(pages, PAGES), None if done is None else df([(1, n) for n in done], "doc long, num string"))
    rows = out.collect()
    assert sorted(r.num for r in rows) == sorted(f[0] for f in figures)
    return {r.num: r for r in rows}


def caption(page, num, y=320.0, text=None):
    return (page, num, text or f"Fig. {num}. Caption of {num}", 50.0, y, 330.0, y + 12)


def region(page, y0=60.0, y1=280.0, x0=50.0, x1=330.0):
    return (page, x0, y0, x1, y1)


def test_own_regions_pages_around_and_missing(spark):
    figures = [("1", 1, ""), ("2", 3, ""), ("3", 6, ""), ("4", 1, ""), ("5", 1, "Fig. 9. By its letters")]
    got = cut(spark, figures, [caption(1, "1"), caption(4, "2"), caption(5, "3"), caption(1, "9", 480.0, "Fig 9 By, its letters")], [region(1), region(4), region(5), region(1, 400.0, 470.0)])
    assert {n: (r.page, r.status) for n, r in got.items()} == {"1": (1, "ok"), "2": (4, "ok"), "3": (5, "ok"), "4": (None, "missing"), "5": (1, "ok")}
    assert (got["1"].x0, got["1"].y0, got["1"].x1, got["1"].y1, got["1"].clipped) == (46.0, 56.0, 334.0, 284.0, False)
    assert got["5"].y0 == 396.0


def test_carry_in_order_and_once(spark):
    # two regions without captions on page 1, three captions without regions on page 2
    got = cut(spark, [("1", 2, ""), ("2", 2, ""), ("3", 2, "")], [caption(2, "1", 20.0), caption(2, "2", 40.0), caption(2, "3", 60.0)], [region(1, 60.0, 200.0), region(1, 210.0, 400.0), region(1, 410.0, 450.0), region(1, 60.0, 300.0, 340.0, 390.0)])
    assert [(got[n].status, got[n].sourcePage) for n in "123"] == [("carry", 1), ("carry", 1), ("missing", None)]
    assert (got["1"].y0, got["2"].y0) == (56.0, 206.0)
    # a page with a caption of its own, even of another figure, carries nothing
    got = cut(spark, [("1", 2, "")], [caption(1, "8", 490.0), caption(2, "1", 20.0)], [region(1, 60.0, 200.0)])
    assert got["1"].status == "missing"
    # nor does it reach two pages on
    assert cut(spark, [("1", 3, "")], [caption(3, "1", 20.0)], [region(1)])["1"].status == "missing"


def test_room_above_and_clipping(spark):
    text = "words of a paragraph " * 6
    got = cut(spark, [("1", 1, ""), ("2", 2, "")], [caption(1, "1"), caption(2, "2")], [region(2, 2.0, 300.0, 1.0, 399.0)], [(1, text, False, 50.0, 60.0, 330.0, 100.0), (1, text, False, 50.0, 420.0, 330.0, 450.0)])
    assert got["1"].status == "gap-fallback" and (got["1"].y0, got["1"].y1) == (98.0, 322.0)
    assert got["2"].status == "ok" and got["2"].clipped and (got["2"].x0, got["2"].y0, got["2"].x1) == (0.0, 0.0, 400.0)


def test_kept_and_invalid(spark):
    got = cut(spark, [("1", 1, ""), ("2", 1, "")], [caption(1, "1"), caption(1, "2", 480.0)], [region(1), (1, 50.0, 400.0, 900.0, 470.0)], done=["1"])
    # the kept figure's caption still takes its region; the other's lies outside the page
    assert got["1"].status == "kept" and got["2"].status == "missing"
    assert cut(spark, [("1", 1, "")], [], [], done=[])["1"].status == "missing"
