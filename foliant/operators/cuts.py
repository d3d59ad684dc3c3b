"""Which part of which page shows each figure: captions, regions, what is left of the
page before, and the room above a caption, in this order.

Every step is a join on (doc, page) or a rank within a page, so figures of all
documents are cut in one job; no region is used twice.  Both sides of each join grow
with the documents and are merged: Spark takes exploded rows for small, and would
build their hash tables on the driver.  Rectangles are x0, y0, x1, y1
in points; ties among captions and regions go down the page, then across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import layout

PAGE = ["doc", "page"]
RECT = ("x0", "y0", "x1", "y1")
#: Least width and height of a region that is carried to the next page; margin of a cut.
CARRIED, MARGIN = (150.0, 100.0), 4.0


def located(figures: DataFrame, captions: DataFrame, letters: int = 24) -> DataFrame:
    """figures (doc, num, page, caption) with found, cap_num and their caption's rectangle:
    on the page that lists them, else the next, else the one before; on a page the
    caption of their number, else one that begins with the same letters; the upper of
    several.  found is null where there is none."""
    norm = lambda c: F.substring(F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\p{L}\p{N}]", "")), 1, letters)
    tiers = F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), (F.col("page") + k).alias("at")) for i, k in enumerate((0, 1, -1))]))
    f = figures.select("doc", "num", F.col("page").alias("listed"), norm("caption").alias("_k"))
    asked = figures.select("doc", "num", norm("caption").alias("_k"), tiers.alias("t")).select("doc", "num", "_k", "t.*")
    c = captions.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.col("num").alias("cap_num"), norm("text").alias("_t"), *RECT)
    same = F.col("num") == F.col("cap_num")
    hits = asked.join(c.hint("merge"), (F.col("doc") == F.col("_d")) & (F.col("at") == F.col("_p"))).where(same | ((F.col("_k") != "") & (F.col("_k") == F.col("_t"))))
    rank = F.struct("tier", (~same).alias("other"), "y0", "x0")
    best = hits.groupBy("doc", "num").agg(F.min_by(F.struct(F.col("at").alias("found"), "cap_num", *RECT), rank).alias("c"))
    return f.drop("_k").join(best.hint("merge"), ["doc", "num"], "left").select("doc", "num", "listed", "c.*")


def cut_figures(figures: DataFrame, captions: DataFrame, regions: DataFrame, blocks: DataFrame, pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """doc, num, listed, page, status, sourcePage, x0..y1, clipped: one row for each figure.

    figures: doc, num, page, caption; captions: doc, page, num, text, x0..y1 (all of a
    page, of other figures as well); regions: doc, page, x0..y1; blocks: doc, page, text,
    caption, x0..y1; pages: doc, page, width, height; done: doc, num of figures to keep.

    ``ok``: the regions nearest to the caption, united.  ``carry``: a page without any
    caption leaves its large regions without a caption to the figures of the next page
    that have none, in order.  ``gap-fallback``: the room above the caption.  A cut is
    widened by 4 points and clipped to its page.  ``missing``: no caption, or no valid
    cut.  ``kept``: done before.
    """
    f = located(figures, captions)
    kept = None
    if done is not None:
        had = done.select("doc", "num").distinct().hint("merge")
        kept, f = f.join(had, ["doc", "num"], "left_semi"), f.join(had, ["doc", "num"], "left_anti")
    hit = f.where("found is not null").withColumnRenamed("found", "page")
    near = layout.nearest_captions(captions, regions, PAGE)
    own = layout.united_regions(captions, near, PAGE).select(*PAGE, F.col("num").alias("cap_num"), F.struct(*RECT).alias("own"))
    hit = hit.join(own.hint("merge"), [*PAGE, "cap_num"], "left")
    # what is left of the page before goes to those without a region, first to first
    down = Window.partitionBy(*PAGE).orderBy("y0", "x0", "num")
    hit = hit.withColumn("turn", F.sum(F.when(F.col("own").isNull(), 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    wide = (F.col("x1") - F.col("x0") >= CARRIED[0]) & (F.col("y1") - F.col("y0") >= CARRIED[1])
    left = near.where(F.col("num").isNull() & wide).join(captions.select(*PAGE).distinct().hint("merge"), PAGE, "left_anti")
    left = left.select("doc", (F.col("page") + 1).alias("page"), F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0")).cast("long").alias("turn"), F.struct(*RECT).alias("carried"))
    hit = hit.join(left.hint("merge"), [*PAGE, "turn"], "left").withColumn("carried", F.when(F.col("own").isNull(), F.col("carried")))
    heads = hit.where("own is null and carried is null").select(*PAGE, "num", *RECT, F.lit(0.0).alias("page_y0"))
    room = layout.gap_above(heads, blocks, PAGE).select(*PAGE, "num", F.struct(*RECT).alias("room"))
    hit = hit.join(room.hint("merge"), [*PAGE, "num"], "left")
    source = F.when(F.col("own").isNotNull() | F.col("carried").isNull(), F.col("page")).otherwise(F.col("page") - 1)
    hit = hit.select("doc", "num", "listed", F.col("page").alias("at"), source.alias("page"), F.coalesce("own", "carried", "room").alias("r"), F.when(F.col("own").isNotNull(), "ok").when(F.col("carried").isNotNull(), "carry").otherwise("gap-fallback").alias("status"))
    hit = hit.join(pages.select(*PAGE, "width", "height").hint("merge"), PAGE, "left")
    valid = F.coalesce(layout.valid_rect(F.col("r.x0"), F.col("r.y0"), F.col("r.x1"), F.col("r.y1"), F.col("width"), F.col("height")), F.lit(False))
    low = lambda c: F.when(valid, F.greatest(F.col(f"r.{c}") - MARGIN, F.lit(0.0))).alias(c)
    high = lambda c, most: F.when(valid, F.least(F.col(f"r.{c}") + MARGIN, F.col(most))).alias(c)
    clipped = (F.col("r.x0") < MARGIN) | (F.col("r.y0") < MARGIN) | (F.col("r.x1") + MARGIN > F.col("width")) | (F.col("r.y1") + MARGIN > F.col("height"))
    out = hit.select("doc", "num", "listed", F.col("at").alias("page"), F.when(valid, F.col("status")).otherwise("missing").alias("status"), F.when(valid, F.col("page")).alias("sourcePage"), low("x0"), low("y0"), high("x1", "width"), high("y1", "height"), F.when(valid, clipped).alias("clipped"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("sourcePage", "long"), *[(k, "double") for k in RECT], ("clipped", "boolean"))]
    bare = lambda rows, status: rows.select("doc", "num", "listed", F.col("found").alias("page"), F.lit(status).alias("status"), *nothing)
    out = out.unionByName(bare(f.where("found is null"), "missing"))
    return out if kept is None else out.unionByName(bare(kept, "kept"))
