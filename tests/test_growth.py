"""Plans and figures that must not grow faster than the tables."""

from __future__ import annotations

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from foliant.operators import blocks, cuts, layout
from foliant.operators.citations import parse_references
from foliant.operators.containment import jaccard_pairs
from tests.test_cuts import BLOCKS, CAPTIONS, FIGURES, PAGES, REGIONS


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_figures_builds_no_table_on_the_driver(spark):
    """Rows that Spark takes for small, but that grow with the documents, are merged."""
    df = lambda s: spark.range(3).select(*[F.col("id").cast(x.split()[1]).alias(x.split()[0]) for x in s.split(", ")])
    done = df("doc long, num string")
    out = cuts.cut_figures(df(FIGURES), df(CAPTIONS), df(REGIONS), df(BLOCKS), df(PAGES), done)
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)
    assert "Broadcast" not in plan(layout.assign_regions(df(CAPTIONS), df(REGIONS), ["doc", "page"]))


def test_jaccard_pairs_are_tested_before_they_are_written(spark):
    """Sets of many sizes with a common vocabulary: pairs as by brute force, few candidates."""
    rnd = random.Random(3)
    sets = []
    for i in range(160):
        words = rnd.sample(range(300), rnd.choice([1, 2, 4, 9, 30, 90, 200]))
        sets.append(words)
        if i % 2:
            some = [w for w in words if rnd.random() > 0.12]
            sets.append(some + rnd.sample(range(300, 330), rnd.randint(0, len(words) // 10)))
    rows = [(i, "xy"[i % 3 == 0], " ".join(f"w{w:03}" for w in ws)) for i, ws in enumerate(sets)] + [(900, "x", sets and " ".join(f"w{w:03}" for w in sets[1])), (901, None, "w001 w002")]
    docs = spark.createDataFrame(rows, "id long, block string, text string")
    classes: dict = {}
    for i, block, text in rows:
        if block and text:
            classes.setdefault((block, frozenset(text.split())), []).append(i)
    want = set()
    for ((p, s), i), ((q, t), j) in combinations(classes.items(), 2):
        if p == q and len(s & t) / len(s | t) >= 0.75:
            want.add(tuple(sorted((min(i), min(j)))))
    out = jaccard_pairs(docs, "id", "text", "block", 0.75)
    got = out.collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 30
    size = {min(v): len(v) for v in classes.values()}
    assert all((r.n_a, r.n_b) == (size[r.a], size[r.b]) for r in got)
    # candidates are counted before any set travels, and signatures are compared inside their join
    joins = [x for x in plan(out).split("\n") if re.search("SortMergeJoin .*bit_count", x)]
    assert joins and "least" in plan(out)


def test_reference_lists_are_shuffled_once(spark):
    lines = spark.range(40).select((F.col("id") % 4).alias("doc"), F.col("id").alias("i"), F.lit("[1] Smith, J.: A title of things, Journal 3, 2019.").alias("line"))
    got = plan(parse_references(lines, "doc"))
    assert len(re.findall(r"Exchange (?!SinglePartition)\w*", got)) == 1 and "Join" not in got and "Window" not in got


def test_segments_are_shuffled_once(spark):
    """By line and then by block: the same rows stay where they are, also where page and block are fixed."""
    k = F.col("id")
    own = {"doc": k % 3, "page": F.lit(1), "block": F.lit(1), "line": k, "seq": F.lit(0), "t": F.lit("some words"), "size": F.lit(10.0), "y": k * 12.0, "font": F.lit("Serif"), "bold": k % 9 == 0, "raised": F.lit(False), "x0": F.lit(50.0), "y0": k * 12.0 - 9, "x1": F.lit(300.0), "y1": k * 12.0}
    got = plan(blocks.segments(blocks.marked_lines(spark.range(30).select(*[v.alias(c) for c, v in own.items()]))))
    assert len(re.findall(r"Exchange (?!SinglePartition)\w*", got)) == 1 and "Window" not in got
