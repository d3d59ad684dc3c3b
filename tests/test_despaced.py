"""Letter-spaced labels are closed up as by a plain fold, and a census spends no inner function on its lines."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from foliant.operators import layout, metadata


def plain(x):
    first = lambda p, t, k=1: (re.search(p, t, re.A) or [""] * 3)[k]
    close = lambda t, w: re.sub(r"\s", "", w) + t[len(w) :] if w else t
    t = x.strip(" ")
    label = first(layout.SPACED_LABEL, t)
    t = close(t, label)
    word = first(layout.SPACED_WORD, t)
    t = close(t, word)
    number = r"^([A-Za-z]+)\s*(\d(?:\s\d){1,2})(?=\s|$)"
    if (label or word) and re.search(number, t, re.A):
        return f"{first(number, t)} {re.sub(chr(92) + 's', '', first(number, t, 2))}{re.sub(number, '', t, flags=re.A)}"
    return t


def test_labels_close_up_as_by_a_plain_fold(spark):
    rnd, out = random.Random(9), ["", "Table 0", "Figure1 2 x", "F I G U R E 1 2", "Fi gure 3", "t a b l e 4 5 6", "A B C d", "a b", "Fig 1 2", "figur e1 2", "Tables 1 2"]
    for _ in range(600):
        label = rnd.choice(["figure", "TABLE", "Table", "Figure", "fig", "tab", "abc"])
        out.append("".join(c + rnd.choice(["", "", " ", "\t"] if rnd.random() < 0.5 else [""]) for c in label) + rnd.choice(["", " "]) + rnd.choice(["1 2", "1 2 3", "12", "1", "1 2 3 4", "x"]) + rnd.choice(["", " more", "more"]))
    df = spark.createDataFrame(list(enumerate(out)), "i int, s string")
    assert [r.t for r in df.orderBy("i").select(layout.despaced(F.col("s")).alias("t")).collect()] == [plain(s) for s in out]


def test_a_census_takes_its_lines_apart_before_it_reads_them(spark):
    docs = spark.createDataFrame([(1, "Table 01. Values\nF I G U R E 2 Values of x\nx = 3 (4)", "")], "id int, f string, c string")
    got = metadata.census(docs, "id", "f", "c")
    assert {(r.kind, r.label) for r in got.collect()} == {("table", "1"), ("figure", "2"), ("equation", "4")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split(" in plan and "posexplode(transform(" not in plan
