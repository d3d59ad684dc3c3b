"""Column layout of documents whose spans stand together: nothing is shuffled, and the rows are the same."""

from __future__ import annotations

import random
import re

import duckdb

from foliant.operators import columns
from foliant.plans import layout_queries, registry
from tests.test_columns import span, spans_of
from tests.test_growth import plan

COLS = ["doc", "page", "pos", "kind", "mark", "text"]


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?!SinglePartition)\w*", plan(df)))


def pages_of(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for doc in [*range(12), None]:
        for page in [1, 2, None][: rng.randrange(1, 4)]:
            for r in range(rng.choice([1, 4, 40])):
                words = " ".join(rng.choice(["the", "non-", "linear", "Nonlinear", "ﬁne", "中文", "exam-", "ple", "Fig. 1. A"]) for _ in range(3))
                rows.append(span(60 + 11 * r, 50, rng.choice([550, 550, 300]), words, rng.choice([10.0, 10.25, 16.0]), rng.random() < 0.1, font=rng.choice(["Serif", "CMMI10"]), doc=doc, page=page))
        rows.append(span(9, 1, 2, "  ", doc=doc))
    return rows


def test_one_shuffle_or_none(spark):
    spans = spans_of(spark, pages_of(1))
    assert exchanges(columns.paragraphs(spans)) == 1
    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    for df in (columns.paragraphs(layout_queries.set_spans(docs), dealt=True), columns.paragraphs(spans)):
        assert "Join" not in plan(df) and "Window" not in plan(df)
    assert exchanges(columns.paragraphs(layout_queries.set_spans(docs), dealt=True)) == 0


def test_dealt_spans_give_the_same_rows(spark):
    rows = pages_of(2)
    want = sorted(map(repr, columns.paragraphs(spans_of(spark, rows).repartition(7)).select(COLS).collect()))
    for size in (1, 9, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = columns.paragraphs(spans_of(spark, rows).coalesce(1), dealt=True).select(COLS).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(repr, got)) == want
    assert {None, *range(12)} == {r.doc for r in got} and any("nonlinear" in r.text for r in got) and any("example" in r.text for r in got)


def test_a_hyphen_is_judged_by_all_pages_of_its_document(spark):
    lines = lambda doc: [span(100, 50, 550, "a non-", doc=doc), span(112, 50, 550, "linear one", doc=doc)]
    rows = [*lines(1), *lines(2), span(100, 50, 550, "Nonlinear flow", doc=2, page=5), *[span(60 + 12 * r, 50, 550, "x", doc=3) for r in range(30)]]
    got = {(r.doc, r.page): r.text for r in columns.paragraphs(spans_of(spark, rows)).collect()}
    assert got[1, 1] == "a non-linear one" and got[2, 1] == "a nonlinear one"


def test_body_size_is_that_of_each_document(spark):
    """The tenth above for a half, the larger of two as frequent, 10 where all are tiny."""
    for sizes, want in (([10.25, 10.25, 8.0], 10.3), ([9.0, 12.0], 12.0), ([2.0, 2.0], 10.0), ([2.0, 2.0, 2.0, 7.0], 7.0)):
        rows = [span(100 + 12 * r, 50, 550, "x", s, doc=d) for d in (1, 2) for r, s in enumerate(sizes if d == 1 else [20.0])]
        spans = spans_of(spark, rows)
        got = {r.doc: r.body for r in columns.page_items(spans).select("doc", "body").distinct().collect()}
        assert got == {1: want, 2: 20.0} == {r.doc: r.body for r in columns.span_body(columns.cleaned(spans)).collect()}


def test_query_equals_its_sql_on_odd_documents(spark, tmp_path):
    """Texts without words, null texts and a null id."""
    texts = {0: "", 1: None, 2: "a 1 2", 3: "word " * 2000, 4: "ab " * 500, 5: "xy-zz. " * 700, 6: "中文 ab", None: "no id here " * 300}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = layout_queries.column_layout(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["column_layout"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 20
