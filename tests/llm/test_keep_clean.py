"""Which rows decontamination keeps: by row, not by id."""

from __future__ import annotations

import random

from foliant.llm import decontaminate


def test_rows_go_by_their_texts(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    item = prose(30)
    leak = prose(20) + " " + item + " " + prose(20)
    rows = [(None, leak, 1), (None, prose(60), 2), (77, leak, 3), (77, prose(60), 4), (78, None, 5), (79, "", 6), (80, leak, 7), (81, prose(60), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_digest int")
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.text_digest for r in kept.collect()) == [2, 4, 5, 6, 8]
    assert decontaminate.keep_clean(docs.limit(0), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0
