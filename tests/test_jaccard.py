"""Similar token sets: what travels, and odd tables against the query's own SQL."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from foliant.operators import containment
from foliant.operators.containment import jaccard_pairs, prefixes
from foliant.plans import catalog_queries, registry


@pytest.fixture
def merged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_are_shuffled_once_and_gathered_by_no_aggregate(spark, merged):
    docs = spark.createDataFrame([(1, "x", "one two three"), (2, "x", "one two three four")], "id long, block string, text string")
    got = jaccard_pairs(docs, "id", "text", "block", 0.75)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 1, 1)]
    text = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]\nArguments: ([^\n]*)", text)
    assert len(moved) > 4
    # besides the one shuffle of all sets only pairs that passed take a set along
    again = [re.findall(r"\b(k_b|tk\w*)#", of) for of, how in moved if re.search(r"\btk(_[ab])?#", of) and "REPARTITION" not in how]
    assert again and all(x == ["k_b", "tk_a"] for x in again)
    assert "collect_list" not in text and "Window" not in text


def test_prefixes_of_whole_sets():
    """Rare tokens first, those of no other set left out in their place, signatures of all tokens."""
    rng = np.random.default_rng(4)
    for sizes in ([1], [1, 2, 3, 4, 5, 100], [7, 1, 260]):
        h = rng.integers(-(2**63), 2**63, sum(sizes))
        f = rng.integers(0, 4, sum(sizes)).astype(np.int8)
        k = np.repeat(rng.integers(-(2**63), 2**63, len(sizes)), sizes)
        got = prefixes(pa.table({"k": k, "h": h, "f": f}), 0.75).to_pylist()
        want, at = [], 0
        for n in sizes:
            own = sorted(zip(f[at : at + n].tolist(), h[at : at + n].tolist(), strict=True))
            sign = [0] * containment.SIGNATURE
            for _, x in own:
                sign[x >> 6 & (containment.SIGNATURE - 1)] ^= 1 << (x & 63)
            sign = [x - 2**64 if x >= 2**63 else x for x in sign]
            for i, (freq, x) in enumerate(own[: n - -(-3 * n // 4) + 1]):
                if freq:
                    want.append({"h": x, "k": int(k[at]), "n": n, "at": i} | {f"s{w}": s for w, s in enumerate(sign)})
            at += n
        assert got == want


def test_pairs_of_large_sets_are_bounded_before_they_are_written(spark):
    """Sets too large for their signatures, with many common tokens: candidates are the similar ones."""
    rnd = random.Random(6)
    sets = [rnd.sample(range(3000), rnd.choice([300, 400, 700])) for _ in range(60)]
    sets += [[w if rnd.random() > 0.05 else w + 3000 for w in s] for s in sets[:20]]
    docs = spark.createDataFrame([(i, "x", " ".join(f"w{w:04}" for w in s)) for i, s in enumerate(sets)], "id long, block string, text string")
    got = {(r.a, r.b) for r in jaccard_pairs(docs, "id", "text", "block", 0.75).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len({*sets[i]} & {*sets[j]}) >= 0.75 * len({*sets[i]} | {*sets[j]})}
    assert got == want and len(want) >= 20


@pytest.mark.parametrize("least", [None, -1])
def test_query_equals_its_sql_on_odd_documents(spark, tmp_path, least):
    """Null ids, texts and sources, ids and rows that stand twice, a set in two sources, copies, near copies of all sizes."""
    rnd = random.Random(9)
    words = [f"w{i:03}" for i in range(200)]
    rows = []
    for n in (1, 2, 3, 4, 5, 7, 8, 12, 40, 150):
        base = rnd.sample(words, n)
        for c in range(4):
            own = [w for w in base if c == 0 or rnd.random() > 0.06] + rnd.sample(words, n // 20)
            rows += [(len(rows) + i, s, " ".join(rnd.sample(own, len(own)) * (1 + c))) for i, s in enumerate(("p", "q", "p") if c < 2 else ("p",))]
    rows += [(None, "p", "w001 w002 w003 w004"), (None, "p", "w001 w002 w003 w004 w005"), (7, "p", "w001 w002 w003 w004 w006"), rows[3], rows[3], rows[20]]
    rows += [(900, None, "w001 w002 w003 w004"), (901, "p", None), (902, "p", "a b -"), (903, "p", ""), (904, "p", "W001, W002; w003/w004"), (0, "p", rows[12][2])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    if least:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    try:
        got = sorted(map(tuple, catalog_queries.jaccard_title(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["jaccard_title"]).fetchall())
    assert got == want and len(want) > 20
