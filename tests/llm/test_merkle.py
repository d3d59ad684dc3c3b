"""The Merkle manifest against plain recursion over lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int, part int, grp string, node string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sized(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(doc, n_chars):
    return h(*[sized(x) for x in (doc["doc_id"], doc["source"], doc["lang"], n_chars, doc["text"])])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), i % 2
        i //= 2


def plain(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for g in langs:
        own = sorted((first(r["doc_id"]), leaf_of(r, r["n_chars"]), k) for k, r in enumerate(rows) if r["lang"] == g)
        groups[g] = ([k for *_, k in own], levels_of([x for _, x, _ in own]))
    top = levels_of([groups[g][1][-1][0] for g in langs])
    out = []
    for gi, g in enumerate(langs):
        order, levels = groups[g]
        for i, k in enumerate(order):
            r = rows[k]
            path = [*siblings(levels, i), *siblings(top, gi)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf_of(r, r["n_chars"] + 1) if hit else levels[0][i]
            for s, left in path:
                node = h(s or "", node) if left else h(node, s or "")
            out.append((r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], h(*[s for s, _ in path if s]), node, not hit))
    return out


def rows_of(n, langs):
    out = []
    for i in range(n):
        doc = {"doc_id": i * 37 % 1001 - 20, "text": "text %d Été" % (i % 50), "lang": langs[i % len(langs)], "source": "s%d" % (i % 3), "n_chars": i, "leaf": "x", "rank": 1, "part": 2, "grp": "g", "node": "n"}
        doc |= [{}, {"text": None}, {"text": ""}, {"source": None}, {"n_chars": None}, {"doc_id": None}, {"text": "w " * 30_000}][i % 7 if i < 30 else 0]
        out.append(doc)
    return out + [dict(out[3]), dict(out[5]), dict(out[5])]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("n", "langs", "bits"), [(260, ["en", "de", None, "é", "z"], 2), (97, ["en"], 3), (64, ["en", "en", "en", "fr"], 5), (9, list("abcdefghi"), 1)])
def test_manifest_equals_plain_recursion(spark, monkeypatch, n, langs, bits):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 11)
    rows = rows_of(n, langs)
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    docs = spark.createDataFrame([tuple(r[c] for c in fields) for r in rows], SCHEMA)
    real = merkle.merkle_tree
    monkeypatch.setattr(merkle, "merkle_tree", lambda nodes, order, _: real(nodes, order, bits))
    same(merkle.tampered_manifest(docs).collect(), plain(rows))


def test_one_leaf_and_none(spark):
    docs = spark.createDataFrame([(1, "a", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.manifest(docs).collect()
    assert len(r) == 1 and r[0].leaf == r[0].subroot == r[0].root and r[0].path == []
    assert merkle.tampered_manifest(docs).first().proof_sha256 == h()
    assert merkle.tampered_manifest(docs.limit(0)).collect() == []


def test_many_copies_of_one_row_are_dealt_to_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    docs = spark.range(600).select(F.lit(7).alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).alias("n_chars"))
    seen = []
    real = merkle.written
    monkeypatch.setattr(merkle, "written", lambda df, kind: seen.append((kind, real(df, kind))) or seen[-1][1])
    rows = merkle.manifest(docs).collect()
    parts = [r["count"] for kind, df in seen if kind == "merkle-ranges" and df.count() > 1 for r in df.groupBy("part").count().collect()]
    assert len(parts) > 4 and max(parts) < 300
    assert len(rows) == 600 and len({r.root for r in rows}) == 1 and len({tuple(r.path) for r in rows}) == 600
