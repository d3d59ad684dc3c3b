"""Packing against plain concatenation with the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "don't", "l'été", "Été", "中文", "12", "x1", ",.", "...", "<|endoftext|>", " ", "  ", "\n", "\t", " ", "　", " ", "​", "\x00", "\x1c", "𝒳", "é", "ñ", "ǆ", "word", "Word", "'s", "'ll"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def own_ids(texts, chunk=1 << 20):
    e, out = packing.Encoder(PATH), []
    for _, n, buf, off in packing.text_chunks(pa.array(texts, pa.string()), chunk):
        ids, at = e.ids(buf, off)
        out += [ids[at[k] : at[k + 1]].tolist() for k in range(n)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=12), max_size=6))
def test_units_give_the_ids_of_whole_texts(texts):
    for join in ("", " "):
        whole = [join.join(t) for t in texts]
        assert own_ids(whole) == plain_ids(whole)


def test_runs_of_many_units_and_long_words(monkeypatch):
    monkeypatch.setattr(packing, "RUN", 50)
    texts = [" ".join(f"w{i * i} é{i} 中{i}" for i in range(300)), "A" * 20_000, " " * 3000, "", "end"]
    assert own_ids(texts, 100) == plain_ids(texts)


def test_other_files_use_their_library(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    from tokenizers import Tokenizer

    text = "some words and other words"
    assert packing.encoder(str(path))[0](text) == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError, match="byte-level"):
        packing.encoder(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " ", "one", "one", "two words " * 1500, "Été 中文 " * 40, *[f"text {i} of {i * 7} words" * (i % 9) for i in range(60)]]
    ids = [None, *range(len(texts) - 3), 5, 5]
    rows = [(i, t, "x", 1, 2, "k") for i, t in zip(ids, texts, strict=True)]
    # columns of the names that are used inside
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part int, before int, key string").repartition(5)


@pytest.mark.parametrize("length", [1024, 7])
def test_packing_equals_concatenation(spark, docs, length):
    cut = packing.pieces(docs, PATH, length=length)
    got = cut.collect()
    by_seq = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r))
    # sequences are gapless and full but for the last
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, rows in by_seq.items():
        rows.sort(key=lambda x: x[0])
        ends = np.cumsum([r.length for _, r in rows])
        assert [o for o, _ in rows] == [0, *ends[:-1]]
        assert ends[-1] == length or s == max(by_seq) and ends[-1] < length
    # the pieces, in order, are the documents: the same multiset of (id, ids)
    order = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    whole, own = [], []
    for r in order:
        assert r.start == len(own)
        own += np.frombuffer(r.ids, "<u4").tolist()
        if len(own) == r.doc_tokens:
            whole.append((r.key, own))
            own = []
    assert not own
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    want = [(r.doc_id, ids + [0]) for r, ids in zip(rows, plain_ids([r.t for r in rows]), strict=True)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(whole, key=key) == sorted(want, key=key)
    # the sequences themselves
    stream = [x for r in order for x in np.frombuffer(r.ids, "<u4").tolist()]
    for s in packing.sequences(cut, length, pad_id=9).collect():
        ids = np.frombuffer(s.ids, "<u4").tolist()
        assert ids[: s.n_tokens] == stream[s.sequence_id * length : (s.sequence_id + 1) * length] and set(ids[s.n_tokens :]) <= {9}
        assert len(ids) == (s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else length)
        assert sum(b.length for b in s.boundaries) == s.n_tokens


def test_packing_of_an_empty_table_and_records_alone(spark, docs):
    assert packing.pieces(docs.limit(0), PATH).collect() == []
    a, b = packing.pieces(docs, PATH), packing.pieces(docs, PATH, with_ids=False)
    assert "ids" not in b.columns and b.agg(F.sum("length"), F.sum("ids_crc32")).first() == a.agg(F.sum("length"), F.sum("ids_crc32")).first()
