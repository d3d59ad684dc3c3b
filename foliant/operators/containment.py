"""Containment and similarity joins that block before they compare."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from foliant.operators.pages import heads, whole

WORD = r"([\p{L}\p{N}]+)"
INNER_WORD = r"(?<=[^\p{L}\p{N}])([\p{L}\p{N}]+)(?=[^\p{L}\p{N}])"


def contains_windows(items: DataFrame, docs: DataFrame, item_id: str, doc_id: str, text: str, size: int = 40, windows: int = 5, least: int = 120) -> DataFrame:
    """item, doc: texts that hold one of the items' evenly spaced windows verbatim.

    A text that holds a window holds all words that stand whole inside it, so each
    window is looked up by the rarest of them: an equi-join on words, then the
    test.  Only windows without a whole word are searched in every text.
    """
    step = F.floor((F.length(text) - size) / (windows - 1))
    wins = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substring(F.col(text), (k * step + 1).cast("int"), size))
    win = items.where(F.length(text) >= least).select(item_id, F.explode(F.array_distinct(wins)).alias("_win"))
    keyed = win.withColumn("_ws", F.array_distinct(F.regexp_extract_all("_win", F.lit(INNER_WORD))))
    asked = keyed.select(F.explode("_ws").alias("_w")).distinct()
    words = docs.select(doc_id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD)))).alias("_w")).join(asked, "_w", "left_semi")
    df = words.groupBy("_w").agg(F.count("*").alias("_df"))
    rarest = keyed.select("_win", F.explode("_ws").alias("_w")).distinct().join(df, "_w").groupBy("_win").agg(F.min_by("_w", F.struct("_df", "_w")).alias("_w"))
    found = rarest.join(words, "_w").join(docs.select(doc_id, text), doc_id).where(F.contains(text, "_win")).select("_win", doc_id)
    rest = keyed.where(F.size("_ws") == 0).select("_win").distinct()
    if not rest.isEmpty():  # windows of the items: a query set
        found = found.union(docs.select(doc_id, text).join(rest, F.contains(text, "_win")).select("_win", doc_id))
    return win.join(found, "_win").select(item_id, doc_id).distinct()


def _token_sets(rows: DataFrame, id_: str, text: str, block: str, token: str) -> DataFrame:
    """id, block, tk (sorted token set), of rows with tokens."""
    tk = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(token))))
    # a filter on what is exploded does not take the tokens out a second time
    return rows.select(id_, block, F.explode(F.array(tk)).alias("tk")).where(F.size("tk") > 0)


def jaccard_classes(rows: DataFrame, id_: str, text: str, block: str, token: str = r"([a-z0-9]{3,})") -> DataFrame:
    """id, class: rows of a block with equal token sets are a class, named by its least id.  Rows without tokens are left out."""
    tk = _token_sets(rows, id_, text, block, token).withColumn("_h", F.sha2(F.array_join("tk", " "), 256))
    first = tk.groupBy(block, "_h").agg(F.min(id_).alias("class"))
    return tk.join(first, [block, "_h"]).select(id_, block, "class", "tk")


#: Kinds of tokens whose frequencies are broadcast, a byte each, and kinds a row; words of 64
#: bits of a set's signature; common tokens that a pair must show at least, where it has them.
KINDS, ROW, SIGNATURE, COMMON = 2**24, 2**12, 2, 4
#: What stands between tokens in a line of them.
BETWEEN = "\x1f"


def least_of(share: float, n):  # noqa: ANN001, ANN201
    return F.ceil(share * n - 1e-6).cast("int")


@pandas_udf(T.ArrayType(T.ByteType()))
def packed(at: pd.Series, byte: pd.Series) -> np.ndarray:
    """The bytes of a row of kinds, 0 where none is given."""
    out = np.zeros(ROW, np.int8)
    out[at] = byte
    return out


def prefixes(batch: pa.Table, threshold: float) -> pa.RecordBatch:
    """The prefixes of whole sets, rare tokens first: h, k, n, at (the token's place), and
    the set's signature, from k, h and f of all of its tokens.  Tokens that no other set
    has (f = 0) take their places, but are left out."""
    k, h, f = (batch[c].to_numpy() for c in "khf")
    new = heads(k)
    start, own = np.flatnonzero(new), np.cumsum(new) - 1
    n = np.diff(np.append(start, len(h)))
    bits, word = np.left_shift(np.uint64(1), (h & 63).astype(np.uint64)), h >> 6 & (SIGNATURE - 1)
    signature = [np.bitwise_xor.reduceat(np.where(word == w, bits, np.uint64(0)), start).view(np.int64) for w in range(SIGNATURE)]
    order = np.lexsort((h, f, own))
    at = np.arange(len(h)) - start[own]
    p = n - np.ceil(threshold * n - 1e-6).astype(int) + 1
    kept = np.flatnonzero((at < p[own]) & (f[order] > 0))
    own = own[kept]
    out = {"h": h[order[kept]], "k": k[start[own]], "n": n[own].astype(np.int32), "at": at[kept].astype(np.int32)}
    return pa.RecordBatch.from_pydict(out | {f"s{w}": s[own] for w, s in enumerate(signature)})


def jaccard_pairs(rows: DataFrame, id_: str, text: str, block: str, threshold: float, token: str = r"([a-z0-9]{3,})") -> DataFrame:
    """a, b, n_a, n_b: classes within a block (see ``jaccard_classes``) whose token sets have that Jaccard similarity, and their sizes.

    Prefix filter: tokens are ordered by their frequency in the block, rare first (by that
    of their kind, one of 2^24 by hash, roughly); two sets so similar share one of their
    first (1 - threshold) * size + 1 tokens.  Four tests, none of which
    drops a pair that is similar, then bound what is written; all but the last are made
    inside the join, before a pair is written:

    * their sizes differ by that factor at most;
    * a set's signature has a bit for each of 128 kinds of tokens, set if their number is
      odd; the signatures differ in no more bits than the sets in tokens;
    * of two sets that must share m tokens, the k-th they share has at least m - k others
      behind it in both, so it stands among the first size - m + k of each;
    * tokens that the two share outside their prefixes are no more than the larger rest
      of both, so the remaining ones are shared inside: ``COMMON`` of them are counted, or an
      eighth if that is more.

    A set is written once, as a line of its tokens, and goes by 64 bits of its digest, ``k``;
    it travels only to pairs that pass, and these are compared in full.  (Two sets of equal
    ``k`` are not compared with each other.)
    """
    lines = _token_sets(rows.where(F.col(block).isNotNull()), id_, text, block, token).select(F.col(id_).alias("id"), F.col(block).alias("block"), F.array_join("tk", BETWEEN).alias("tk"))
    # all uses below need the same columns of the lines, so that these are made and shuffled once
    sets = lines.withColumn("k", F.xxhash64("block", "tk")).repartition("k").groupBy("k", "block", "tk").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where(F.col("id").isNotNull())
    # a hash of block and token: two that collide make one more candidate
    one = sets.select("k", F.explode(F.transform(F.split("tk", BETWEEN), lambda t: F.xxhash64("block", t))).alias("h")).withColumn("kind", F.col("h").bitwiseAND(KINDS - 1).cast("int"))
    # a byte says how frequent a kind is: 0 for one token of one set, else four times the logarithm to base 2
    byte = F.least(F.floor(F.log2("f") * 4), F.lit(127)).cast("byte")
    often = one.groupBy("kind").agg(F.count("*").alias("f")).where("f > 1").groupBy(F.floor(F.col("kind") / ROW).cast("int").alias("row")).agg(packed((F.col("kind") % ROW).cast("int"), byte).alias("bytes"))
    ranked = one.withColumn("row", F.floor(F.col("kind") / ROW).cast("int")).join(F.broadcast(often), "row", "left").select("k", "h", F.coalesce(F.get("bytes", F.col("kind") % ROW), F.lit(0).cast("byte")).alias("f"))
    signs = [f"s{w}" for w in range(SIGNATURE)]
    # the tokens of a set stand together, as they are exploded from its row
    keyed = ranked.mapInArrow(lambda batches: whole(batches, "k", lambda t: prefixes(t, threshold)), "h long,k long,n int,at int," + ",".join(f"{s} long" for s in signs))
    a, b = (keyed.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("k", "n", "at", *signs)]) for x in "ab")
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    shared = least_of(threshold / (1 + threshold), F.col("n_a") + F.col("n_b"))
    apart = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in signs), F.lit(0))
    rest = F.greatest(least_of(threshold, F.col("n_a")), least_of(threshold, F.col("n_b"))) - 1
    inside = F.greatest(shared - rest, F.lit(1))
    count = F.least(inside, F.greatest(F.ceil(inside / 8).cast("int"), F.lit(COMMON)))
    early = (F.col("at_a") <= F.col("n_a") - shared + count - 1) & (F.col("at_b") <= F.col("n_b") - shared + count - 1)
    pairs = a.join(b.hint("merge"), "h").where("k_a < k_b").where(near & early & (apart <= F.col("n_a") + F.col("n_b") - 2 * shared))
    pairs = pairs.groupBy("k_a", "k_b", count.alias("least")).agg(F.count("*").alias("c")).where("c >= least").select("k_a", "k_b")
    sa, sb = (sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("k", "id", "block", "tk", "copies")]) for x in "ab")
    words = lambda x: F.split(x, BETWEEN)
    inter = F.size(F.array_intersect(words("tk_a"), words("tk_b")))
    union = F.size(words("tk_a")) + F.size(words("tk_b")) - inter
    # as a join key the block would part the sets anew
    alike = F.when(F.col("block_a") == F.col("block_b"), inter / union).otherwise(0) >= threshold
    found = pairs.join(sa, "k_a").join(sb, "k_b").where(alike & (F.col("id_a") != F.col("id_b")))
    first = lambda x, y: F.when(F.col("id_a") < F.col("id_b"), F.col(x)).otherwise(F.col(y))
    return found.select(first("id_a", "id_b").alias("a"), first("id_b", "id_a").alias("b"), first("copies_a", "copies_b").alias("n_a"), first("copies_b", "copies_a").alias("n_b"))
