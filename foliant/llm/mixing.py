"""Mixing sources to target weights.

Every document gets a hash-random key.  The documents of a source are range
sorted by it, distributed prefix sums of their token counts are taken, and the
mix is cut at the source's exact budget; a budget beyond the source's size
starts another epoch over the same order.

The prefix sums take two levels, so that no source is gathered in one task: the
key's leading bits deal a source into ranges of about ``range_rows`` documents;
range totals are summed per (source, range), their running sums are offsets, and
the running sum within a range is added.  Only ids, sizes and keys are shuffled.

Budgets: targets[s] = min(epochs * size[s], level * weight[s]) with one level
such that they sum to share * all sizes.  This is the fixed point of resharing
the excess of capped sources by weight; the level is found by sorting sources by
cap/weight and prefix sums.

Defined results: null or blank texts have size 0 and take 0; a null source is a
source of its own, last; sources without words have target 0; ties of the key
are broken by id and size; repeated rows are documents of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, word_count

WEIGHTS = (5, 2, 1)


def mix_targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, source_size -> with target.  One row per source: small by nature."""
    alone = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(alone.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    cap = F.lit(float(epochs)) * F.col("source_size")
    by = alone.orderBy("_ratio", "_rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(alone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    return (
        per_source.withColumn("_rank", rank)
        .withColumn("_w", w)
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", level)
        # the level holds from the first source on that it doesn't fill
        .withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(alone)["_level"])
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))))
        .select("source", "source_size", "target")
    )


def mix_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Rows of one id, or without an id, are dealt by their texts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 8, range_rows: int = 2000) -> DataFrame:
    """doc_id, source -> doc_id, source, size, source_size, target, taken, and the
    hash of the text that tells rows of one id apart."""
    keyed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), mix_key(F.col("doc_id"), F.col("text"), seed).alias("_key"))
    # hex digits of the key that deal a source into ranges, by the rows there are
    digits = max(1, math.ceil(math.log(max(1, docs.count() / range_rows), 16)))
    keyed = keyed.withColumn("_fine", F.substring("_key", 1, digits))
    ranges = keyed.groupBy("source", "_fine").agg(F.sum("size").alias("_sum"))
    ranges = ranges.withColumn("_prefix", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = ranges.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = mix_targets(totals, weights, share, epochs)
    r, t = ranges.alias("r"), targets.alias("t")
    ranges = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "_fine", "_prefix", "source_size", "target")
    w = Window.partitionBy("source", "_fine").orderBy("_key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    k, g = inner.alias("k"), ranges.alias("g")
    both = k.join(g, F.col("k.source").eqNullSafe(F.col("g.source")) & (F.col("k._fine") == F.col("g._fine"))).select("k.doc_id", "k.source", "size", "text_hash", "source_size", "target", (F.col("_before") + F.col("_prefix")).alias("_before"))
    return both.withColumn("taken", taken(F.col("_before"), F.col("size"), F.col("source_size"), F.round("target").cast("long"), epochs)).drop("_before")


def taken(before: Column, size: Column, source_size: Column, budget: Column, epochs: int) -> Column:
    """Words of a document within the budget, over all epochs."""
    per_epoch = [F.greatest(F.lit(0), F.least(size, budget - source_size * e - before)) for e in range(epochs)]
    out = per_epoch[0]
    for x in per_epoch[1:]:
        out = out + x
    return out.cast("long")


def oracle_sql(weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 8) -> str:
    """DuckDB SQL for op8: plain prefix sums, and the budgets by trying each source as the first that isn't full."""
    w = "case " + " ".join(f"when i % {len(weights)} = {k} then {float(x)}" for k, x in enumerate(weights)) + " end"
    one = " + ".join(f"greatest(0, least(size, cast(round(target) as bigint) - {e} * source_size - before))" for e in range(epochs))
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size, md5('{seed}:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as k from documents),
s as (select source, cast(sum(size) as double) as n, row_number() over (order by source nulls last) - 1 as i from d group by source),
c as (select *, {w} as w, {float(epochs)} * n as cap from s),
l as (select a.i, ({float(share)} * (select sum(n) from c) - coalesce((select sum(b.cap) from c b where (b.cap / b.w, b.i) < (a.cap / a.w, a.i)), 0)) / (select sum(b.w) from c b where (b.cap / b.w, b.i) >= (a.cap / a.w, a.i)) as level, a.cap / a.w as ratio from c a),
v as (select level from l where ratio >= level order by ratio, i limit 1),
t as (select source, cast(n as bigint) as source_size, least(cap, (select level from v) * w) as target from c),
p as (select d.*, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d)
select doc_id, p.source, cast(size as bigint) as size, source_size, target, cast({one} as bigint) as taken
from p join t on p.source is not distinct from t.source"""


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 8) -> DataFrame:
    """The rows of docs that the mix takes words of, with size, source_size, target and taken (columns of those names are replaced)."""
    own = ("size", "source_size", "target", "taken")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    mix = mix_sources(docs, weights, share, epochs, seed).where("taken > 0").groupBy("doc_id", "source", "text_hash").agg(*[F.max(c).alias(c) for c in own])
    (key,) = fresh(docs, "text_hash")
    d, m = docs.withColumn(key, F.xxhash64("text")).alias("d"), mix.alias("m")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col(f"d.{key}") == F.col("m.text_hash"))
    return d.join(m, same).select(*[F.col(f"d.`{c}`") for c in docs.columns], *[F.col(f"m.{c}") for c in own])
