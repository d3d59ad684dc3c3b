"""Keyed state: upserts, last-write-wins, merges, recent lists, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import squeeze, text


def latest(log: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key in an append log: an upsert's result."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() if isinstance(o, Column) else F.desc(o) for o in order])
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def direction(local: DataFrame, remote: DataFrame, key: str = "slug", at: str = "updatedAt") -> DataFrame:
    """key, direction: pull where the remote is strictly newer, push where the local is, else none."""
    l, r = local.select(key, text(at).alias("l")), remote.select(key, text(at).alias("r"))
    both = l.join(r, key, "full").select(key, text("l").alias("l"), text("r").alias("r"))
    return both.select(key, F.when(F.col("r") > F.col("l"), "pull").when((F.col("l") > F.col("r")) & (F.col("l") != ""), "push").otherwise("none").alias("direction"))


def newer_collection(local: DataFrame, remote: DataFrame, at: str = "updatedAt") -> DataFrame:
    """One row: which whole collection is newer by its latest stamp."""
    a = local.agg(F.coalesce(F.max(at), F.lit("")).alias("l"))
    b = remote.agg(F.coalesce(F.max(at), F.lit("")).alias("r"))
    return a.join(b, F.lit(True)).select("l", "r", F.when(F.col("r") > F.col("l"), "pull").when(F.col("l") > F.col("r"), "push").otherwise("none").alias("direction"))


def hydrate(local: DataFrame, remote: DataFrame, key: str = "slug", at: str = "updatedAt", fields: tuple[str, ...] = ("note", "highlights", "vocab")) -> DataFrame:
    """The local document where it is as new or newer, else field by field the remote's if it isn't empty."""
    types = dict(local.dtypes)
    both = local.alias("l").join(remote.alias("r"), key, "full")
    wins = text("l." + at) >= text("r." + at)

    def pick(f):
        a, b = F.col("l." + f), F.col("r." + f)
        full = F.size(b) > 0 if types[f].startswith("array") else text(b) != ""
        return F.when(wins, a).when(full, b).otherwise(a).alias(f)

    return both.select(key, *[pick(f) for f in fields], F.when(wins, F.col("l." + at)).otherwise(F.col("r." + at)).alias(at))


def merge_patch(current: DataFrame, patch: DataFrame, key: str, fields: list[str], at: str | None = None, now: str | None = None) -> DataFrame:
    """Fields of the patch where they aren't null; patched rows get the new stamp."""
    p = patch.select(F.col(key), *[F.col(f).alias(f"_p_{f}") for f in fields], F.lit(True).alias("_hit"))
    both = current.join(p, key, "left")
    out = {f: F.coalesce(f"_p_{f}", f) for f in fields}
    if at:
        out[at] = F.when(F.col("_hit"), F.lit(now)).otherwise(F.col(at))
    return both.withColumns(out).drop("_hit", *[f"_p_{f}" for f in fields])


def hydrated(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows with those of the remote put in their place as they are, stamps included; nothing is written back."""
    return local.join(remote.select(key).distinct(), key, "left_anti").select(*local.columns).unionByName(remote.select(*local.columns))


def cascade_delete(ids: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the deleted keys.  Shares are not passed: they stay."""
    return [t.join(ids.select(key).distinct(), key, "left_anti") for t in tables]


def share_valid(revoked: Column, expires: Column, now: Column) -> Column:
    """Not revoked, and without an expiry or expiring now or later; ISO text compares as text."""
    return ~F.coalesce(revoked.cast("boolean"), F.lit(False)) & (expires.isNull() | (expires >= now))


def may_read(uri: Column, session: Column, slug: Column) -> Column:
    """A session reads all; a share only below its paper's folder."""
    path = F.url_decode(F.get(F.split(uri, r"\?"), F.lit(0)))
    return session | path.startswith(F.concat(F.lit("/vault/papers/"), slug, F.lit("/")))


def clamp_scroll(x: Column) -> Column:
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (d < 0) | (F.abs(d) == float("inf")), 0).otherwise(F.round(d)).cast("int")


TABS = ("articleEn", "txt", "article")


def reading_tab(tab: Column) -> Column:
    """A tab that exists, else article."""
    return F.when(tab.isin(*TABS), tab).otherwise("article")


def clean_progress(progress: Column) -> Column:
    """Valid tabs only, positions clamped."""
    return F.transform_values(F.map_filter(progress, lambda k, v: k.isin(*TABS)), lambda k, v: clamp_scroll(v))


def reading_scroll(session: DataFrame, tab: str) -> Column:
    same = F.col("tab") == tab
    return F.coalesce(F.element_at("progress", F.lit(tab)), F.when(same, F.col("scroll")), F.lit(0))


def recent(sessions: DataFrame, owner: str, item: str, at: str, cap: int = 12) -> DataFrame:
    """Move to front: the newest visit of each item, the newest ``cap`` items per owner, ranked."""
    newest = sessions.groupBy(owner, item).agg(F.max(at).alias(at))
    w = Window.partitionBy(owner).orderBy(F.desc(at), item)
    return newest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def merge_sessions(local: DataFrame, remote: DataFrame, cap: int = 12) -> DataFrame:
    """slug, title, tab, scroll, progress, at: the newer session of each slug (ties: local), progress of both with the newer winning; the newest ``cap``."""
    cols = ["slug", "title", "tab", "scroll", "progress", "at"]
    both = local.select(*cols, F.lit(1).alias("own")).unionByName(remote.select(*cols, F.lit(0).alias("own")))
    newest = F.max_by(F.struct(*cols), F.struct("at", "own"))
    oldest = F.min_by("progress", F.struct("at", "own"))
    m = both.groupBy("slug").agg(newest.alias("n"), oldest.alias("o"))
    progress = F.map_concat(F.map_filter("o", lambda k, v: ~F.map_contains_key("n.progress", k)), F.col("n.progress"))
    out = m.select("slug", "n.title", "n.tab", "n.scroll", progress.alias("progress"), "n.at")
    return out.orderBy(F.desc("at"), "slug").limit(cap)


def same_sentence(a: Column, b: Column) -> Column:
    return F.lower(squeeze(a)) == F.lower(squeeze(b))


def import_vocab(book: DataFrame, words: DataFrame) -> DataFrame:
    """word, key, examples, status: new words added, examples of known ones joined unless their sentence is there.

    book: word, examples array<string>; words: word, sentence, ord.
    """
    new = words.where(F.trim(text("word")) != "").withColumn("key", F.lower(F.trim("word")))
    norm = F.lower(squeeze(text("sentence")))
    new = first_wins(new.withColumn("norm", norm), ["key", "norm"], "ord")
    new = new.groupBy("key").agg(F.min_by("word", "ord").alias("word"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence", "norm"))), lambda x: F.struct(x["sentence"], x["norm"])).alias("new"))
    old = book.select(F.lower("word").alias("key"), F.col("word").alias("old_word"), F.col("examples").alias("old"))
    both = old.join(new, "key", "full")
    had = F.transform(F.coalesce("old", F.array().cast("array<string>")), lambda s: F.lower(squeeze(s)))
    fresh = F.transform(F.filter(F.coalesce("new", F.expr("cast(array() as array<struct<sentence:string,norm:string>>)")), lambda x: (x["norm"] != "") & ~F.array_contains(had, x["norm"])), lambda x: x["sentence"])
    status = F.when(F.col("old").isNull(), "added").when(F.size(fresh) > 0, "merged").otherwise("same")
    return both.select(F.coalesce("old_word", "word").alias("word"), "key", F.concat(F.coalesce("old", F.array().cast("array<string>")), fresh).alias("examples"), status.alias("status"))


def match_gloss(entries: DataFrame, glosses: DataFrame) -> DataFrame:
    """Entries (word, ord) with the gloss of their word, else that of their position."""
    g = glosses.select("*")
    by_word = first_wins(g.withColumn("key", F.lower("word")), ["key"], "ord").select("key", F.struct("en", "zh").alias("w"))
    by_place = g.select("ord", F.struct("en", "zh").alias("p"))
    both = entries.withColumn("key", F.lower("word")).join(by_word, "key", "left").join(by_place, "ord", "left")
    return both.select("ord", "word", F.coalesce("w", "p").alias("gloss")).select("ord", "word", "gloss.en", "gloss.zh")


def fill_gloss(book: DataFrame, glosses: DataFrame) -> DataFrame:
    """Missing fields from the glosses; present ones win."""
    g = glosses.select(F.lower("word").alias("key"), *[F.col(f).alias("g_" + f) for f in ("en", "zh")])
    both = book.withColumn("key", F.lower("word")).join(g, "key", "left")
    return both.withColumns({f: F.when(text(f) != "", F.col(f)).otherwise(text("g_" + f)) for f in ("en", "zh")}).drop("key", "g_en", "g_zh")


def toggle_pair(vocab: DataFrame, toggles: DataFrame) -> DataFrame:
    """(word, sentence) pairs that are in exactly one of both; contexts cut at 300 characters."""
    key = [F.lower("word").alias("_w"), F.lower(squeeze(text("context"))).alias("_c")]
    a, b = vocab.select("*", *key), toggles.withColumn("context", F.substring("context", 1, 300)).select("*", *key)
    kept = a.join(b.select("_w", "_c"), ["_w", "_c"], "left_anti")
    added = b.join(a.select("_w", "_c"), ["_w", "_c"], "left_anti")
    return kept.unionByName(added, allowMissingColumns=True).drop("_w", "_c")


def remove_word(book: DataFrame, word: str) -> DataFrame:
    return book.where(F.lower("word") != word.lower())


def filter_book(book: DataFrame, query: str) -> DataFrame:
    """Library search: word, Chinese, English or pronunciation contains the trimmed query."""
    q = query.strip().lower()
    return book.where(F.contains(F.lower(F.concat_ws("\n", "word", "zh", "en", "ipa")), F.lit(q)) if q else F.lit(True))


def filter_page(book: DataFrame, query: str) -> DataFrame:
    """Page search: over the joined texts, without pronunciation, untrimmed."""
    return book.where(F.contains(F.lower(F.concat_ws(" ", "word", "en", "zh")), F.lit(query.lower())))


def needs_gloss(en: Column, zh: Column) -> Column:
    return (text(en) == "") | (text(zh) == "")


def highlights_kept(highlights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Highlights (slug, tab, block, start, end, text) with ok: the block still reads so there.  Offsets are code points."""
    both = highlights.join(blocks.select("slug", "tab", "block", F.col("text").alias("_t")), ["slug", "tab", "block"], "left")
    return both.withColumn("ok", F.coalesce(F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text"), F.lit(False))).drop("_t")


def merge_terms(registry: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term, aliases, domains, usages: new entries, or arrays joined to known ones; known scalars stay."""
    both = registry.alias("o").join(terms.alias("n"), "key", "full")
    arrays = [F.array_union(F.coalesce(F.col("o." + f), F.array()), F.coalesce(F.col("n." + f), F.array())).alias(f) for f in ("aliases", "domains", "usages")]
    return both.select("key", F.coalesce("o.term", "n.term").alias("term"), *arrays)
