"""Wiki links, aliases and references between catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import c, doi_key, link_key_ascii, link_key_unicode, sub, text
from foliant.operators.sync import first_wins

# Fixed link grammar: [[target|label]], without embeds and same-page anchors.
WIKI = r"(?<!\!)\[\[(?!#)([^\]|]+?)(?:\|[^\]]*)?\]\]"
EMBED = r"!\[\[([^\]|#]+?)(?:\|[^\]]*)?\]\]"
IMAGE = r"(?i)\.(png|jpe?g|gif|webp|svg)$"


def wiki_targets(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text(x), F.lit(WIKI)), lambda s: F.trim(s))


def embed_targets(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text(x), F.lit(EMBED)), lambda s: F.trim(s))


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(text(html), F.lit(r'href="([^"]*)"'))


def alias_map(terms: DataFrame, names: list[str], ordinal: str, with_key: bool = False, ascii_only: bool = False) -> DataFrame:
    """alias, key: normalised names and aliases; the first term, and in it the first name, wins.

    ``with_key`` adds the registry key itself, as lint and publishing do.
    """
    norm = link_key_ascii if ascii_only else link_key_unicode
    fields = ([F.col("key")] if with_key else []) + [F.col(n) for n in names]
    every = F.concat(F.array(*fields), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = terms.select("key", ordinal, F.posexplode(every).alias("pos", "name"))
    rows = rows.select("key", ordinal, "pos", norm("name").alias("alias")).where("alias <> ''")
    return first_wins(rows, ["alias"], ordinal, "pos").select("alias", "key")


def resolve_links(links: DataFrame, target: str, pids: DataFrame, aliases: DataFrame, ordinal: str | None = None) -> DataFrame:
    """links with kind (nav, paper, term, text) and ref: the first lookup that succeeds.

    Of papers with one pid the last by ``ordinal`` is meant (without it, by slug).
    """
    t = F.trim(text(target))
    base = links.withColumns({"_pid": t, "_alias": link_key_unicode(target)})
    p = first_wins(pids.select(F.col("pid").alias("_pid"), F.col("slug").alias("_slug"), F.col(ordinal or "slug").alias("_ord")), ["_pid"], F.desc("_ord"), F.desc("_slug")).drop("_ord")
    a = aliases.select(F.col("alias").alias("_alias"), F.col("key").alias("_key"))
    both = base.join(p, "_pid", "left").join(a, "_alias", "left")
    kind = F.when(t.startswith("_"), "nav").when(F.col("_slug").isNotNull(), "paper").when(F.col("_key").isNotNull(), "term").otherwise("text")
    return both.withColumn("kind", kind).withColumn("ref", F.when(F.col("kind") == "paper", F.col("_slug")).when(F.col("kind") == "term", F.col("_key"))).drop("_pid", "_alias", "_slug", "_key")


# Fixed suffixes of the files that belong to one paper.
CLUSTER_SUFFIXES = (".正文", ".notes", ".images", ".我的笔记", ".pdf", ".txt")


def cluster_base(target: Column | str) -> Column:
    """A target without the first of the suffixes that stands in it, and what follows."""
    out = c(target)
    for s in reversed(CLUSTER_SUFFIXES):
        out = F.when(c(target).contains(s), F.substring_index(c(target), s, 1)).otherwise(out)
    return out


def dangling(pages: DataFrame, id_: str, targets: Column, known: DataFrame, name: str, preview: int = 6, aliases: DataFrame | None = None) -> DataFrame:
    """id, n, preview: distinct targets whose paper is unknown and that no alias (column alias) names, the first few in order; blank ones and ``_x`` are exempt."""
    links = pages.select(id_, F.explode(F.array_distinct(targets)).alias("target")).where((F.col("target") != "") & ~F.col("target").startswith("_"))
    lost = links.withColumn("_base", cluster_base("target")).join(known.select(F.col(name).alias("_base")).distinct(), "_base", "left_anti")
    if aliases is not None:
        lost = lost.withColumn("alias", link_key_unicode("target")).join(aliases.select("alias").distinct(), "alias", "left_anti")
    return lost.groupBy(id_).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("target")), 1, preview).alias("preview"))


def delink(md: Column | str, known: Column) -> Column:
    """Links whose target isn't in the array become their label or target."""
    parts = F.regexp_extract_all(text(md), F.lit(r"(?<!\!)(\[\[[^\]]+\]\])"))

    def step(t, link):
        target = F.trim(F.regexp_extract(link, r"\[\[([^\]|]+)", 1))
        label = F.regexp_extract(link, r"\|([^\]]*)\]\]", 1)
        return F.when(F.array_contains(known, target), t).otherwise(F.replace(t, link, F.when(label != "", label).otherwise(target)))

    return F.aggregate(F.array_distinct(parts), text(md), step)


def rewrite_embeds(md: Column | str, images_url: str) -> Column:
    """``![[x|opts]]`` -> ``![x](url/x)``; spaces are encoded."""
    parts = F.array_distinct(F.regexp_extract_all(text(md), F.lit(r"(!\[\[[^\]]+\]\])")))

    def step(t, e):
        name = F.trim(F.regexp_extract(e, r"!\[\[([^\]|]+)", 1))
        url = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
        return F.replace(t, e, F.concat(F.lit("!["), name, F.lit(f"]({images_url}/"), url, F.lit(")")))

    return F.aggregate(parts, text(md), step)


def duplicate_papers(candidates: DataFrame, catalog: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Candidates (index, doi) that are in the library, with the pid they have there.

    An index file that exists (a path in ``existing``) names its own pid; else the
    first paper of that DOI with an index is meant, DOIs compared without case and
    without ``https://doi.org/``.
    """
    key = lambda x: sub(F.lower(F.trim(text(x))), r"^https://doi\.org/")
    known = catalog.select(key("doi").alias("_d"), "pid").where("_d <> ''").groupBy("_d").agg(F.min("pid").alias("_pid"))
    out = candidates.withColumn("_d", key("doi")).join(known, "_d", "left")
    if existing is not None:
        own = existing.select(F.col("path").alias("index"), F.lit(True).alias("_own")).distinct()
        stem = F.regexp_replace(F.element_at(F.split("index", "/"), -1), r"\.[^.]*$", "")
        out = out.join(own, "index", "left").withColumn("_pid", F.when(F.col("_own"), stem).otherwise(F.col("_pid"))).drop("_own")
    return out.where("_pid is not null").withColumnRenamed("_pid", "pid" if "pid" not in candidates.columns else "known_pid").drop("_d")


def term_of(names: DataFrame, name: str, aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """names with the term (key) that their normalised name is an alias of."""
    hit = names.withColumn("alias", link_key_ascii(name)).join(aliases.select("alias", "key"), "alias")
    return hit.drop("alias").join(terms, "key")


def cite_tiers(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry of each (author, year): exact, then the year without its letter, then by prefix; the first entry of a tier wins.

    parts: part_id, author, year; entries: n, ord, keys array<string> of ``author|year``.
    Every tier is an equi-join with the first entry of each key, so an author with
    many entries adds no more rows than one with few.
    """
    e = entries.select("n", "ord", F.explode("keys").alias("key")).select("n", "ord", F.substring_index("key", "|", 1).alias("author"), F.substring_index("key", "|", -1).alias("year"))
    first = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct("ord", "n")).alias("_e"))
    exact = first(e, "author", "year")
    # an entry's year begins with a year without letter if it is that year and a letter, or that very year
    prefix = first(e.select("n", "ord", "author", F.explode(F.array_distinct(F.array("year", sub(F.col("year"), "[a-z]$")))).alias("base")), "author", "base")
    p = parts.withColumn("base", sub(F.col("year"), "[a-z]$"))
    hits = p.join(exact.withColumnRenamed("_e", "_1"), ["author", "year"], "left")
    hits = hits.join(exact.select("author", F.col("year").alias("base"), F.col("_e").alias("_2")), ["author", "base"], "left")
    hits = hits.join(prefix.withColumnRenamed("_e", "_3"), ["author", "base"], "left")
    tier = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_3").isNotNull(), 3)
    return hits.select("part_id", F.coalesce("_1.n", "_2.n", "_3.n").alias("n"), tier.alias("tier")).where("tier is not null")


def wiki_anchor(entries: Column) -> Column:
    """Entries (n, label) -> joined anchors."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("[[#^ref-"), e["n"], F.lit("|"), e["label"], F.lit("]]"))), ",")


def images_owner(name: Column | str) -> Column:
    """The paper that an image of another paper's folder belongs to."""
    return F.regexp_extract(c(name), r"^(.+?)_page\d+", 1)
