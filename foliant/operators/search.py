"""Faceted search over a catalogue of papers, terms or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import c, search_text, strip, sub, text


def haystack(*fields: Column | str) -> Column:
    """The search document: non-blank fields joined and normalised."""
    return search_text(F.concat_ws(" ", *[F.when(text(f) != "", c(f)) for f in fields]))


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query, normalised as the haystack is."""
    import re

    return list(dict.fromkeys(re.sub(r"[/\-_·,，。：:；;]+", " ", query.lower()).split()))


def all_tokens(hay: Column | str, query: str) -> Column:
    """Whether every token is a substring; an empty query matches all."""
    cond = F.lit(True)
    for t in query_tokens(query):
        cond = cond & F.contains(c(hay), F.lit(t))
    return cond


def domain_matches(domain: Column | str, wanted: str) -> Column:
    """Blank or ``all`` matches; else equal, below, or a segment of the path."""
    if wanted in ("", "all"):
        return F.lit(True)
    d = text(domain)
    return (d == wanted) | d.startswith(wanted + "/") | F.array_contains(F.split(d, "/"), wanted)


def topic_matches(domain: Column | str, wanted: str) -> Column:
    """Documents for a domain, either way round; blank documents fit any, blank wishes none."""
    if wanted in ("", "all"):
        return F.lit(False)
    d = text(domain)
    up = F.lit(wanted).startswith(F.concat(d, F.lit("/"))) | F.array_contains(F.split(F.lit(wanted), "/"), d)
    return (d == "") | domain_matches(d, wanted) | up


def major(domain: Column | str) -> Column:
    return F.get(F.split(text(domain), "/"), F.lit(0))


# Fixed marks: reading states, then the star and the two citation states.
READING = ("在读", "已读", "重读")
STAR, TO_CITE, CITED = "重点", "待引用", "已引用"


def has_mark(mark: str) -> Column:
    """Rows whose marks fit: flags struct<reading, starred, cite, cited> are the reader's, column reading is the library's."""
    reading = F.coalesce(F.when(text("flags.reading") != "", F.col("flags.reading")), F.when(F.col("reading").isin(*READING), F.col("reading")), F.lit(""))
    cite = F.coalesce(F.when(text("flags.cite") != "", F.col("flags.cite")), F.when(F.col("flags.cited"), CITED), F.lit(""))
    if mark == STAR:
        return F.coalesce(F.col("flags.starred"), F.lit(False))
    return cite == mark if mark in (TO_CITE, CITED) else reading == mark


def filter_papers(papers: DataFrame, query: str = "", status: str = "", visibility: str = "", kind: str = "", domain: str = "", mark: str = "", hay: str = "haystack") -> DataFrame:
    """Conjunctive facets, a mark (see ``has_mark``) and all tokens of the query; blank and ``all`` choose nothing."""
    cond = all_tokens(hay, query)
    if domain:
        cond = cond & domain_matches("domain", domain)
    for name, want in (("status", status), ("visibility", visibility), ("kind", kind)):
        if want and want != "all":
            cond = cond & (F.col(name) == want)
    if mark and mark != "all":
        cond = cond & has_mark(mark)
    return papers.where(cond)


def of_topic(papers: DataFrame, pids: list[str]) -> DataFrame:
    """Papers of a topic's list; an empty list leaves them all."""
    return papers.where(F.col("pid").isin(*pids)) if pids else papers


def filter_terms(terms: DataFrame, query: str, type_: str = "", domain: str = "") -> DataFrame:
    """One substring over the term's texts, and the facets."""
    hay = F.lower(F.concat_ws(" ", "term", "zhName", "fullName", "definition", F.array_join("aliases", " ")))
    return terms.where(F.contains(hay, F.lit(query.strip().lower())) & term_facets(type_, domain))


def first_matches(found: DataFrame, *order: Column | str, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """The first matches in order, each executor keeping its own first ones, and whether there are more (one row: n, more)."""
    return found.orderBy(*order).limit(most), found.agg(F.count("*").alias("n"), (F.count("*") > most).alias("more"))


def term_facets(type_: str = "", domain: str = "") -> Column:
    cond = F.lit(True)
    if type_ and type_ != "all":
        cond = cond & (F.col("type") == type_)
    if domain and domain != "all":
        cond = cond & F.exists("domains", lambda d: F.split(d, "/")[0] == domain)
    return cond


def facet_counts(hits: DataFrame, facets: dict[str, Column], chosen: dict[str, Column]) -> DataFrame:
    """facet, value, n: counts of each facet under the other facets' choices.

    ``hits`` are the rows that match the query, ``facets`` the value (or array of
    values, counted once a row) of each facet, ``chosen`` the conditions of the
    facets that have a choice.  One pass: every row is exploded to the facets
    whose other choices it meets, then counted.
    """
    entries = []
    for name, value in facets.items():
        cond = F.lit(True)
        for other, choice in chosen.items():
            if other != name:
                cond = cond & choice
        values = F.array_distinct(value) if hits.select(value.alias("v")).schema["v"].dataType.typeName() == "array" else F.array(value.cast("string"))
        entries.append(F.when(cond, values.cast("array<string>")).otherwise(F.array().cast("array<string>")))
    pairs = F.concat(*[_tagged(name, e) for name, e in zip(facets, entries, strict=True)])
    return hits.select(F.explode(pairs).alias("p")).groupBy(F.col("p.facet").alias("facet"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def _tagged(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))


def stats(papers: DataFrame) -> DataFrame:
    """Seven counts in one pass."""
    return papers.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "reading").alias("reading"),
        F.count_if(F.col("status") == "notes").alias("notes"),
        F.count_if(F.col("visibility") == "shared").alias("shared"),
        F.count_if(F.col("hasTranslation")).alias("with_translation"),
        F.count_if(F.col("hasNotes")).alias("with_analysis"),
        F.count_if(F.col("hasPdf")).alias("with_pdf"),
    )


def domain_rollup(rows: DataFrame, domain: str) -> DataFrame:
    """value, level, n: counts of the first segment, and of the whole path where it differs; blanks skipped."""
    d = F.col(domain)
    levels = F.array_distinct(F.array(F.struct(F.lit(1).alias("level"), major(d).alias("value")), F.struct(F.when(d.contains("/"), 2).otherwise(1).alias("level"), d.alias("value"))))
    return rows.where(text(d) != "").select(F.explode(levels).alias("x")).groupBy("x.value", "x.level").agg(F.count("*").alias("n"))


def topic_series(rows: DataFrame, *labels: str, other: str = "未分类", locale: str | None = "zh") -> DataFrame:
    """label, n by the first segment of the first non-blank label; most first, ties in the locale's order."""
    label = major(F.coalesce(*[F.when(text(x) != "", F.col(x)) for x in labels], F.lit(other)))
    out = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.collate("label", locale) if locale else "label")


def domain_key(domain: str, topic: str | None = None, other: str = "未分类") -> list[Column]:
    """major, sub: the first segment and the rest of the domain, else of the topic, else ``other``."""
    raw = F.coalesce(*[F.when(text(x) != "", F.col(x)) for x in (domain, topic) if x], F.lit(other))
    parts = F.split(raw, "/")
    return [F.get(parts, F.lit(0)).alias("major"), F.array_join(F.slice(parts, 2, 1000), "/").alias("sub")]


def grouped(rows: DataFrame, domain: str, order: list[Column], fields: list[str], topic: str | None = None, locale: str = "zh") -> DataFrame:
    """major, sub, members: rows under their domain, in order.  Members of one domain are one array: for a library's catalogue; ``group_sizes`` is for many rows."""
    items = F.array_sort(F.collect_list(F.struct(*order, *fields)))
    return rows.groupBy(*domain_key(domain, topic)).agg(items.alias("members")).orderBy(F.collate("major", locale), F.collate("sub", locale))


def ranked_members(rows: DataFrame, domain: str, *order: Column) -> DataFrame:
    """rows with rank: their place among the rows of their domain.  Needs no array of members."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(domain).orderBy(*order)))


def group_sizes(rows: DataFrame, domain: str, first: str) -> DataFrame:
    """major, sub, n, first: the size and the first member of each domain, without its members."""
    return rows.groupBy(*domain_key(domain)).agg(F.count("*").alias("n"), F.min(first).alias("first"))


def filter_blocks(texts: DataFrame, query: str, column: str = "text", pattern: str = r"(?m)(?=^#{1,6}\s)|\n{2,}") -> DataFrame:
    """texts with blocks (joined) and hits: the blocks that contain the query; a blank query leaves the text, with no hits."""
    q = query.strip().lower()
    if not q:
        return texts.withColumns({"blocks": text(column), "hits": F.lit(0)})
    blocks = F.filter(F.transform(F.split(text(column), pattern), strip), lambda b: (b != "") & F.contains(F.lower(b), F.lit(q)))
    return texts.withColumns({"blocks": F.array_join(blocks, "\n\n"), "hits": F.size(blocks)})


def display_tags(tags: Column | str, prefix: str = "主题/") -> Column:
    """Tags without the prefix; blank ones and paths dropped, distinct in order."""
    return F.array_distinct(F.filter(card_tags(tags, prefix), lambda t: (t != "") & ~t.contains("/")))


def card_tags(tags: Column | str, prefix: str = "主题/") -> Column:
    return F.transform(c(tags), lambda t: sub(t, f"^{prefix}"))


def short_authors(authors: Column | str) -> Column:
    a = c(authors)
    return F.when(F.size(a) > 1, F.concat(F.get(a, F.lit(0)), F.lit(" et al."))).otherwise(F.coalesce(F.get(a, F.lit(0)), F.lit("")))
