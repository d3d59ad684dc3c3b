"""Markdown and HTML text: chrome, chips, headings, sections, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import c, chips, heading_slug, squeeze, strip, strip_frontmatter, strip_heading_emoji, sub, text
from foliant.operators import links


# Fixed marks of quote lines that are not part of a text.
CHROME = (r"返回索引：", r".*build_refs\.py", r".*库内已入库", r".*自动生成（条目保持原文", r"🤖")
DOI_CHIP = r"(?i)(?:｜\s*)?\[(?:🔗\s*)?DOI\]\((https?://[^)\s]+)\)"


def strip_chrome(x: Column | str) -> Column:
    """Without frontmatter, comments and the library's own quote lines; DOI chips written out; blank lines collapsed."""
    t = sub(strip_frontmatter(x), r"(?s)<!--.*?-->")
    for mark in CHROME:
        t = sub(t, rf"(?m)^>\s*{mark}.*(?:\n|$)")
    return strip(sub(doi_chips(t), r"\n{3,}", "\n\n"))


def doi_chips(x: Column | str) -> Column:
    """``[🔗 DOI](url)`` as a link that shows the address, or nothing if its line has shown it before."""
    bare = lambda s: F.lower(sub(sub(s, r"(?i)https?://"), r"[\s‐–—-]"))

    def one(acc, chip):
        at = F.instr(acc["rest"], chip)
        before = F.substring(acc["rest"], F.lit(1), at - 1)
        done = F.concat(acc["done"], before)
        url = F.regexp_extract(chip, DOI_CHIP, 1)
        shown = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
        line = bare(F.substring_index(done, "\n", -1))
        new = F.when(F.contains(line, bare(shown)) | F.contains(line, bare(url)), "").otherwise(F.concat(F.lit("["), shown, F.lit("]("), url, F.lit(")")))
        return F.struct(F.concat(done, new).alias("done"), F.substring(acc["rest"], at + F.length(chip), F.length(acc["rest"])).alias("rest"))

    chips_ = F.regexp_extract_all(text(x), F.lit(DOI_CHIP), F.lit(0))
    return F.aggregate(chips_, F.struct(F.lit("").alias("done"), text(x).alias("rest")), one, lambda a: F.concat(a["done"], a["rest"]))


def fix_bold_captions(x: Column | str) -> Column:
    """A space after a bold caption label that text follows directly."""
    return sub(text(x), r"(?m)^(\*\*(?:图|表|Fig\.?|Figure|Table)\s*[A-Z]?\d[^*\n]*\*\*)(?=\S)", "$1 ")


def reorder_sections(x: Column | str, first: str = "深度分析", before: str = "问答") -> Column:
    """The ``# …first…`` block, up to the next H1, moved before the ``## …before…`` heading, if it stands after it."""
    t = text(x)
    head, target = rf"(?m)^#\s+[^\n]*{first}[^\n]*$", rf"(?m)^##\s+[^\n]*{before}[^\n]*$"
    block = F.regexp_extract(t, rf"(?ms)(^#\s+[^\n]*{first}[^\n]*$.*?)(?=^#\s|\z)", 1)
    at, to = F.regexp_instr(t, F.lit(head)), F.regexp_instr(t, F.lit(target))
    rest = F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(block), F.length(t)))
    there = F.regexp_instr(rest, F.lit(target))
    moved = F.concat(F.regexp_replace(F.substring(rest, F.lit(1), there - 1), r"\s+\z", ""), F.lit("\n\n"), F.regexp_replace(block, r"\s+\z", ""), F.lit("\n\n"), F.substring(rest, there, F.length(rest)))
    return F.when((to > 0) & (at > to) & (there > 0), moved).otherwise(t)


def refs_section(x: Column | str) -> Column:
    """The ``## …参考文献…`` section, up to the next H2."""
    return F.regexp_extract(text(x), r"(?ms)(^##\s+[^\n]*参考文献[^\n]*$.*?)(?=\n##\s+|\z)", 1)


def preprocess(x: Column | str, images_url: str) -> Column:
    """Chrome off, captions spaced, DOI chips and embeds as links."""
    return links.rewrite_embeds(fix_bold_captions(strip_chrome(x)), images_url)


def copy_markdown(x: Column | str, images_url: str) -> Column:
    """Plain Markdown to copy: links as their text, anchors off."""
    t = sub(preprocess(x, images_url), r"(?<!\!)\[\[[^\]|]*\|([^\]]*)\]\]", "$1")
    return sub(sub(t, r"(?<!\!)\[\[([^\]|]*)\]\]", "$1"), r"\s*\^ref-\d+")


def html_headings(html: Column | str) -> Column:
    """array<struct<id, text, level>> of the h2 and h3, tags and emoji stripped."""
    tags = F.regexp_extract_all(text(html), F.lit(r"(?is)(<h[23][^>]*>.*?</h[23]>)"))
    def one(t, i):
        body = strip_heading_emoji(sub(t, r"<[^>]+>"))
        return F.struct(heading_slug(body, i).alias("id"), body.alias("text"), F.regexp_extract(t, r"(?i)<h([23])", 1).cast("int").alias("level"))

    return F.transform(tags, one)


def inject_ids(html: Column | str) -> Column:
    """Each h2 and h3 with the id of its place."""
    pieces = F.split(text(html), r"(?i)(?=<h[23][\s>])")
    heads = html_headings(html)
    before = F.when(F.regexp_like(F.get(pieces, F.lit(0)), F.lit(r"(?i)\A<h[23][\s>]")), 0).otherwise(1)

    def one(p, i):
        h = F.get(heads, i - before)
        return F.when((i < before) | h.isNull(), p).otherwise(F.concat(F.regexp_extract(p, r"(?i)\A(<h[23])", 1), F.lit(' id="'), h["id"], F.lit('"'), F.regexp_extract(p, r"(?is)\A<h[23](.*)\z", 1)))

    return F.array_join(F.transform(pieces, one), "")


def markdown_headings(docs: DataFrame, id_: str, column: str = "text") -> DataFrame:
    """id, line_no, level, title."""
    ls = docs.select(id_, F.posexplode(F.split(text(column), r"\r?\n")).alias("line_no", "line"))
    h = r"^(#{1,6})\s+(.+?)\s*$"
    return ls.where(F.col("line").rlike(h)).select(id_, "line_no", F.length(F.regexp_extract("line", h, 1)).alias("level"), F.regexp_extract("line", h, 2).alias("title"))


def section_html(html: Column | str, title: str) -> Column:
    """Inner HTML from the heading with that text to the next h2."""
    return F.trim(F.regexp_extract(text(html), rf"(?is)<h2[^>]*>\s*(?:<[^>]+>)*[^<]*{title}[^<]*(?:<[^>]+>)*\s*</h2>(.*?)(?=<h2|\z)", 1))


def highlights(html: Column | str) -> Column:
    """(body, ai): the highlights section and whether it says that a machine wrote it."""
    body = section_html(html, "(?:Highlights|亮点|要点)")
    return F.struct(body.alias("body"), F.regexp_like(body, F.lit(r"(?i)AI|模型生成")).alias("ai"))


def keywords(x: Column | str) -> Column:
    """Chips of the keyword line."""
    return chips(F.regexp_extract(text(x), r"(?im)^\W*(?:keywords?|关键词)\W*[:：]\W*(.+?)\s*$", 1))


def byline(html: Column | str) -> Column:
    """Author and affiliation lines after the h1, superscripts off."""
    head = F.regexp_extract(text(html), r"(?is)</h1>(.*?)(?=<h2|\z)", 1)
    lines = F.regexp_extract_all(sub(head, r"(?is)<sup>.*?</sup>"), F.lit(r"(?is)<p>(.*?)</p>"))
    return F.transform(F.slice(lines, 1, 2), lambda p: squeeze(sub(p, r"<[^>]+>")))


def moc_target(target: Column | str) -> Column:
    """(url, label) of a ``_x`` navigation target: the terms, the papers, or the papers of that domain."""
    t = strip_heading_emoji(F.trim(sub(text(target), "^_+")))
    link = lambda url, label: F.struct(url.alias("url"), label.alias("label"))
    domain = F.concat(F.lit("/papers?domain="), F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")))
    return F.when(t.contains("术语库"), link(F.lit("/terms"), F.lit("术语库"))).when(t.contains("论文地图"), link(F.lit("/papers"), F.lit("论文库"))).otherwise(link(domain, t))


# Decorators of rendered HTML.


def wrap_tables(html: Column | str) -> Column:
    return sub(text(html), r"(?is)(<table.*?</table>)", '<div class="tbl-wrap">$1</div>')


def wrap_figures(html: Column | str) -> Column:
    """Paragraphs of images and the caption that follows as one figure."""
    cap = r"(?:<(?:strong|em)>\s*)?(?:图|表|Fig|Figure|Table|Graphical)"
    group = sub(text(html), rf"(?is)((?:<p>\s*(?:<img[^>]*>\s*)+</p>\s*)+)<p>({cap}.*?)</p>", '<figure class="md-fig">$1<figcaption>$2</figcaption></figure>')
    single = sub(group, rf"(?is)<p>\s*((?:<img[^>]*>\s*)+?)\s*({cap}.*?)</p>", '<figure class="md-fig">$1<figcaption>$2</figcaption></figure>')
    # paragraph marks are not kept inside a figure's images
    figs = F.array_distinct(F.regexp_extract_all(single, F.lit(r'(?is)(<figure class="md-fig">.*?<figcaption>)')))
    return F.aggregate(figs, single, lambda t, f: F.replace(t, f, sub(sub(sub(f, r"(?i)</?p>"), r'(?<=<figure class="md-fig">)\s+'), r"\s+(?=<figcaption>)")))


def wrap_notes(html: Column | str) -> Column:
    """Quotes that begin a note (【说明】) as note cards; a quote is never joined with another."""
    quotes = F.array_distinct(F.regexp_extract_all(text(html), F.lit(r"(?is)(<blockquote>\s*<p>(?:(?!</?blockquote>).)*?【说明】(?:(?!</?blockquote>).)*?</blockquote>)")))

    def card(q):
        inner = sub(sub(q, r"(?i)^<blockquote>|</blockquote>$"), r"<strong>\s*【说明】\s*</strong>\s*")
        return F.concat(F.lit('<aside class="formula-note"><div class="formula-note-title">说明</div>'), sub(inner, r"【说明】\s*"), F.lit("</aside>"))

    return F.aggregate(quotes, text(html), lambda t, q: F.replace(t, q, card(q)))


def ref_anchors(html: Column | str) -> Column:
    """List items that carry ``\\uE200N\\uE201`` with the first number as their id, the others as aliases."""
    mark = "\ue200(\\d+)\ue201"
    items = F.array_distinct(F.filter(F.regexp_extract_all(text(html), F.lit(r"(?is)(<li>.*?</li>)")), lambda i: F.regexp_like(i, F.lit(mark))))

    def anchored(i):
        ids = F.array_distinct(F.regexp_extract_all(i, F.lit(mark)))
        inner = F.trim(sub(sub(i, r"(?i)^<li>|</li>$"), mark))
        aliases = F.array_join(F.transform(F.slice(ids, 2, 1000), lambda n: F.concat(F.lit('<span id="ref-'), n, F.lit('"></span>'))), "")
        return F.concat(F.lit('<li id="ref-'), ids[0], F.lit('" class="paper-ref">'), aliases, inner, F.lit("</li>"))

    return F.aggregate(items, text(html), lambda t, i: F.replace(t, i, anchored(i)))


def plain_headings(html: Column | str) -> Column:
    """Headings without emoji, an H1 without its version suffix."""
    heads = F.array_distinct(F.regexp_extract_all(text(html), F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)")))

    def clean(h):
        open_, close = F.regexp_extract(h, r"(?is)^(<h[1-6][^>]*>)", 1), F.regexp_extract(h, r"(?i)(</h[1-6]>)$", 1)
        inner = strip_heading_emoji(F.regexp_extract(h, r"(?is)^<h[1-6][^>]*>(.*)</h[1-6]>$", 1))
        short = F.trim(sub(inner, r"（(?:中文翻译|方法原理精讲)）\s*$|\((?:中文翻译|方法原理精讲)\)\s*$"))
        return F.concat(open_, F.when(F.lower(open_).startswith("<h1"), short).otherwise(inner), close)

    return F.aggregate(heads, text(html), lambda t, h: F.replace(t, h, clean(h)))


def reader_href(slug: Column, tab: Column, split: Column) -> Column:
    """The reader's address; the default tab and empty parts are left out."""
    q = F.concat_ws("&", F.when((text(tab) != "") & (tab != "article"), F.concat(F.lit("tab="), tab)), F.when(text(split) != "", F.concat(F.lit("split="), split)))
    return F.concat(F.lit("/reader/"), slug, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def compare_href(left: Column, right: Column, tab: Column) -> Column:
    same = (text(right) == "") | (right == left)
    return reader_href(left, tab, F.when(~same, right))


def short_title(x: Column | str, n: int = 16) -> Column:
    t = squeeze(text(x))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def is_http(x: Column | str) -> Column:
    return F.regexp_like(c(x), F.lit(r"(?i)^https?://"))


def word_shape(x: Column | str) -> Column:
    return F.regexp_like(c(x), F.lit(r"^[A-Za-z][A-Za-z'’-]{1,40}$"))
