"""Catalogue building: frontmatter, papers, topic documents, terms, images.

Frontmatter is a map of arrays: a scalar is an array of one, an empty value an
empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import CJK, blank_to_null, c, first_of, sub, text, url_encode_path
from foliant.sources import files

PARTS = (".正文.md", ".md", ".notes.md", ".pdf", ".txt")


def _unquote(x: Column) -> Column:
    return sub(F.trim(x), r"""^["'](.*)["']$""", "$1")


def frontmatter(x: Column | str) -> Column:
    """map<string, array<string>> of the leading ``---`` block.

    ``key: value`` opens a key, ``  - item`` adds to the last one; lines that are
    neither are ignored; a key that comes again replaces the one before.
    """
    block = F.regexp_extract(text(x), r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    keyed = r"^([A-Za-z_\p{L}][\w\p{L}-]*):[ \t]*(.*)$"
    item = r"^\s+-\s+(.*)$"

    def values(v: Column) -> Column:
        inner = F.transform(F.split(F.regexp_extract(v, r"^\[(.*)\]$", 1), ","), _unquote)
        return F.when(v == "", F.array().cast("array<string>")).when(F.regexp_like(v, F.lit(r"^\[.*\]$")), F.filter(inner, lambda s: s != "")).otherwise(F.array(_unquote(v)))

    def step(acc: Column, line: Column) -> Column:
        key = F.regexp_extract(line, keyed, 1)
        add = F.regexp_extract(line, item, 1)
        fresh = F.map_concat(F.map_filter(acc["m"], lambda k, v: k != key), F.create_map(key, values(F.trim(F.regexp_extract(line, keyed, 2)))))
        grown = F.transform_values(acc["m"], lambda k, v: F.when(k == acc["k"], F.array_append(v, _unquote(add))).otherwise(v))
        return F.struct(
            F.when(key != "", key).otherwise(acc["k"]).alias("k"),
            F.when(key != "", fresh).when((add != "") & (acc["k"] != ""), grown).otherwise(acc["m"]).alias("m"),
        )

    zero = F.struct(F.lit("").alias("k"), F.expr("cast(map() as map<string,array<string>>)").alias("m"))
    return F.aggregate(F.split(block, r"\r?\n"), zero, step, lambda a: a["m"])


def field(fm: Column | str, key: str) -> Column:
    """A scalar of the frontmatter, else the empty string."""
    return F.coalesce(F.get(F.element_at(c(fm), F.lit(key)), F.lit(0)), F.lit(""))


def fields(fm: Column | str, key: str) -> Column:
    """A list of the frontmatter: trimmed, non-blank; one scalar may hold commas."""
    v = F.coalesce(F.element_at(c(fm), F.lit(key)), F.array().cast("array<string>"))
    parts = F.flatten(F.transform(v, lambda s: F.when(F.size(v) == 1, F.split(s, "[,，]")).otherwise(F.array(s))))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def plain_frontmatter(x: Column | str) -> Column:
    """The lint's own reading: (fm, body), cut at the first two ``---``."""
    parts = F.split(text(x), "---", 3)
    ok = text(x).startswith("---") & (F.size(parts) == 3)
    return F.struct(F.when(ok, parts[1]).otherwise("").alias("fm"), F.when(ok, parts[2]).otherwise(text(x)).alias("body"))


def slug(citekey: Column | str, pid: Column | str) -> Column:
    """The citation key in lower case with dashes, else the ASCII part of the pid, else ``paper``."""
    key = sub(sub(F.lower(F.trim(text(citekey))), r"[^a-z0-9-]+", "-"), r"^-+|-+$")
    own = F.lower(sub(sub(text(pid), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$"))
    return F.when(F.trim(text(citekey)) != "", key).otherwise(F.coalesce(blank_to_null(own), F.lit("paper")))


# Fixed words of kinds, and values of reading states, statuses and visibilities.


def infer_kind(tags: Column, domain: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", tags, domain))
    has = lambda *ws: F.regexp_like(hay, F.lit("|".join(ws)))
    return F.when(has("综述", "review"), "review").when(has("实验", "experiment"), "experiment").otherwise("method")


def infer_status(reading: Column, status: Column) -> Column:
    """(status, visibility) by the first rule that fits."""
    pair = lambda s, v: F.struct(F.lit(s).alias("status"), F.lit(v).alias("visibility"))
    return (
        F.when(reading.isin("在读", "精读中"), pair("reading", "private"))
        .when((reading == "写笔记") | status.isin("notes", "skeleton"), pair("notes", "private"))
        .when(reading.isin("已读", "重读") | status.isin("analyzed", "ready"), pair("ready", "shared"))
        .when(status == "shared", pair("shared", "shared"))
        .otherwise(pair("reading", "private"))
    )


# Fixed spellings of the two languages, and names of cover images in order of preference.
ZH, EN = ("zh", "cn", "zh-cn"), ("en", "eng")
COVERS = ("page1_fig3", "page1_fig2", "page3_fig1", "page1_fig1")
DEFAULT_COVER = "/assets/images/cover/cover-1.webp"


def infer_lang(lang: Column, title: Column, title_en: Column) -> Column:
    """zh or en: as stated, else zh for a Chinese title without another one."""
    stated = F.lower(F.trim(text(lang)))
    cjk = F.regexp_like(text(title), F.lit(f"[{CJK}]"))
    same = (F.trim(text(title_en)) == "") | (F.trim(text(title_en)) == text(title))
    return F.when(stated.isin(*ZH), "zh").when(stated.isin(*EN), "en").when(cjk & same, "zh").otherwise("en")


def is_chinese(lang: Column, title: Column, title_en: Column) -> Column:
    """The reader's rule: only zh and en are stated languages."""
    a, b = F.trim(text(title)), F.trim(text(title_en))
    guess = F.regexp_like(a, F.lit(f"[{CJK}]")) & ((b == "") | (b == a))
    return F.when(lang == "zh", True).when(lang == "en", False).otherwise(guess)


def titles(title: Column, title_en: Column, lang: Column) -> Column:
    """(primary, secondary) by the wanted language (en…, else Chinese first); no secondary if it is missing or the same."""
    zh, en = F.trim(text(title)), F.trim(text(title_en))
    pair = lambda a, b: F.struct(a.alias("primary"), b.alias("secondary"))
    same = (zh == "") | (en == "") | (zh == en)
    return F.when(same, pair(F.when(zh == "", en).otherwise(zh), F.lit(""))).when(F.lower(text(lang)).startswith("en"), pair(en, zh)).otherwise(pair(zh, en))


def score(x: Column | str) -> Column:
    return sub(text(x), r"/10$")


def pick_cover(images: Column, default: str = DEFAULT_COVER, prefer: tuple[str, ...] = COVERS) -> Column:
    """The first image whose name holds a preferred part, parts in order; else the first; else the default."""
    named = [_first_named(images, part) for part in prefer]
    return F.coalesce(*named, F.get(images, F.lit(0))["url"], F.lit(default))


def _first_named(images: Column, part: str) -> Column:
    return F.get(F.filter(images, lambda i: F.contains(i["name"], F.lit(part))), F.lit(0))["url"]


def fallback_caption(name: Column | str) -> Column:
    """``第 3 页 · 图 A.2`` from the page and figure in an image's name, else the name."""
    page, letter, number = (F.regexp_extract(c(name), r"(?i)_page(\d+)_fig([A-Za-z])?(\d+)", k) for k in (1, 2, 3))
    tag = F.concat(F.when(letter != "", F.concat(F.upper(letter), F.lit("."))).otherwise(""), number.try_cast("int").cast("string"))
    return F.when(page != "", F.concat(F.lit("第 "), page.try_cast("int").cast("string"), F.lit(" 页 · 图 "), tag)).otherwise(c(name))


def public_url(slug_: Column, rel: Column) -> Column:
    return F.concat(F.lit("/vault/papers/"), slug_, F.lit("/"), url_encode_path(rel))


def mime(path: Column | str) -> Column:
    """MIME type by extension."""
    table = {"html": "text/html", "js": "text/javascript", "css": "text/css", "json": "application/json", "md": "text/markdown", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf"}
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(F.regexp_extract(c(path), r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def papers(spark: SparkSession, vault: str) -> DataFrame:
    """One row per index file below Papers/ whose paper has a folder with its parts, newest first."""
    t = files.texts(spark, f"{vault}/Papers").withColumn("fm", frontmatter("text"))
    index = t.where(field("fm", "noteType") == "index")
    folders = clusters(files.listing(spark, f"{vault}/Papers"))
    pid = first_of(field("fm", "pid"), "stem")
    p = index.select("path", "stem", "fm", "text", pid.alias("pid")).join(folders, "pid")
    state = infer_status(field("fm", "reading"), field("fm", "status"))
    tags = fields("fm", "tags")
    out = p.select(
        "pid",
        slug(field("fm", "citekey"), "pid").alias("slug"),
        first_of(field("fm", "translatedTitle"), field("fm", "title"), "pid").alias("title"),
        field("fm", "title").alias("titleEn"),
        fields("fm", "authors").alias("authorList"),
        F.coalesce(F.regexp_extract(field("fm", "year"), r"(\d{4})", 1).try_cast("int"), F.lit(0)).alias("year"),
        *[field("fm", k).alias(k) for k in ("venue", "doi", "citekey", "domain", "reading")],
        tags.alias("tags"),
        infer_kind(tags, field("fm", "domain")).alias("kind"),
        infer_lang(field("fm", "lang"), first_of(field("fm", "translatedTitle"), field("fm", "title")), field("fm", "title")).alias("lang"),
        state["status"].alias("status"),
        state["visibility"].alias("visibility"),
        score(field("fm", "qualityScore")).alias("qualityScore"),
        first_of(field("fm", "updatedAt"), field("fm", "updated")).alias("updatedAt"),
        "folder",
        "parts",
        F.array_contains("parts", ".pdf").alias("hasPdf"),
        F.array_contains("parts", ".notes.md").alias("hasNotes"),
        F.array_contains("parts", ".txt").alias("hasTxt"),
        F.array_contains("parts", ".正文.md").alias("hasTranslation"),
        F.concat_ws(" ", "pid").alias("id"),
    )
    return out.orderBy(F.desc("year"), F.desc("id"))


def clusters(listing: DataFrame) -> DataFrame:
    """pid, folder, parts: the folder whose content/ holds a paper's files; a folder of the paper's own name first, then by name."""
    f = listing.select(F.regexp_extract(F.url_decode("path"), r"^(.*)/content/[^/]+$", 1).alias("folder"), "name").where("folder <> ''")
    ends = F.array(*[F.struct(F.lit(s).alias("part"), F.lit(len(s)).alias("n")) for s in PARTS])
    fit = F.get(F.filter(ends, lambda e: F.col("name").endswith(e["part"])), F.lit(0))
    f = f.withColumn("e", fit).where("e is not null").select("folder", F.expr("substring(name, 1, length(name) - e.n)").alias("pid"), "e.part")
    g = f.groupBy("pid", "folder").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    exact = F.col("folder").endswith(F.concat(F.lit("/"), F.col("pid")))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("pid").orderBy(exact.desc(), "folder"))).where("_r = 1").drop("_r")


def topic_docs(spark: SparkSession, vault: str) -> DataFrame:
    """slug, title, docType, domain, updatedAt, papers, file; documents without a slug are numbered in path order."""
    t = files.texts(spark, f"{vault}/Topics").withColumn("fm", frontmatter("text"))
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path"))
    parent = F.regexp_extract(F.url_decode("path"), r"/Topics/(?:.*/)?([^/]+)/[^/]+$", 1)
    t = t.withColumns({"_n": n, "_parent": parent})
    return t.select(
        first_of(field("fm", "slug"), F.concat(F.lit("topic-"), F.col("_n").cast("string"))).alias("slug"),
        first_of(field("fm", "translatedTitle"), field("fm", "title"), "stem").alias("title"),
        field("fm", "docType").alias("docType"),
        first_of(field("fm", "domain"), "_parent").alias("domain"),
        field("fm", "updatedAt").alias("updatedAt"),
        fields("fm", "papers").alias("papers"),
        F.col("path").alias("file"),
    ).orderBy(F.desc("updatedAt"), "file")


TERM = "term string, zhName string, fullName string, aliases array<string>, type string, domain array<string>, definition string, note string, usages array<struct<paper:string,context:string>>"


def terms(registry: DataFrame) -> DataFrame:
    """Rows of the registry (a JSON object, key -> entry) by lower-case term; a scalar domain is a list of one."""
    lists = sub("value", r'"domain"\s*:\s*("(?:[^"\\]|\\.)*")', '"domain":[$1]')
    rows = registry.select(F.explode(F.from_json(lists, entries_type())).alias("key", "e"))
    return rows.select(
        "key",
        first_of("e.term", "key").alias("term"),
        text("e.zhName").alias("zhName"),
        text("e.fullName").alias("fullName"),
        F.filter(F.coalesce("e.aliases", F.array()), lambda a: F.trim(a) != "").alias("aliases"),
        text("e.type").alias("type"),
        F.coalesce("e.domain", F.array()).alias("domains"),
        text("e.definition").alias("definition"),
        sub(text("e.note"), r"\.md$").alias("noteStem"),
        F.filter(F.coalesce("e.usages", F.array()), lambda u: text(u["paper"]) != "").alias("usages"),
    ).orderBy(F.lower("term"))


def entries_type() -> str:
    return "map<string,struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in TERM.split(", "))) + ">>"


def images(listing: DataFrame, meta: DataFrame) -> DataFrame:
    """name, size, caption, order: the image files with their figures' captions, in figure order, then by name."""
    f = listing.where(F.col("name").rlike(r"(?i)\.(png|jpe?g|gif|webp|svg)$") & ~F.col("name").rlike(r"(?i)\.png\.webp$"))
    both = f.join(meta, "name", "left")
    rank = F.coalesce(F.when(F.col("order") != 0, F.col("order")), F.lit(9999))
    return both.select("name", "size", first_of("caption", fallback_caption("name")).alias("caption"), F.coalesce("order", F.lit(0)).alias("order"), rank.alias("_r")).orderBy("_r", "name").drop("_r")


def with_origin(x: Column | str, origin: str) -> Column:
    """A JSON text with the vault's paths under an origin."""
    return sub(text(x), r'"/vault/', f'"{origin.rstrip("/")}/vault/')

