"""Checks of whole works: sealed derivations of the documents, and one report of all rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import report, seals
from foliant.plans.catalog_queries import t
from foliant.plans.registry import query

#: Each document is a paper; its text is reviewed, locked, "translated" (its letters d to f in capitals)
#: and put together, and then one thing in eight changes, by doc_id.
CHANGES = ("source", "layout", "token", "supplement", "figure", "output", "note", "nothing")


@query(
    "sealed_derivations",
    """with p as (select doc_id, doc_id % 8 as k, '# Paper ' || doc_id || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || translate(replace(replace(coalesce(text, ''), '$', '\\$'), '`', chr(39)), '|[~#', ':(-=') as s from documents)
select doc_id, k <> 6 as sealed, case k when 0 then 'source_changed,prepared_differs,output_differs' when 1 then 'layout_changed,output_differs' when 2 then 'token,output_differs' when 3 then 'supplement_place,output_differs' when 4 then 'figure:1:review,output_differs' when 5 then 'output_differs' else '' end as errors,
case when k in (0, 1) then 'review,prepare,merge,output' when k = 4 then 'prepare,merge,output' when k in (2, 3) then 'merge,output' when k = 5 then 'output' else '' end as void,
case when k in (5, 7) then sha256(regexp_replace(translate(s, 'def', 'DEF'), '^# Paper (.*)', '# Paper \\1')) end as digest
from p""",
)
def sealed_derivations(spark, d):
    k, lf = F.col("doc_id") % 8, "\n\n"
    plain = F.translate(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("$"), F.lit("\\$")), F.lit("`"), F.lit("'")), "|[~#", ":(-=")
    layout = F.lit('{"headings": [{"title": "Abstract", "page": 1}]}')
    papers = t(spark, d, "documents").select(
        "doc_id", F.lit("en").alias("lang"), F.concat(F.lit("# Paper "), F.col("doc_id").cast("string"), F.lit(f"{lf}## Abstract{lf}"), plain).alias("source"),
        layout.alias("layout"), F.lit(2).alias("pages"), F.when(k == 6, " ").otherwise("every page was compared").alias("note"),
    )
    figures = papers.select("doc_id", F.lit("1").alias("num"), F.lit("cut").alias("status"), F.lit(True).alias("reviewed"), F.lit("seen").alias("reviewNote"), F.lit("2024-01-01").alias("reviewedAt"))
    seal = seals.review(papers, "doc_id")
    made = seals.prepare(papers, seal, figures, "doc_id").where("body is not null")
    work = made.select("doc_id", "body", "manifest", F.translate("body", "def", "DEF").alias("locked"), F.lit(None).cast("string").alias("supplement"))
    done = seals.merge(papers, seal, figures, work, "doc_id")
    work = done.select(*work.columns, F.col("text").alias("output"), F.col("prepared_link").alias("made"), F.col("link").alias("joined"))
    # what happens afterwards
    when = lambda name, new, old: F.when(k == CHANGES.index(name), new).otherwise(F.col(old)).alias(old)
    papers = papers.withColumns({"source": when("source", F.concat("source", F.lit(" More.")), "source"), "layout": when("layout", F.concat("layout", F.lit(" ")), "layout")})
    figures = figures.withColumn("reviewed", when("figure", F.lit(False), "reviewed"))
    work = work.withColumns({"locked": when("token", F.regexp_replace("locked", "⟦WS000002⟧", ""), "locked"), "supplement": when("supplement", F.lit("## 亮点\n\n- a\n- b\n- c\n\n>【说明】"), "supplement"), "output": when("output", F.concat("output", F.lit(" ")), "output")})
    found = seals.check_translation(papers, seal, figures, work, "doc_id")
    out = seal.select("doc_id", F.col("seal").isNotNull().alias("sealed")).join(found, "doc_id", "left")
    flat = lambda x: F.coalesce(F.array_join(x, ","), F.lit(""))
    return out.select("doc_id", "sealed", flat("errors").alias("errors"), flat("void").alias("void"), F.sha2("text", 256).alias("digest"))


HEAD, TAIL = "# A study\n\n## Abstract\n\nWhat was measured over the hills.\n\n## 1 Flow\n\n", "\n\n![[a.png]]\n**Fig. 1.** Flow.\n\n$$\nx \\tag{1}\n$$\n"
HAN = "气流越过山丘的测量在各种天气下每天进行两次并且记录完整。"
CHINESE = f"# 一项研究\n\n## 亮点\n\n{HAN}\n\n## 摘要\n\n{HAN}\n\n## 1 流动\n\n{HAN}\n\n![[a.png]]\n**图 1.** 流动。\n\n$$\nx \\tag{{1}}\n$$\n"
BARE = "\n## 2 Bare\n"


@query(
    "work_report",
    """with p as (select doc_id, doc_id % 6 as k, regexp_replace(coalesce(text, ''), '[^A-Za-z \\n]+', ' ', 'g') as b from documents),
q as (select *, case when regexp_matches(b, '(?i)Funding information|This is an open access|\\bK\\sE\\sY\\sW\\sO\\sR\\sD\\sS\\b') then 'en.md:shell' end as shell from p)
select doc_id, k in (0, 2) as ok, case k when 1 then 'en.md:no_figures:1' when 3 then 'en.md:empty_section:2 Bare,zh.md:no_section:2' when 4 then 'en.md:no_equation:1' when 5 then 'en.md:caption_file:1,zh.md:caption_file:1' else '' end as errors,
concat_ws(',', shell, case k when 2 then 'images:unused:b.png' when 4 then 'zh.md:unmatched_equation:1' end) as warnings,
cast(17 + case when k = 3 then 2 else 0 end + length(b) - length(replace(b, chr(10), '')) as bigint) as lines from q""",
)
def work_report(spark, d):
    k, fault = F.col("doc_id") % 6, lambda n, new, old: F.when(F.col("doc_id") % 6 == n, F.lit(new)).otherwise(F.lit(old))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z \n]+", " ")
    tail = F.when(k == 1, TAIL.replace("**Fig. 1.** ", "")).when(k == 3, TAIL + BARE).when(k == 4, TAIL.replace("\\tag{1}", "")).otherwise(TAIL)
    strings = lambda *xs: F.array(*map(F.lit, xs))
    works = t(spark, d, "documents").select(
        "doc_id", F.lit("en").alias("lang"), F.lit("article").alias("kind"), F.concat(F.lit(HEAD), body, tail).alias("en"), F.lit(CHINESE).alias("zh"), F.lit("# 笔记").alias("notes"),
        strings("1").alias("figures"), strings().cast("array<string>").alias("tables"), strings("1").alias("equations"),
        F.when(k == 2, strings("a.png", "b.png")).otherwise(strings("a.png")).alias("images"), F.create_map(F.lit("1"), fault(5, "c.png", "a.png")).alias("files"),
    )
    flat = lambda c: F.array_join(c, ",").alias(c)
    return report.verify(works, "doc_id").select("doc_id", "ok", flat("errors"), flat("warnings"), F.col("counts.lines_en").alias("lines"))


@query(
    "joined_urls",
    r"""with u as (select page_id, coalesce(url, '') as u, regexp_extract(coalesce(url, ''), '(?i)^([a-z][a-z0-9+.-]*://[^/]+)', 1) as o from pages),
j as (select *, regexp_replace(u, '/$', '') || '/Fig ' || (page_id % 7) || case when page_id % 2 = 0 then '.png' else '.svg' end as f from u)
select page_id, o || list_aggregate([url_encode(url_decode(s)) for s in string_split(substr(f, length(o) + 1), '/')], 'string_agg', '/') as url, page_id % 2 = 0 as variant, case when u like 'https://%' and not regexp_matches(u, '(^|/)\.\.(/|$)') then u end as scoped from j""",
)
def joined_urls(spark, d):
    p = t(spark, d, "pages")
    name = F.concat(F.lit("Fig "), (F.col("page_id") % 7).cast("string"), F.when(F.col("page_id") % 2 == 0, ".png").otherwise(".svg"))
    url = fx.join_asset_url("url", name)
    return p.select("page_id", url.alias("url"), fx.has_web_variant(url).alias("variant"), fx.scoped_path("url", "https:/").alias("scoped"))
