"""Reader state, account, check and layout operators over rows made from the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import catalog, citations, layout, links, markdown, metadata, ordered, reader, rules, search
from foliant.plans.catalog_queries import PAPERS, t
from foliant.plans.registry import query
from foliant.sources import sinks, snapshots
from foliant.streaming import feed


@query(
    "marked_papers",
    """with x as (select doc_id, case doc_id % 5 when 0 then '已读' when 1 then '在读' when 2 then 'other' else '' end as r, case when doc_id % 7 < 3 then '' when doc_id % 7 < 5 then '在读' end as fr, doc_id % 4 = 0 as starred, case when doc_id % 6 = 0 then '待引用' else '' end as cite, doc_id % 9 = 0 as cited from documents),
y as (select *, coalesce(nullif(fr, ''), case when r in ('在读', '已读', '重读') then r end, '') as reading, coalesce(nullif(cite, ''), case when cited then '已引用' end, '') as c from x)
select m as mark, count(*) as n from y, (values ('在读'), ('已读'), ('重点'), ('待引用'), ('已引用')) v(m) where case m when '重点' then starred when '待引用' then c = m when '已引用' then c = m else reading = m end group by 1""",
)
def marked_papers(spark, d):
    k = F.col("doc_id")
    flags = F.struct(F.when(k % 7 < 3, "").when(k % 7 < 5, "在读").alias("reading"), (k % 4 == 0).alias("starred"), F.when(k % 6 == 0, "待引用").otherwise("").alias("cite"), (k % 9 == 0).alias("cited"))
    rows = t(spark, d, "documents").select(k, F.when(k % 5 == 0, "已读").when(k % 5 == 1, "在读").when(k % 5 == 2, "other").otherwise("").alias("reading"), flags.alias("flags"), F.lit("").alias("haystack"))
    out = [search.filter_papers(rows, mark=m).groupBy(F.lit(m).alias("mark")).agg(F.count("*").alias("n")) for m in ("在读", "已读", "重点", "待引用", "已引用")]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


@query("filtered_papers", f"with {PAPERS} select doc_id from p join documents using (doc_id) where status = 'ready' and visibility = 'shared' and (source = 'src0' or starts_with(source, 'src0/') or list_contains(string_split(source, '/'), 'src0')) and contains(lower(text), 'the')")
def filtered_papers(spark, d):
    k = F.col("doc_id")
    rows = t(spark, d, "documents").select(k, F.col("source").alias("domain"), F.when(k % 4 == 0, "reading").when(k % 4 == 1, "notes").otherwise("ready").alias("status"), F.when(k % 3 == 0, "shared").otherwise("private").alias("visibility"), F.lit("method").alias("kind"), search.haystack("text").alias("haystack"))
    return search.filter_papers(rows, "The", status="ready", visibility="shared", kind="all", domain="src0").select("doc_id")


@query("grouped_sizes", "select coalesce(nullif(split_part(d, '/', 1), ''), 'x') as major, case when contains(d, '/') then substr(d, instr(d, '/') + 1) else '' end as sub, count(*) as n, min(p_partkey) as first from (select p_partkey, case when p_partkey % 5 = 0 then p_type else p_type || '/' || p_brand || '/s' end as d from part) group by 1, 2")
def grouped_sizes(spark, d):
    p = t(spark, d, "part").withColumn("domain", F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.concat_ws("/", "p_type", "p_brand", F.lit("s"))))
    return search.group_sizes(p, "domain", "p_partkey")


@query("cover_images", "select p_partkey, case p_partkey % 4 when 0 then '/b' when 1 then '/c' when 2 then '/a' else '/assets/images/cover/cover-1.webp' end as cover, '第 ' || p_size || ' 页 · 图 A.' || p_partkey as caption from part")
def cover_images(spark, d):
    img = lambda name, url: F.struct(F.lit(name).alias("name"), F.lit(url).alias("url"))
    k = F.col("p_partkey")
    images = F.when(k % 4 == 0, F.array(img("x_page1_fig1.png", "/a"), img("x_page1_fig2.png", "/b"))).when(k % 4 == 1, F.array(img("z.png", "/z"), img("x_page3_fig1.png", "/c"))).when(k % 4 == 2, F.array(img("y.png", "/a"), img("cover.png", "/b"))).otherwise(F.array().cast("array<struct<name:string,url:string>>"))
    name = F.concat(F.lit("p_page"), F.col("p_size").cast("string"), F.lit("_figa"), k.cast("string"), F.lit(".png"))
    return t(spark, d, "part").select(k, catalog.pick_cover(images).alias("cover"), catalog.fallback_caption(name).alias("caption"))


@query("titles_by_language", "select doc_id, case when doc_id % 3 = 0 then source when doc_id % 3 = 1 then lang else case when doc_id % 2 = 0 then source else lang end end as primary, case when doc_id % 3 < 2 then '' when doc_id % 2 = 0 then lang else source end as secondary from documents")
def titles_by_language(spark, d):
    k = F.col("doc_id")
    zh, en = F.when(k % 3 == 1, "").otherwise(F.col("source")), F.when(k % 3 == 0, F.col("source")).otherwise(F.col("lang"))
    pair = catalog.titles(zh, en, F.when(k % 2 == 0, "zh").otherwise("EN-us"))
    return t(spark, d, "documents").select(k, pair["primary"].alias("primary"), pair["secondary"].alias("secondary"))


@query(
    "dangling_by_alias",
    """with l as (select page_id, unnest(['x' || page_id % 40 || '.notes', url, 'Al-ias ' || page_id % 3, '_nav', '']) as target from pages)
select page_id, count(*) as n, list_sort(list(target))[1:6] as preview from (select distinct * from l) where target <> '' and target not like '\\_%' escape '\\' and (case when contains(target, '.notes') then split_part(target, '.notes', 1) else target end) not in (select 'x' || r from range(0, 20) t(r)) and target <> 'Al-ias 1' group by page_id""",
)
def dangling_by_alias(spark, d):
    k = F.col("page_id")
    targets = F.array(F.concat(F.lit("x"), (k % 40).cast("string"), F.lit(".notes")), F.col("url"), F.concat(F.lit("Al-ias "), (k % 3).cast("string")), F.lit("_nav"), F.lit(""))
    known = spark.range(20).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("pid"))
    return links.dangling(t(spark, d, "pages"), "page_id", targets, known, "pid", aliases=spark.createDataFrame([("alias1",)], "alias string"))


@query(
    "known_papers",
    """with c as (select lower(p_name) as doi, min(cast(p_partkey as varchar)) as pid from part where p_partkey % 2 = 0 group by 1)
select p_partkey, coalesce(case when p_partkey % 10 = 3 then 'f' || p_partkey end, pid) as pid from part left join c on lower(p_name) = doi where p_partkey % 10 = 3 or pid is not null""",
)
def known_papers(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    index = F.concat(F.lit("Papers/f"), k.cast("string"), F.lit(".md"))
    cand = p.select(k, index.alias("index"), F.concat(F.lit(" https://doi.org/"), F.upper("p_name")).alias("doi"))
    cat = p.where(k % 2 == 0).select(F.col("p_name").alias("doi"), k.cast("string").alias("pid"))
    return links.duplicate_papers(cand, cat, p.where(k % 10 == 3).select(index.alias("path"))).select(k, "pid")


@query(
    "linked_citations",
    """with o as (select o_orderkey as k, cast(year(o_orderdate) as varchar) as y, chr(cast(65 + o_custkey % 26 as int)) || 'uthor' as a from orders)
select k, 'As [[#^ref-1|1]],[[#^ref-2|2]],[[#^ref-3|3]] and [[#^ref-1|' || a || ', ' || y || ']] say `[1]`, (' || a || ' 1800; Nobody, 1999) or [[#^ref-1|' || a || ', ' || y || ']].' as body from o""",
)
def linked_citations(spark, d):
    y, a = F.year("o_orderdate").cast("string"), F.concat(F.char(F.lit(65) + F.col("o_custkey") % 26), F.lit("uthor"))
    md = F.concat(F.lit("As [1–3] and ("), a, F.lit(", "), y, F.lit(") say `[1]`, ("), a, F.lit(" 1800; Nobody, 1999) or "), a, F.lit(" ("), y, F.lit(").\n\n## 参考文献\n- **[1]** "), a, F.lit(", J.: Title, "), y, F.lit(". ^ref-1\n- **[2]** ^ref-2"))
    # a small file is one task's: its rows are dealt before their texts are made
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey").repartition("o_orderkey")
    docs = orders.select(F.col("o_orderkey").alias("k"), md.alias("text"))
    linked = citations.link_own_list(docs, "text", "t").select("k", citations.split_at_refs("t")["body"].alias("b"))
    return linked.select("k", fx.strip("b").alias("body"))


@query(
    "whole_documents",
    """select conv_id, turn, case when turn % 4 < 2 then role else '' end as note, case when turn % 4 = 0 then '已引用' when turn % 4 = 1 then '待引用' else '' end as cite, turn % 4 = 1 as starred from conversations""",
)
def whole_documents(spark, d):
    k = F.col("turn")
    js = F.when(k % 4 == 0, F.to_json(F.struct(F.col("role").alias("note"), F.struct(F.lit(True).alias("cited")).alias("flags")))).when(k % 4 == 1, F.to_json(F.struct(F.col("role").alias("note"), F.struct(F.lit(True).alias("cited"), F.lit(True).alias("starred"), F.lit("待引用").alias("cite")).alias("flags")))).when(k % 4 == 2, "{broken")
    docs = reader.documents(t(spark, d, "conversations").select("conv_id", "turn", js.alias("value")))
    return docs.select("conv_id", "turn", F.col("document.note").alias("note"), F.col("document.flags.cite").alias("cite"), F.col("document.flags.starred").alias("starred"))


@query(
    "normal_sessions",
    """select event_id, case event_id % 4 when 0 then 'txt' when 1 then 'articleEn' when 2 then 'article' else 'article' end as tab, cast(case event_id % 4 when 0 then event_id % 1000 when 1 then 7 else 0 end as int) as scroll from events""",
)
def normal_sessions(spark, d):
    k = F.col("event_id")
    progress = F.when(k % 4 == 1, F.create_map(F.lit("articleEn"), F.lit("6.6"), F.lit("images"), F.lit("9"))).when(k % 4 == 2, F.create_map(F.lit("article"), F.lit("-5"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    s = F.struct(F.lit("s").alias("slug"), F.lit("t").alias("title"), F.when(k % 4 == 0, "txt").otherwise("images").alias("tab"), (k % 1000).cast("double").alias("scroll"), progress.alias("progress"), F.lit("").alias("split"), F.lit(1.0).alias("at"))
    n = reader.normal_session(s)
    return t(spark, d, "events").select(k, n["tab"].alias("tab"), n["scroll"].alias("scroll"))


@query("pending_words", "select n_name as word from nation where n_nationkey % 3 <> 0 and n_regionkey < 3")
def pending_words(spark, d):
    n = t(spark, d, "nation")
    book = n.select(F.col("n_name").alias("word"), F.lit("x").alias("en"), F.when(F.col("n_nationkey") % 3 == 0, "y").otherwise("").alias("zh"))
    return reader.pending(book, n.where("n_regionkey < 3").select(F.upper("n_name").alias("word"))).select("word")


@query(
    "marked_words",
    r"""with b as (select word from (values ('the'), ('and'), ('of the')) v(word)), h as (select doc_id, word, len(regexp_extract_all(lower(' ' || regexp_replace(text, '([^A-Za-z])', ' \1 ', 'g') || ' '), '[^a-z]and[^a-z]')) as n from documents, b where word = 'and') select doc_id, n from h where n > 0""",
)
def marked_words(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    marks = reader.mark_words(docs, spark.createDataFrame([("The",), ("AND",), ("of the",)], "word string"), "doc_id")
    return marks.where("word = 'AND'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("shares_shown", "select o_custkey as user_id, list(o_orderkey order by o_orderdate desc, cast(o_orderkey as varchar)) as tokens from orders where o_custkey % 50 = 1 and o_orderkey % 3 <> 0 group by 1")
def shares_shown(spark, d):
    o = t(spark, d, "orders")
    shares = o.select(F.col("o_orderkey").cast("string").alias("token"), F.lit("s").alias("slug"), F.col("o_custkey").alias("created_by"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.lit(None).cast("string").alias("expires_at"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("revoked"))
    own = reader.shares_of(shares, F.col("created_by")).join(shares.select("token", F.col("created_by").alias("user_id")), "token").where("user_id % 50 = 1")
    newest = lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).when(a["token"] < b["token"], -1).otherwise(1)
    return own.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("createdAt").alias("at"), "token")), newest), lambda x: x["token"].cast("long")).alias("tokens"))


@query("share_pages", "select cast(o_orderkey as varchar) as token, case when o_orderstatus = 'F' or (o_orderkey % 5 > 0 and strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01') or o_custkey not in (select c_custkey from customer where c_acctbal > 0) then 410 else 200 end as status from orders")
def share_pages(spark, d):
    o = t(spark, d, "orders")
    shares = o.select(F.col("o_orderkey").cast("string").alias("token"), F.col("o_custkey").alias("slug"), F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("expires_at"), (F.col("o_orderstatus") == "F").cast("int").alias("revoked"))
    papers = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("pid"), F.col("c_custkey").alias("pos"))
    return reader.share_pages(shares.select("token"), shares, papers, F.lit("1996-01-01")).select("token", "status")


@query("patched_users", "select c_custkey as id, case when c_custkey % 3 = 0 and c_custkey % 6 <> 3 and c_custkey <> 12 then 'admin' else 'reader' end as role, case when c_custkey % 4 = 1 and c_custkey % 6 <> 3 then 1 else 0 end as disabled from customer")
def patched_users(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    users = c.select(k.alias("id"), F.col("c_name").alias("display_name"), F.lit("reader").alias("role"), F.lit(0).alias("disabled"))
    patches = c.select(k.alias("id"), F.lit(None).cast("string").alias("display_name"), F.when(k % 6 == 3, "king").when(k % 3 == 0, "admin").alias("role"), F.when(k % 4 == 1, True).alias("disabled"))
    return reader.patch_users(users, patches, 12)[0].select("id", "role", "disabled")


@query("store_conflicts", "select cast(o_custkey as varchar) || '|' || o_orderpriority as key, count(*) as n from orders group by o_custkey, o_orderpriority having count(*) > 1")
def store_conflicts(spark, d):
    return reader.store_conflicts(t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("slug")), "notes")


@query(
    "caption_faults",
    """select o_orderkey, l as label, case when l = '3' then 'absent' else 'not_embedded' end as fault from orders, (values ('2'), ('3')) v(l) where l = '3' or o_orderkey % 2 = 0""",
)
def caption_faults(spark, d):
    k = F.col("o_orderkey")
    md = F.concat(F.lit("![[a.png]]\n**Fig. 1.** One\n\ntext\ntext\n"), F.when(k % 2 == 0, "").otherwise("![[b.png|w]]\n\n"), F.lit("**Figure 02.** Two"))
    docs = t(spark, d, "orders").select(k, md.alias("text"))
    expected = docs.select(k, F.explode(F.array(*map(F.lit, "123"))).alias("label"))
    return rules.missing_captions(docs, "o_orderkey", expected, rules.EN_CAP)


@query(
    "moved_items",
    """select p_partkey, 4 as items, case p_partkey % 3 when 0 then 0 when 1 then 1 else 2 end as moved, case p_partkey % 3 when 0 then 'ok' when 1 then 'warning' else 'error' end as band from part""",
)
def moved_items(spark, d):
    k = F.col("p_partkey")
    eq = lambda n: f"$$x \\tag{{{n}}}$$\n"
    en = F.concat(F.lit("## 1 A\n" + eq(1) + eq(2) + "**Fig. 1.** c\n## 2 B\n" + eq("A.1")), F.col("p_name"))
    zh = F.concat(F.lit("## 1 甲\n" + eq(1)), F.when(k % 3 < 2, eq(2)).otherwise(""), F.when(k % 3 == 0, "**图 1.** c\n").otherwise(""), F.lit("## 2 乙\n"), F.when(k % 3 > 0, "**图 1.** c\n").otherwise(""), F.when(k % 3 == 2, eq(2)).otherwise(""), F.lit(eq("A.1")))
    # a small file is one task's: its rows are dealt before their texts are made and read
    p = t(spark, d, "part").select(k, "p_name").repartition(k)
    a, b = (rules.item_sections(p.select(k, x.alias("text")), "p_partkey") for x in (en, zh))
    return rules.moved_items(a, b, "p_partkey").select(k, F.col("items").cast("int").alias("items"), F.col("moved").cast("int").alias("moved"), "band")


@query("dump_sections", "select p_partkey, case when p_partkey % 2 = 0 then 'Figures' else '公式' end as title, cast(2 as bigint) as n from part where p_partkey % 5 <> 0")
def dump_sections(spark, d):
    k = F.col("p_partkey")
    md = F.concat(F.lit("## "), F.when(k % 5 == 0, "3 ").otherwise(""), F.when(k % 2 == 0, "Figures").otherwise("公式"), F.lit("\n**Fig. 1.** a\n$$x \\tag{2}$$\n## Next\n"), "p_name")
    return rules.dump_sections(t(spark, d, "part").select(k, md.alias("text")), "p_partkey")


@query("heading_levels", "select l_orderkey, l_linenumber, cast(case when l_linenumber % 4 = 0 and l_quantity > 25 then 3 when l_linenumber % 4 = 0 then 0 when l_linenumber % 4 = 1 then 2 when l_linenumber % 4 = 2 and l_quantity > 25 then 2 when l_linenumber % 4 = 2 then 0 else 0 end as int) as level from lineitem")
def heading_levels(spark, d):
    n, bold = F.col("l_linenumber"), F.col("l_quantity") > 25
    x = F.when(n % 4 == 0, F.concat(F.lit("2."), n.cast("string"), F.lit(" Methods of all"))).when(n % 4 == 1, "R e f e r e n c e s").when(n % 4 == 2, "Appendix B").otherwise("x = y + 2")
    return t(spark, d, "lineitem").select("l_orderkey", n, layout.heading_level(x, F.lit(10.0), bold, F.lit(10.0)).alias("level"))


@query("body_sizes", "select l_orderkey as doc, arg_max(s, (n, -s)) as size from (select l_orderkey, round(l_discount * 100 + 8.04, 1) as s, sum(length(l_returnflag)) as n from lineitem group by 1, 2) group by 1")
def body_sizes(spark, d):
    return layout.body_size(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_discount") * 100 + 8.04).alias("size"), F.col("l_returnflag").alias("t")))


@query(
    "room_above_captions",
    """with c as (select distinct l_orderkey as page, cast(l_linenumber as varchar) as num, l_linenumber * 150.0 + 100 as cy from lineitem where l_linenumber % 2 = 1), b as (select l_orderkey as page, l_linenumber * 150.0 as bottom from lineitem where l_quantity > 20)
select c.page, num, 96.0 as x0, greatest(36.0, coalesce(max(bottom) + 2, 36.0)) as y0, 304.0 as x1, cy - 2 as y1 from c left join b on b.page = c.page and bottom <= cy - 4 group by c.page, num, cy""",
)
def room_above_captions(spark, d):
    li, n = t(spark, d, "lineitem"), F.col("l_linenumber")
    cap = li.where(n % 2 == 1).select(F.col("l_orderkey").alias("page"), n.cast("string").alias("num"), F.lit(100.0).alias("x0"), (n * 150.0 + 100).alias("y0"), F.lit(300.0).alias("x1"), (n * 150.0 + 110).alias("y1"), F.lit(0.0).alias("page_y0"))
    blocks = li.where("l_quantity > 20").select(F.col("l_orderkey").alias("page"), F.lit(100.0).alias("x0"), (n * 150.0 - 20).alias("y0"), F.lit(300.0).alias("x1"), (n * 150.0).alias("y1"), F.lit("word " * 30).alias("text"), F.lit(False).alias("caption"))
    return layout.gap_above(cap, blocks, ["page"])


@query("spaced_words", "select page_id, 'FIGURE 12 of ' || page_id as a, 'see abcd ' || page_id as b, 'word[12,13] x^{2} ' || page_id as c from pages")
def spaced_words(spark, d):
    k = F.col("page_id").cast("string")
    return t(spark, d, "pages").select("page_id", layout.despaced(F.concat(F.lit("F I G U R E 1 2 of "), k)).alias("a"), layout.despaced_anywhere(F.concat(F.lit("see a b c d "), k)).alias("b"), layout.citation_brackets(F.concat(F.lit("word^{12,13} x^{2} "), k)).alias("c"))


@query("decorated_pages", '''select page_id, '<div class="tbl-wrap"><table>' || page_id || '</table></div><h1>' || page_id || '</h1>' as html from pages''')
def decorated_pages(spark, d):
    k = F.col("page_id").cast("string")
    return t(spark, d, "pages").select("page_id", markdown.plain_headings(markdown.wrap_tables(F.concat(F.lit("<table>"), k, F.lit("</table><h1>🔬 "), k, F.lit("（中文翻译）</h1>")))).alias("html"))


@query("doi_chips", "select p_partkey, 'T. [https://doi.org/10.1/' || p_partkey || '](https://doi.org/10.1/' || p_partkey || ')' || chr(10) || 'see doi.org/10.1/' || p_partkey || ' ' as text from part")
def doi_chips(spark, d):
    k = F.col("p_partkey").cast("string")
    chip = F.concat(F.lit("｜ [🔗 DOI](https://doi.org/10.1/"), k, F.lit(")"))
    return t(spark, d, "part").select("p_partkey", markdown.doi_chips(F.concat(F.lit("T. "), chip, F.lit("\nsee doi.org/10.1/"), k, F.lit(" "), chip)).alias("text"))


@query("published_catalogue", """select part, p_partkey as key, case when part = 1 then case when p_partkey = (select min(p_partkey) from part) then '' else ',' end || '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}' end as value from (select 1 as part, p_partkey, p_name from part)
union all select 3, r_regionkey, case when r_regionkey = 0 then '' else ',' end || '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' from region
union all select 0, null, '{"generatedAt":"now","count":' || count(*) || ',"papers":[' from part union all select 2, null, '],"topicDocs":[' union all select 4, null, ']}'""")
def published_catalogue(spark, d):
    lines = sinks.catalog_lines(t(spark, d, "part").select("p_partkey", "p_name"), t(spark, d, "region").select("r_regionkey", "r_name"), "now", "p_partkey", "r_regionkey")
    return lines.select("part", F.col("ord").cast("long").alias("key"), "value")


@query("link_map", """select part, ord, value from (select 1 as part, cast(p_partkey as varchar) as ord, case when cast(p_partkey as varchar) = (select min(cast(p_partkey as varchar)) from part) then '' else ',' end || '"' || p_partkey || '":"' || p_name || '"' as value from part
union all select 3, p_name, case when p_name = (select min(p_name) from part) then '' else ',' end || '"' || p_name || '":"' || min(p_brand) || '"' from part group by p_name
union all select 0, null, '{"papers":{' union all select 2, null, '},"terms":{' union all select 4, null, '}}')""")
def link_map(spark, d):
    p = t(spark, d, "part")
    lines = sinks.link_map_lines(p.select(F.col("p_partkey").cast("string").alias("pid"), F.col("p_name").alias("slug")), p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("key")))
    return lines.select("part", "ord", "value")


@query("table_fingerprints", "select * from (values ('sorted', true), ('doubled', false), ('one cell', false), ('columns', true)) v(\"case\", same)")
def table_fingerprints(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    least = rows.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("_k"))
    cell = rows.join(F.broadcast(least), F.lit(True)).withColumn("l_quantity", F.col("l_quantity") + F.when(F.struct("l_orderkey", "l_linenumber") == F.col("_k"), 1).otherwise(0)).drop("_k")
    other = {"sorted": rows.orderBy("l_quantity", "l_orderkey"), "doubled": rows.union(rows), "one cell": cell, "columns": rows.select(*reversed(rows.columns))}
    one = snapshots.fingerprint(rows).select(F.struct("*").alias("own"))
    out = [snapshots.fingerprint(x).select(F.struct("*").alias("its")).join(F.broadcast(one), F.lit(True)).select(F.lit(k).alias("case"), (F.col("own") == F.col("its")).alias("same")) for k, x in other.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("two_way_merge", """with l as (select o_orderkey as k, 'local' as v, o_orderkey % 7 as stamp, case when o_orderkey % 3 = 0 then 'b' else 'a' end as origin from orders where o_orderkey % 5 <> 0),
r as (select o_orderkey as k, 'remote' as v, o_orderkey % 4 as stamp, case when o_orderkey % 2 = 0 then 'b' else 'a' end as origin from orders where o_orderkey % 6 <> 0),
u as (select *, 1 as side from l union all select *, 2 from r), m as (select *, row_number() over (partition by k order by stamp desc, origin desc, v desc) as n from u)
select k, v, stamp, origin, side = 1 and origin = 'a' and not exists (select 1 from r where r.k = m.k and (r.stamp, r.origin, r.v) >= (m.stamp, m.origin, m.v)) as pushed from m where n = 1""")
def two_way_merge(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    side = lambda rest, v, m, b: o.where(k % rest != 0).select(k.alias("k"), F.lit(v).alias("v"), (k % m).alias("stamp"), F.when(k % b == 0, "b").otherwise("a").alias("origin"))
    local, remote = side(5, "local", 7, 3), side(6, "remote", 4, 2)
    pushed = feed.outgoing(local, remote, ["k"], "a", "stamp").select(F.col("k").alias("_k"))
    merged = feed.merged(local, remote, ["k"], "stamp")
    return merged.join(pushed, F.col("k") == F.col("_k"), "left").select("k", "v", "stamp", "origin", F.col("_k").isNotNull().alias("pushed"))


@query("hierarchical_gaps", "select l_orderkey, list_sort(list_filter(range(case when min(l_linenumber) <= 3 then 1 else min(l_linenumber) end, max(l_linenumber) + 1), lambda x: not list_contains(list(l_linenumber), x))) as missing from lineitem group by 1")
def hierarchical_gaps(spark, d):
    n = F.col("l_linenumber").cast("string")
    rows = t(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("A."), n).alias("label"))
    g = ordered.label_gaps(rows, ["l_orderkey"], "label")
    return g.select("l_orderkey", F.transform("missing", lambda x: F.substring_index(x, ".", -1).cast("long")).alias("missing"))


@query("page_dois", "select page_id, case when page_id % 3 = 0 then '10.1234/d' else '10.1234/a' || page_id end as doi from pages")
def page_dois(spark, d):
    k = F.col("page_id").cast("string")
    first = F.concat(F.when(F.col("page_id") % 3 == 0, "Ref. (2019) ").otherwise("x "), F.lit("doi 10.1234/a"), k, F.lit(" and then 10.1234/c and "), F.lit("y" * 70), F.lit(" 10.1234/d."))
    p = t(spark, d, "pages")
    return metadata.find_doi(p.select("page_id", F.lit(1).alias("page"), first.alias("text")).unionByName(p.select("page_id", F.lit(2).alias("page"), F.concat(F.lit("own 10.1234/b"), k, F.lit(";")).alias("text"))), "page_id")


@query("formatted_references", "select p_partkey, p_name || ' A title, 2020. ｜ [🔗 DOI](https://doi.org/10.1000/' || p_partkey || ')' as ref from part")
def formatted_references(spark, d):
    raw = F.concat("p_name", F.lit("  A\ntitle, 2020. https://doi.org/10.1000/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" doi:10.1000/"), F.col("p_partkey").cast("string"))).otherwise("."))
    return t(spark, d, "part").select("p_partkey", metadata.format_reference(raw).alias("ref"))


@query("label_census", """select l_orderkey, kind, label from (select distinct l_orderkey, 'figure' as kind, 'B.' || l_linenumber as label from lineitem where l_quantity > 10 union select distinct l_orderkey, 'table', cast(l_linenumber as varchar) from lineitem where l_quantity <= 10)""")
def label_census(spark, d):
    n = F.col("l_linenumber").cast("string")
    line = F.when(F.col("l_quantity") > 10, F.concat(F.lit("Fig. B."), n, F.lit(" Values of x"))).otherwise(F.concat(F.lit("Table 0"), n, F.lit(". Values of y\nTable "), n, F.lit(" shows more")))
    docs = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("f"))
    return metadata.census(docs.withColumn("c", F.lit("")), "l_orderkey", "f", "c")


@query("embedded_images", "select p_partkey, cast(case p_partkey % 3 when 0 then 1 when 1 then 1 else 0 end as bigint) as changes, case p_partkey % 3 when 0 then 'x' || chr(10) || chr(10) || '![[f.png|700]]' || chr(10) || chr(10) || '**Fig. 1.** ' || p_name when 1 then '![[f.png|700]]' || chr(10) || '**Fig. 1.** ' || p_name else '![[f.png]]' || chr(10) || chr(10) || '**Fig. 1.** ' || p_name end as text from part")
def embedded_images(spark, d):
    k = F.col("p_partkey")
    docs = t(spark, d, "part").select(k, F.concat(F.when(k % 3 == 0, "x\n").when(k % 3 == 1, "![[old.png]]\n").otherwise("![[f.png]]\n\n"), F.lit("**Fig. 1.** "), "p_name").alias("text"))
    return metadata.embed_images(docs, "p_partkey", docs.select(k, F.lit("1").alias("num"), F.lit("f.png").alias("file")))
