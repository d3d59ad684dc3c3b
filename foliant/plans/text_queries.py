"""Text, link, layout and account operators over rows made from the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import citations, figures, layout, links, markdown, ordered, search, sync
from foliant.plans.catalog_queries import t
from foliant.plans.registry import query
from foliant.sources import sinks


@query("link_keys", r"select page_id, regexp_replace(lower(url || 'É①'), '[^\p{L}\p{N}]', '', 'g') as k1, regexp_replace(lower(url || 'É①'), '[^a-z0-9一-鿿]', '', 'g') as k2 from pages")
def link_keys(spark, d):
    u = F.concat("url", F.lit("É①"))
    return t(spark, d, "pages").select("page_id", fx.link_key_unicode(u).alias("k1"), fx.link_key_ascii(u).alias("k2"))


@query("merge_patch", "select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, case when c_custkey % 3 = 0 then 'now' else 'old' end as at from customer")
def merge_patch(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit("old").alias("at"))
    patch = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return sync.merge_patch(c, patch, "c_custkey", ["c_acctbal"], "at", "now").select("c_custkey", "c_acctbal", "at")


@query("highlights_kept", "select doc_id, doc_id % 2 = 0 and length(text) >= 9 as ok from documents where length(text) > 0")
def highlights_kept(spark, d):
    docs = t(spark, d, "documents").where("length(text) > 0")
    key = [F.col("doc_id").alias("slug"), F.lit("article").alias("tab"), F.lit(0).alias("block")]
    mine = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 4, 6)).otherwise("\u0000none!")
    hl = docs.where("doc_id % 2 = 1 or length(text) >= 0").select(*key, F.lit(3).alias("start"), F.lit(9).alias("end"), F.when(F.length(mine) == 6, mine).otherwise("\u0000none!").alias("text"))
    return sync.highlights_kept(hl, docs.select(*key, "text")).select(F.col("slug").alias("doc_id"), "ok")


@query("wiki_links", "select page_id, [url, 'Q'] as targets, ['img.png'] as embeds from pages")
def wiki_links(spark, d):
    md = F.concat(F.lit("a [["), F.col("url"), F.lit("|x]] b [[ Q ]] ![[img.png|w=3]]"))
    p = t(spark, d, "pages").withColumn("url", F.regexp_replace("url", r"[\[\]|]", ""))
    return p.select("page_id", links.wiki_targets(md).alias("targets"), links.embed_targets(md).alias("embeds"))


@query("markdown_headings", "select p_partkey, 0 as line_no, 1 as level, p_name as title from part union all select p_partkey, 2, 2, p_type from part")
def markdown_headings(spark, d):
    md = F.concat(F.lit("# "), "p_name", F.lit("\nbody # no\n##  "), "p_type", F.lit(" \n#none"))
    return markdown.markdown_headings(t(spark, d, "part").select("p_partkey", md.alias("text")), "p_partkey")


@query("cite_years", "select o_orderkey, cast(year(o_orderdate) as varchar) as y from orders")
def cite_years(spark, d):
    y = F.year("o_orderdate").cast("string")
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("Smith, J.: A 1850 title, J. Geo., "), y, F.lit("."))).when(key % 3 == 1, F.concat(F.lit("Aksoy B ("), y, F.lit(") Title of 1990 doi:10.1/2001"))).otherwise(F.concat(F.lit("PRAKASH N. Title[J]. RS, "), y, F.lit(", 12(3): 1999.")))
    return t(spark, d, "orders").select("o_orderkey", citations.cite_year(text).alias("y"))


@query("expand_numbers", "select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then [l_linenumber, l_linenumber + 2, l_linenumber + 3, l_linenumber + 4, l_linenumber + 5, l_linenumber] else [l_linenumber, l_linenumber + 2, l_linenumber] end as ns from lineitem")
def expand_numbers(spark, d):
    n = F.col("l_linenumber")
    s = F.concat(n.cast("string"), F.lit(", "), (n + 2).cast("string"), F.lit("–"), F.when(n % 2 == 0, n + 5).otherwise(n + 23).cast("string"), F.lit("，"), n.cast("string"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", citations.expand_numbers(s).cast("array<int>").alias("ns"))


@query(
    "format_runs",
    """with i as (select l_orderkey, min(n) as lo, max(n) as hi from (select l_orderkey, n, n - row_number() over (partition by l_orderkey order by n) as g from (select distinct l_orderkey, l_linenumber as n from lineitem)) group by l_orderkey, g)
select l_orderkey, string_agg(case when lo = hi then cast(lo as varchar) else lo || '–' || hi end, '、' order by lo) as runs from i group by l_orderkey""",
)
def format_runs(spark, d):
    return ordered.format_runs(ordered.islands(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber"), ["l_orderkey"])


@query("status_counts", "select s as status, (select count(*) from orders where case o_orderstatus when 'F' then 'cut' when 'O' then 'carry' else 'manual' end = s) as n from (values ('cut'), ('carry'), ('manual'), ('fallback'), ('missing'), ('error')) v(s)")
def status_counts(spark, d):
    o = t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "cut").when(F.col("o_orderstatus") == "O", "carry").otherwise("manual").alias("status"))
    return figures.status_counts(o)


@query(
    "assign_regions",
    """with r as (select l_orderkey as page, l_quantity * 8.0 as x0, l_linenumber * 100.0 as y0, l_quantity * 8.0 + 60 as x1, l_linenumber * 100.0 + 40 + l_quantity % 90 as y1 from lineitem where l_linenumber % 2 = 0),
c as (select l_orderkey as page, cast(l_linenumber as varchar) as num, l_quantity * 8.0 as cx0, l_linenumber * 100.0 as cy0, l_quantity * 8.0 + 60 as cx1, l_linenumber * 100.0 + 20 as cy1 from lineitem where l_linenumber % 2 = 1),
x as (select r.*, num, case when cy0 >= y1 - 6 then cy0 - y1 when cy1 <= y0 + 6 then y0 - cy1 + 60 else 0 end as dist from r join c using (page) where least(x1, cx1) - greatest(x0, cx0) > -20),
b as (select *, row_number() over (partition by page, x0, y0, x1, y1 order by dist, num) as k from x where dist <= 180),
u as (select page, num, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b where k = 1 group by page, num)
select page, num, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(least(y1, min(case when least(x1, cx1) > greatest(x0, cx0) and least(y1, cy1) > greatest(y0, cy0) and cy0 > y0 + 20 then cy0 - 2 else y1 end)) as double) as y1 from u join c using (page, num) group by page, num, x0, y0, x1, y1""",
)
def assign_regions(spark, d):
    li, n, x = t(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_quantity") * 8.0
    box = lambda h: [F.col("l_orderkey").alias("page"), x.alias("x0"), (n * 100.0).alias("y0"), (x + 60).alias("x1"), (n * 100.0 + h).alias("y1")]
    return layout.assign_regions(li.where(n % 2 == 1).select(*box(F.lit(20)), n.cast("string").alias("num")), li.where(n % 2 == 0).select(*box(F.lit(40) + F.col("l_quantity") % 90)), ["page"])


@query(
    "coverage",
    """with r as (select l_orderkey as page, l_linenumber as id, l_linenumber * 10.0 as x0, 0.0 as y0, l_linenumber * 10.0 + 15 as x1, 10.0 as y1 from lineitem)
select a.page, a.id, sum(greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) / 150.0 as share from r a join r b using (page) group by a.page, a.id""",
)
def coverage(spark, d):
    n = F.col("l_linenumber")
    r = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("id"), (n * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (n * 10.0 + 15).alias("x1"), F.lit(10.0).alias("y1"))
    return layout.coverage(r, r.drop("id"), ["page"], "id")


@query("short_titles", r"select doc_id, case when length(s) > 16 then substr(s, 1, 16) || '…' else s end as title from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from documents)")
def short_titles(spark, d):
    return t(spark, d, "documents").select("doc_id", markdown.short_title("text").alias("title"))


@query("reader_links", "select doc_id, '/reader/' || doc_id || case when lang in ('fr', 'de') then '?tab=txt' when lang = 'es' then '?split=2' else '' end as href from documents")
def reader_links(spark, d):
    tab = F.when(F.col("lang").isin("fr", "de"), "txt").otherwise("article")
    return t(spark, d, "documents").select("doc_id", markdown.reader_href(F.col("doc_id").cast("string"), tab, F.when(F.col("lang") == "es", "2").otherwise("")).alias("href"))


@query("created_shares", "select o_orderkey, case when o_custkey % 4 > 0 then strftime(timestamp '2024-01-01 12:00:00' + (o_custkey % 4) * interval 1 day, '%Y-%m-%dT%H:%M:%S+00:00') end as expires_at from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def created_shares(spark, d):
    req = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("token"), F.col("o_orderkey").alias("user_id"), F.col("o_custkey").alias("slug"), (F.col("o_custkey") % 4).alias("days"))
    cat = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slug"))
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    return figures.create_shares(req, cat, now).select(F.col("user_id").alias("o_orderkey"), "expires_at")


@query("changed_content", "select p_partkey from part where p_partkey % 5 = 0 or p_partkey % 7 = 0")
def changed_content(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("v"))
    old = p.where("p_partkey % 5 <> 0").withColumn("v", F.when(F.col("p_partkey") % 7 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return sinks.changed(p, old, "p_partkey", "v").select("p_partkey")


@query("grouped_members", "select p_brand as major, '' as sub, count(*) as n, min(p_partkey) as first from part group by 1")
def grouped_members(spark, d):
    return search.group_sizes(t(spark, d, "part"), "p_brand", "p_partkey").select("major", F.coalesce("sub", F.lit("")).alias("sub"), "n", "first")


@query("asset_urls", "select page_id, regexp_replace(url, '^([a-z]+://[^/]*).*$', '\\1') || '/a%20b/c%C3%A9' as u from pages")
def asset_urls(spark, d):
    origin = F.regexp_extract("url", r"^([a-z]+://[^/]*)", 1)
    return t(spark, d, "pages").select("page_id", fx.encode_asset_url(F.concat(origin, F.lit("/a b/c%C3%A9"))).alias("u"))


@query(
    "parsed_references",
    """with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, count(*) over (partition by l_orderkey) as n, l_partkey as p, l_suppkey as s from lineitem)
select l_orderkey, cast(pos as int) as pos, 'Smith, J., 2019. A title of part ' || p || ' and of exam' || case when l_orderkey % 3 = 0 or l_orderkey % 3 = 1 and n >= 5 then '' else '- ' end || 'ples, Journal of Things, 12, ' || s || '.' as text from l""",
)
def parsed_references(spark, d):
    l = t(spark, d, "lineitem")  # noqa: E741
    entries = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("e"))
    k = F.col("l_orderkey") % 3
    mark = lambda i: F.when(k == 0, F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))).when((k == 1) & (F.size("e") >= 5), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("")
    two = lambda x, i: F.array(F.concat(mark(i), F.lit("Smith, J., 2019. A title of part "), x["l_partkey"].cast("string"), F.lit(" and of exam-")), F.concat(F.lit("ples, Journal of Things, 12, "), x["l_suppkey"].cast("string"), F.lit(".")))
    lines = entries.select("l_orderkey", F.posexplode(F.flatten(F.transform("e", two))).alias("i", "line"))
    return citations.parse_references(lines, "l_orderkey").select("l_orderkey", "pos", "text")
