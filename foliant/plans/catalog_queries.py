"""The catalogue's operators over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import activity, links, ordered, rules, search, sync
from foliant.plans.registry import query


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


HAY = r"trim(regexp_replace(lower(concat_ws(' ', text, lang, source)), '[/\-_·,，。：:；;]+', ' ', 'g'))"


@query(
    "faceted_search",
    """with h as (select *, contains(lower(text), 'the') and contains(lower(text), 'and') as hit from documents)
select 'lang' as facet, lang as value, count(*) as n from h where hit and source = 'src0' group by 2
union all select 'source', source, count(*) from h where hit and lang = 'en' group by 2""",
)
def faceted_search(spark, d):
    docs = t(spark, d, "documents").withColumn("haystack", search.haystack("text", "lang", "source"))
    hits = docs.where(search.all_tokens("haystack", "the and"))
    return search.facet_counts(hits, {"lang": F.col("lang"), "source": F.col("source")}, {"lang": F.col("lang") == "en", "source": F.col("source") == "src0"})


@query(
    "multi_value_facet",
    """select l_shipdate_month as value, count(*) as n from (select distinct l_orderkey, strftime(l_shipdate, '%Y-%m') as l_shipdate_month from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT') group by 1""",
)
def multi_value_facet(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.date_format("l_shipdate", "yyyy-MM").alias("m"))
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    hits = li.join(o, "o_orderkey").groupBy("o_orderkey").agg(F.collect_list("m").alias("months"))  # an order's few lines
    return search.facet_counts(hits, {"month": F.col("months")}, {}).select("value", "n")


PAPERS = """p as (select doc_id, case doc_id % 4 when 0 then 'reading' when 1 then 'notes' else 'ready' end as status, case when doc_id % 3 = 0 then 'shared' else 'private' end as visibility, lang <> 'en' as tr, quality = 1 as notes, n_chars > 5000 as pdf from documents left join labels using (doc_id))"""


@query("paper_stats", f"with {PAPERS} select count(*) as total, count(*) filter (status = 'reading') as reading, count(*) filter (status = 'notes') as notes, count(*) filter (visibility = 'shared') as shared, count(*) filter (tr) as with_translation, count(*) filter (p.notes) as with_analysis, count(*) filter (pdf) as with_pdf from p")
def paper_stats(spark, d):
    both = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    return search.stats(both.select(F.when(k % 4 == 0, "reading").when(k % 4 == 1, "notes").otherwise("ready").alias("status"), F.when(k % 3 == 0, "shared").otherwise("private").alias("visibility"), (F.col("lang") != "en").alias("hasTranslation"), (F.col("quality") == 1).alias("hasNotes"), (F.col("n_chars") > 5000).alias("hasPdf")))


@query(
    "domain_rollup",
    """with x as (select p_type as d, p_type || '/' || p_brand as f from part)
select d as value, 1 as level, count(*) as n from x group by 1 union all select f, 2, count(*) from x group by 1""",
)
def domain_rollup(spark, d):
    return search.domain_rollup(t(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("domain")), "domain")


@query("topic_series", "select coalesce(nullif(split_part(source, '/', 1), ''), 'other') as label, count(*) as n from documents group by 1")
def topic_series(spark, d):
    return search.topic_series(t(spark, d, "documents").select("source"), "source", other="other", locale=None)


@query(
    "group_members_ranked",
    """select p_brand, p_partkey, cast(row_number() over (partition by p_brand order by p_retailprice desc, p_name, p_partkey) as int) as rank from part""",
)
def group_members_ranked(spark, d):
    return search.ranked_members(t(spark, d, "part"), "p_brand", F.desc("p_retailprice"), F.col("p_name"), F.col("p_partkey")).select("p_brand", "p_partkey", "rank")


@query(
    "haystack_search",
    r"""select c_custkey from customer join nation on c_nationkey = n_nationkey
where contains(regexp_replace(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), '[/\-_·,，。：:；;]+', ' ', 'g'), 'building') and contains(regexp_replace(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), '[/\-_·,，。：:；;]+', ' ', 'g'), '1')""",
)
def haystack_search(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.withColumn("haystack", search.haystack("c_name", "n_name", "c_mktsegment")).where(search.all_tokens("haystack", "BUILDING 1")).select("c_custkey")


@query(
    "domain_match",
    """with x as (select p_partkey, p_type || '/' || p_brand as dom, p_brand from part), w as (select min(p_brand) as b from part)
select p_partkey from x, w where dom = b or starts_with(dom, b || '/') or list_contains(string_split(dom, '/'), b)""",
)
def domain_match(spark, d):
    p = t(spark, d, "part")
    want = p.agg(F.min("p_brand")).first()[0]
    return p.withColumn("domain", F.concat_ws("/", "p_type", "p_brand")).where(search.domain_matches("domain", want)).select("p_partkey")


@query(
    "block_filter",
    r"""with b as (select doc_id, lower(regexp_replace(unnest(string_split_regex(regexp_replace(text, '(?m)^(#{1,6}\s)', chr(10) || chr(10) || '\1', 'g'), '\n{2,}')), '^\s+|\s+$', '', 'g')) as blk from documents)
select doc_id, cast(count(*) filter (contains(blk, 'license')) as int) as hits from b group by doc_id""",
)
def block_filter(spark, d):
    return search.filter_blocks(t(spark, d, "documents").select("doc_id", "text"), " License ").select("doc_id", "hits")


@query("alias_first_wins", r"select regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as alias, min(p_partkey) as key from part group by 1 having alias <> ''")
def alias_first_wins(spark, d):
    terms = t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("ord"), "p_name", F.array().cast("array<string>").alias("aliases"))
    return links.alias_map(terms, ["p_name"], "ord")


LINK_SQL = r"""with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages),
u as (select url, min(page_id) as pid from pages group by url)
"""


@query(
    "link_resolution",
    r"""with l as (select page_id, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), [url, '_' || url])) as target from pages),
u as (select url, arg_max(page_id, page_id) as pid from pages group by url),
a as (select regexp_replace(lower(r_name), '[^\p{L}\p{N}]', '', 'g') as alias, r_name as key from region union select 'the', 'THE' union select 'and', 'AND')
select page_id, case when target like '\_%' escape '\' then 'nav' when pid is not null then 'paper' when key is not null then 'term' else 'text' end as kind, case when target like '\_%' escape '\' then null when pid is not null then cast(pid as varchar) else key end as ref, count(*) as n
from l left join u on trim(target) = url left join a on regexp_replace(lower(target), '[^\p{L}\p{N}]', '', 'g') = alias group by all""",
)
def link_resolution(spark, d):
    pages = t(spark, d, "pages")
    ls = pages.select("page_id", F.explode(F.concat(links.hrefs("html"), F.array("url", F.concat(F.lit("_"), "url")))).alias("target"))
    pids = pages.select(F.col("url").alias("pid"), F.col("page_id").cast("string").alias("slug"), "page_id")
    words = spark.createDataFrame([("THE",), ("AND",)], "name string").unionByName(t(spark, d, "region").select(F.col("r_name").alias("name")))
    terms = words.select(F.col("name").alias("key"), "name", F.col("name").alias("ord"), F.array().cast("array<string>").alias("aliases"))
    return links.resolve_links(ls, "target", pids, links.alias_map(terms, ["name"], "ord"), "page_id").groupBy("page_id", "kind", "ref").agg(F.count("*").alias("n"))


@query("dangling_links", LINK_SQL + "select page_id, count(*) as n, list_sort(list(target))[1:6] as preview from (select distinct page_id, trim(target) as target from l where trim(target) <> '' and target not like '\\_%' escape '\\') where target not in (select url from u where url is not null) group by page_id")
def dangling_links(spark, d):
    pages = t(spark, d, "pages")
    return links.dangling(pages, "page_id", F.transform(links.hrefs("html"), lambda s: F.trim(s)), pages, "url")


@query(
    "cite_tiers",
    """with e as (select o_orderkey as n, o_orderkey as ord, cast(o_custkey as varchar) as author, cast(year(o_orderdate) as varchar) || case when o_orderkey % 3 = 0 then 'a' else '' end as ey from orders),
p as (select o_orderkey as part_id, cast(o_custkey as varchar) as author, cast(year(o_orderdate) as varchar) || case when o_orderkey % 2 = 0 then 'a' else '' end as year from orders),
x as (select part_id, n, ord, case when ey = year then 1 when ey = regexp_replace(year, '[a-z]$', '') then 2 when starts_with(ey, regexp_replace(year, '[a-z]$', '')) then 3 end as tier from p join e using (author))
select part_id, arg_min(n, (tier, ord)) as n, cast(min(tier) as int) as tier from x where tier is not null group by part_id""",
)
def cite_tiers(spark, d):
    o = t(spark, d, "orders")
    author, year, key = F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"), F.col("o_orderkey")
    letter = lambda k: F.when(key % k == 0, "a").otherwise("")
    entries = o.select(key.alias("n"), key.alias("ord"), F.array(F.concat(author, F.lit("|"), year, letter(3))).alias("keys"))
    parts = o.select(key.alias("part_id"), author.alias("author"), F.concat(year, letter(2)).alias("year"))
    return links.cite_tiers(parts, entries)


@query(
    "nearest_event",
    """with a as (select user_id, event_id as id, ts from events where event_type = (select min(event_type) from events)), b as (select user_id, event_id as o, ts from events where event_type = (select max(event_type) from events)),
x as (select a.user_id, id, o, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 as gap, row_number() over (partition by a.user_id, id order by abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, o) as r from a join b using (user_id))
select user_id, id, o as nearest, gap from x where r = 1 and gap <= 86400""",
)
def nearest_event(spark, d):
    e = t(spark, d, "events")
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    return ordered.nearest(e.where(F.col("event_type") == lo), e.where(F.col("event_type") == hi), "user_id", "ts", "event_id", "event_id", 86400.0)


@query(
    "lww_sync",
    """with l as (select user_id, cast(max(epoch_us(ts)) as varchar) as l from events where event_id % 2 = 0 group by 1), r as (select user_id, cast(max(epoch_us(ts)) as varchar) as r from events where event_id % 2 = 1 group by 1)
select user_id as slug, case when coalesce(r, '') > coalesce(l, '') then 'pull' when coalesce(l, '') > coalesce(r, '') then 'push' else 'none' end as direction from l full join r using (user_id)""",
)
def lww_sync(spark, d):
    side = lambda k: t(spark, d, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("slug")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).cast("string").alias("updatedAt"))
    return sync.direction(side(0), side(1))


@query("latest_upsert", "select conv_id, arg_max(turn, turn) as turn, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by conv_id")
def latest_upsert(spark, d):
    return sync.latest(t(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "text")


@query(
    "mru_top12",
    """with x as (select user_id, event_type, max(ts) as ts from events group by 1, 2), y as (select *, cast(row_number() over (partition by user_id order by ts desc, event_type) as int) as rank from x)
select user_id, event_type, ts, rank from y where rank <= 12""",
)
def mru_top12(spark, d):
    return sync.recent(t(spark, d, "events").withColumn("ts", F.col("ts")), "user_id", "event_type", "ts")


@query(
    "throttle_10m",
    """with recursive s as (select *, row_number() over (partition by user_id order by ts, event_id) as r from events),
k as (select user_id, r, event_id, ts, ts as last, true as kept from s where r = 1
 union all select s.user_id, s.r, s.event_id, s.ts, case when epoch_us(s.ts) - epoch_us(k.last) >= 600000000 then s.ts else k.last end, epoch_us(s.ts) - epoch_us(k.last) >= 600000000 from k join s on s.user_id = k.user_id and s.r = k.r + 1)
select user_id, event_id from k where kept""",
)
def throttle_10m(spark, d):
    return activity.throttle(t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 600, "event_id").select("user_id", "event_id")


@query("change_detect", "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b <> event_type")
def change_detect(spark, d):
    return activity.changes(t(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def _days(spark, d):
    return activity.per_day(t(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_id") % 3 != 0)


def _bucket_sql(unit: str, fmt: str) -> str:
    return f"with n as (select cast(max(ts) as timestamp) as now from events) select strftime(date_trunc('{unit}', ts), '{fmt}') as key, count(*) filter (event_id % 3 <> 0) as mine, count(*) filter (event_id % 3 = 0) as ai from events, n where date_trunc('day', ts) >= now - interval 365 days group by 1"


def _bucket(unit):
    def run(spark, d):
        now = F.lit(t(spark, d, "events").agg(F.max("ts")).first()[0])
        return activity.rebucket(_days(spark, d), unit, now)

    return run


for _u, _f in (("day", "%Y-%m-%d"), ("week", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):
    query(f"activity_{_u}", _bucket_sql(_u, _f))(_bucket(_u))


@query(
    "activity_zero_fill",
    """with n as (select max(ts) as now from events), axis as (select strftime(date_trunc('week', now) - k * interval 7 days, '%Y-%m-%d') as key from n, range(0, 8) r(k)),
b as (select strftime(date_trunc('week', ts), '%Y-%m-%d') as key, count(*) filter (event_id % 3 <> 0) as mine, count(*) filter (event_id % 3 = 0) as ai from events, n where date_trunc('day', ts) >= now - interval 365 days group by 1)
select key, coalesce(mine, 0) as mine, coalesce(ai, 0) as ai from axis left join b using (key)""",
)
def activity_zero_fill(spark, d):
    now = F.lit(t(spark, d, "events").agg(F.max("ts")).first()[0])
    return activity.series(_days(spark, d), "week", now, 8)


@query(
    "gaps",
    """with g as (select l_orderkey, list_sort(list(distinct cast(l_linenumber as bigint))) as present from lineitem group by 1)
select l_orderkey, present, list_sort(list_filter(range(case when list_min(present) <= 3 then 1 else list_min(present) end, list_max(present) + 1), lambda x: not list_contains(present, x))) as missing from g""",
)
def gaps(spark, d):
    return ordered.gaps(t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n")), ["l_orderkey"], "n").withColumn("missing", F.array_sort("missing"))


@query("islands", "select l_orderkey, min(n) as lo, max(n) as hi from (select l_orderkey, n, n - row_number() over (partition by l_orderkey order by n) as g from (select distinct l_orderkey, cast(l_linenumber as bigint) as n from lineitem)) group by l_orderkey, g")
def islands(spark, d):
    return ordered.islands(t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n")), ["l_orderkey"], "n")


@query(
    "repeated_lines",
    r"""with k as (select distinct source, doc_id, substr(regexp_replace(trim(regexp_replace(lower(l), '\s+', ' ', 'g')), '\d+', '#', 'g'), 1, 120) as key, length(regexp_replace(trim(regexp_replace(lower(l), '\s+', ' ', 'g')), '\d+', '#', 'g')) as len from (select source, doc_id, unnest(string_split(text, chr(10))) as l from documents)),
s as (select source, count(distinct doc_id) as docs from documents group by 1 having count(distinct doc_id) >= 3)
select source, key, count(distinct doc_id) as n from k join s using (source) where len between 4 and 160 group by source, key, docs having count(distinct doc_id) >= greatest(3, ceil(docs * 0.05))""",
)
def repeated_lines(spark, d):
    return ordered.repeated_lines(t(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", share=0.05)


@query("cjk_ratio", r"select doc_id, case when length(l) > 0 then (length(l) - length(replace(l, '中', ''))) / length(l) else 0.0 end as ratio from (select doc_id, regexp_replace(replace(text, 'e', '中'), '[^\p{L}]', '', 'g') as l from documents)")
def cjk_ratio(spark, d):
    return t(spark, d, "documents").select("doc_id", fx.cjk_ratio(F.replace("text", F.lit("e"), F.lit("中"))).alias("ratio"))


@query("lang_infer", """with x as (select doc_id, case doc_id % 6 when 0 then ' ZH-cn' when 1 then 'eng' when 2 then 'fr' else '' end as l, case when doc_id % 2 = 0 then '中' || lang else lang end as t, case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then '中' || lang else source end as e from documents)
select doc_id, case when l = ' ZH-cn' then 'zh' when l = 'eng' then 'en' when contains(t, '中') and (e = '' or e = t) then 'zh' else 'en' end as guess from x""")
def lang_infer(spark, d):
    from foliant.operators import catalog

    k, zh = F.col("doc_id"), F.concat(F.lit("中"), "lang")
    lang = F.when(k % 6 == 0, " ZH-cn").when(k % 6 == 1, "eng").when(k % 6 == 2, "fr").otherwise("")
    return t(spark, d, "documents").select("doc_id", catalog.infer_lang(lang, F.when(k % 2 == 0, zh).otherwise(F.col("lang")), F.when(k % 5 == 0, "").when(k % 5 == 1, zh).otherwise(F.col("source"))).alias("guess"))


@query(
    "filler_stats",
    r"""with s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\$\$[\s\S]*?\$\$', ' ', 'g'), '\$[^$\n]*\$', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), '\s+', '', 'g') as s from documents),
x as (select doc_id, s, string_split(s, '') as cs, regexp_replace(s, '[^a-z]', '', 'g') as c from s where length(regexp_replace(s, '[^a-z]', '', 'g')) >= 60),
q as (select doc_id, ch, count(*) as k from (select doc_id, unnest(string_split(c, '')) as ch from x) group by 1, 2), r as (select doc_id, sum(k) as top from (select *, row_number() over (partition by doc_id order by k desc) as i from q) where i <= 20 group by 1)
select doc_id, len(list_filter(list_zip(cs[1:len(cs)-1], cs[2:]), lambda z: abs(unicode(z[2]) - unicode(z[1])) = 1)) / (len(cs) - 1) as seq, length(regexp_replace(s, '[^，。；：！？、（）「」『』《》〈〉…—,.;:!?()\[\]]', '', 'g')) / length(s) * 100 as punct, top / length(c) as top20 from x join r using (doc_id)""",
)
def filler_stats(spark, d):
    return ordered.filler_stats(t(spark, d, "documents"), "doc_id", letters="[a-z]")


@query("length_band", "select doc_id, case when r < 0.7 then 'error' when r < 0.85 then 'warning' else 'ok' end as band from (select doc_id, n_chars / (select avg(n_chars) from documents) as r from documents)")
def length_band(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    mean = docs.agg(F.avg("n_chars").alias("m"))
    return docs.join(F.broadcast(mean)).select("doc_id", rules.length_band(F.col("n_chars") / F.col("m"), 0.7, 0.85).alias("band"))


@query(
    "anchor_contains",
    """with w as (select item_id, substr(text, cast(k * ((length(text) - 40) // 4) + 1 as int), 40) as win from benchmark, range(0, 5) r(k) where length(text) >= 120)
select distinct item_id, doc_id from w join documents on contains(documents.text, win)""",
)
def anchor_contains(spark, d):
    from foliant.operators.containment import contains_windows

    return contains_windows(t(spark, d, "benchmark"), t(spark, d, "documents"), "item_id", "doc_id", "text")


@query(
    "jaccard_title",
    r"""with x as (select doc_id, source, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) as tk from documents),
c as (select source, tk, min(doc_id) as id from x where len(tk) > 0 group by 1, 2),
p as (select a.id as a, b.id as b, a.tk as ta, b.tk as tb from c a join c b on a.source = b.source and a.id < b.id and least(len(a.tk), len(b.tk)) >= 0.75 * greatest(len(a.tk), len(b.tk)))
select a, b, n as n_b from (select a, b from p where len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) >= 0.75) join (select c.id as b, count(*) as n from c join x on x.source = c.source and x.tk = c.tk group by 1) using (b)""",
)
def jaccard_title(spark, d):
    from foliant.operators.containment import jaccard_pairs

    docs = t(spark, d, "documents").select("doc_id", "source", "text")
    return jaccard_pairs(docs, "doc_id", "text", "source", 0.75).select("a", "b", "n_b")


@query(
    "rule_findings",
    r"""with x as (select doc_id, case doc_id % 7 when 0 then '<!--TLDR-->' || text when 1 then '<!--REFS_AUTO-->' || text when 2 then '[[[a]]] $$' || text when 3 then '| a < b |' || chr(10) || text when 4 then '见英文原文' || text when 5 then '# T' || chr(10) || 'A^{1}' || chr(10) || 'Received 3 May' || chr(10) || '## 要点' || chr(10) || text else text end as t from documents)
select doc_id, 'E' as level, 'marker' as rule from x where regexp_matches(t, '<!--(/?(SCI_Q|TLDR|SCORE|RELATED|KEYPOINTS|QA|ARTICLE_EN|ARTICLE|ORIGINAL)|TERMS_(START|END))-->')
union all select doc_id, 'E', 'odd_math' from x where len(regexp_extract_all(t, '\$\$')) % 2 = 1 union all select doc_id, 'E', 'refs_auto' from x where contains(t, '<!--REFS_AUTO-->') <> contains(t, '<!--/REFS_AUTO-->')
union all select doc_id, 'W', 'triple_bracket' from x where contains(t, '[[[') union all select doc_id, 'W', 'table_angle' from x where len(list_filter(string_split(t, chr(10)), lambda s: starts_with(ltrim(s), '|') and regexp_matches(regexp_replace(s, '\\lt|\\gt|&lt;|&gt;', '', 'g'), '(^|[^\\])[<>]'))) > 0
union all select doc_id, 'E', 'omission' from x where contains(t, '见英文原文') union all select doc_id, 'E', 'author_sup' from x where regexp_matches(t, '\^\{\d') and starts_with(t, '# T') union all select doc_id, 'E', 'forbidden_h2' from x where regexp_matches(t, '(?im)^##\s+(Key Points|要点|通俗摘要|Plain Language Summary)') union all select doc_id, 'E', 'journal_shell' from x where regexp_matches(t, '(?im)^(Correspondence to:|Citation:|Received \d|Accepted \d)')""",
)
def rule_findings(spark, d):
    k, x = F.col("doc_id"), F.col("text")
    put = F.when(k % 7 == 0, F.concat(F.lit("<!--TLDR-->"), x)).when(k % 7 == 1, F.concat(F.lit("<!--REFS_AUTO-->"), x)).when(k % 7 == 2, F.concat(F.lit("[[[a]]] $$"), x)).when(k % 7 == 3, F.concat(F.lit("| a < b |\n"), x)).when(k % 7 == 4, F.concat(F.lit("见英文原文"), x)).when(k % 7 == 5, F.concat(F.lit("# T\nA^{1}\nReceived 3 May\n## 要点\n"), x)).otherwise(x)
    own = [*rules.DOC_RULES, *rules.ZH_RULES, *rules.EN_RULES]
    return rules.findings(t(spark, d, "documents").withColumn("text", put), "doc_id", own).select("doc_id", "level", "rule")


@query(
    "rule_report",
    r"""with f as (select doc_id, 'E' as level, 'shouting' as rule from documents where regexp_matches(text, '[A-Z]{4,}!!') union all select doc_id, 'W', 'pipes' from documents where len(regexp_extract_all(text, '\|')) > 10)
select doc_id, count(*) filter (level = 'E') = 0 as ok, coalesce(list_sort(list(rule) filter (level = 'E')), []) as errors, coalesce(list_sort(list(rule) filter (level = 'W')), []) as warnings from f group by doc_id""",
)
def rule_report(spark, d):
    own: list[rules.Rule] = [("shouting", "E", lambda x: rules.rx(x, "[A-Z]{4,}!!"), ""), ("pipes", "W", lambda x: rules.n(x, r"\|") > 10, "")]
    return rules.report(rules.findings(t(spark, d, "documents"), "doc_id", own), "doc_id")


@query(
    "control_chars",
    r"""with x as (select doc_id, case when doc_id % 5 = 0 then text || chr(1) when doc_id % 5 = 1 then text || ' $$ {a $$' when doc_id % 5 = 2 then '<!-- EQ 3 -->' || text when doc_id % 5 = 3 then '$$' || text || chr(57344) else text end as t from documents)
select doc_id, 'control' as rule from x where regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]') union all select doc_id, 'leftover' from x where regexp_matches(t, '<!--\s*(EQ|TABLE|ABSTRACT|REFS)\b') union all select doc_id, 'private_use' from x where regexp_matches(t, '[\x{E000}-\x{F8FF}\x{FFFD}\x{FFFE}\x{1D400}-\x{1D7FF}]')
union all select doc_id, 'odd_math' from x where len(regexp_extract_all(t, '\$\$')) % 2 = 1 union all select doc_id, 'braces' from x where len(list_filter(regexp_extract_all(t, '\$\$([\s\S]*?)\$\$', 1), lambda b: len(regexp_extract_all(b, '\{')) <> len(regexp_extract_all(b, '\}')))) > 0""",
)
def control_chars(spark, d):
    k, x = F.col("doc_id"), F.col("text")
    put = F.when(k % 5 == 0, F.concat(x, F.lit("\x01"))).when(k % 5 == 1, F.concat(x, F.lit(" $$ {a $$"))).when(k % 5 == 2, F.concat(F.lit("<!-- EQ 3 -->"), x)).when(k % 5 == 3, F.concat(F.lit("$$"), x, F.lit("\ue000"))).otherwise(x)
    own = [r for r in rules.MATH_RULES if r[0] in ("control", "leftover", "private_use", "odd_math", "braces")]
    return rules.findings(t(spark, d, "documents").withColumn("text", put), "doc_id", own).select("doc_id", "rule")


@query(
    "html_headings",
    r"""with h as (select page_id, unnest(regexp_extract_all(html, '(?is)<h[23][^>]*>.*?</h[23]>')) as h from pages)
select page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as heading, cast(substr(h, 3, 1) as int) as level from h""",
)
def html_headings(spark, d):
    from foliant.operators import markdown

    return t(spark, d, "pages").select("page_id", F.explode(markdown.html_headings("html")).alias("h")).select("page_id", F.col("h.text").alias("heading"), "h.level")


@query("section_assign", "select p_partkey, i as line_no, case i when 0 then null when 1 then p_name when 2 then p_name else p_type end as section from part, range(0, 5) r(i)")
def section_assign(spark, d):
    md = F.concat(F.lit("front\n## "), "p_name", F.lit("\nbody\n##  "), "p_type", F.lit("\n### lower"))
    return ordered.sections(t(spark, d, "part").select("p_partkey", md.alias("text")), "p_partkey").select("p_partkey", "line_no", "section")


@query("url_encode_path", "select page_id, array_to_string(list_transform(string_split(url || '/a b*c', '/'), lambda x: url_encode(x)), '/') as encoded from pages")
def url_encode_path(spark, d):
    return t(spark, d, "pages").select("page_id", fx.url_encode_path(F.concat("url", F.lit("/a b*c"))).alias("encoded"))


@query("sentence_pick", r"""select doc_id, len(regexp_extract_all(text, '[.!?;]\s+')) + 1 as sentences from documents""")
def sentence_pick(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(fx.split_sentences("text")).cast("long").alias("sentences"))


@query(
    "vocab_import",
    """with b as (select lower(n_name) as key, n_name || ' one' as old, n_nationkey as k from nation where n_nationkey % 3 <> 0)
select lower(n_name) as key, case when n_nationkey % 3 = 0 then [n_name || ' ONE', 'about ' || n_name] else [n_name || ' one', 'about ' || n_name] end as examples, case when n_nationkey % 3 = 0 then 'added' else 'merged' end as status from nation""",
)
def vocab_import(spark, d):
    n = t(spark, d, "nation")
    book = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("word"), F.array(F.concat("n_name", F.lit(" one"))).alias("examples"))
    k = F.col("n_nationkey")
    said = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), w.alias("word"), x.alias("sentence")) for i, w, x in ((0, F.col("n_name"), F.concat("n_name", F.lit("  ONE"))), (1, F.lower("n_name"), F.concat(F.lit("about "), "n_name")), (2, F.col("n_name"), F.lit(" ")))]))
    words = n.select(k, said.alias("s")).select("s.word", F.regexp_replace("s.sentence", "  ", " ").alias("sentence"), (k * 3 + F.col("s.i")).alias("ord"))
    return sync.import_vocab(book, words).select("key", "examples", "status")


@query("keyword_chips", r"select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[；;,，]'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[.。]+$', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') as chips from documents")
def keyword_chips(spark, d):
    return t(spark, d, "documents").select("doc_id", fx.chips("text").alias("chips"))


@query("share_valid", "select o_orderkey from orders where not (o_orderstatus = 'F') and (o_orderkey % 5 = 0 or strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01')")
def share_valid(spark, d):
    expires = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t(spark, d, "orders").where(sync.share_valid(F.col("o_orderstatus") == "F", expires, F.lit("1996-01-01"))).select("o_orderkey")


@query("user_cascade_delete", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def user_cascade_delete(spark, d):
    gone = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sync.cascade_delete(gone, "o_custkey", t(spark, d, "orders"))[0].select("o_orderkey")


@query("weighted_mode", "select l_suppkey, arg_max(l_linenumber, (w, -l_linenumber)) as mode, max(w) as weight from (select l_suppkey, l_linenumber, sum(l_quantity) as w from lineitem group by 1, 2) group by 1")
def weighted_mode(spark, d):
    return ordered.weighted_mode(t(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity")


@query(
    "two_col_order",
    """with s as (select l_orderkey as page, l_linenumber as id, l_quantity * 10 as x0, l_extendedprice as y0, l_quantity > 40 as wide from lineitem),
b as (select *, sum(case when wide then 1 else 0 end) over (partition by page order by y0, id rows between unbounded preceding and current row) as band from s)
select page, id, cast(row_number() over (partition by page order by band, case when wide then 0 when x0 >= 250 then 2 else 1 end, y0, id) as int) as pos from b""",
)
def two_col_order(spark, d):
    from foliant.operators.layout import reading_order

    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") * 10).alias("x0"), F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") > 40).alias("wide"))
    return reading_order(s, ["page"], "id", 250.0).select("page", "id", "pos")


@query("content_hash_dedupe", "select sha256(text) as digest, min(doc_id) as kept, count(*) as copies from documents group by 1 having count(*) > 1")
def content_hash_dedupe(spark, d):
    from foliant.sources import sinks

    return sinks.repeated_content(t(spark, d, "documents"), "doc_id", "text")


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("orphans", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def orphans(spark, d):
    from foliant.sources import sinks

    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.orphans(t(spark, d, "orders").select("o_orderkey"), li, "o_orderkey")


@query("stale", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def stale(spark, d):
    from foliant.sources import sinks

    name = lambda key, kind: F.concat(F.col(key).cast("string"), F.lit(kind)).alias("name")
    mirror = t(spark, d, "part").select("p_partkey", name("p_partkey", ".png.webp"))
    return sinks.stale_images(mirror, t(spark, d, "lineitem").where("l_quantity > 45").select(name("l_partkey", ".png"))).select("p_partkey")


@query("inc_copy_decision", "select s.event_id, case when d.event_id is null or s.value <> d.value or d.ts < s.ts - interval 2 seconds then 'copy' else 'skip' end as action from events s left join (select event_id, value, ts - interval 1 second * (event_id % 4) as ts from events where event_id % 10 <> 0) d using (event_id)")
def inc_copy_decision(spark, d):
    from foliant.sources.files import copy_plan

    e = t(spark, d, "events")
    src = e.select("event_id", F.col("value").alias("size"), F.col("ts").alias("mtime"))
    dst = e.where("event_id % 10 <> 0").select("event_id", F.col("value").alias("size"), (F.col("ts") - F.make_dt_interval(secs=F.col("event_id") % 4)).alias("mtime"))
    return copy_plan(src, dst, "event_id")


@query("set_operations", "select k, case when l is null then 'missing' when p is null then 'extra' else 'both' end as side from (select distinct p_partkey as k, 1 as p from part where p_size > 10) full join (select distinct l_partkey as k, 1 as l from lineitem where l_quantity > 40) using (k)")
def set_operations(spark, d):
    return ordered.set_differences(t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")), t(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k")), "k")


@query("natural_order", "select p_partkey, p_brand, ascii(substr(p_brand, 1, 1)) as prefix, [cast(regexp_extract(p_brand, '(\\d+)', 1) as int)] as numbers from part")
def natural_order(spark, d):
    key = fx.natural_key("p_brand")
    return t(spark, d, "part").orderBy(key, "p_partkey").select("p_partkey", "p_brand", key["prefix"].alias("prefix"), key["numbers"].alias("numbers"))
