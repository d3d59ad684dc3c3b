"""Catalogue operators on literal rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import activity, catalog, citations, figures, layout, links, markdown, ordered, protect, rules, search, sync
from foliant.sources import files, sinks


def one(spark, *values):
    """Evaluates columns on a single row."""
    return spark.range(1).select(*[v.alias(f"c{i}") for i, v in enumerate(values)]).first()


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark,
        fx.link_key_unicode(lit("Étude CFD-DEM ①")), fx.link_key_ascii(lit("Étude CFD-DEM 中")), fx.search_text(lit("A/B-c·d")), fx.line_key(lit("  Page  12 of 300 ")),
        fx.file_name(lit('a/b:c*?  "d". ')), fx.yaml_quote(lit('a"b\\c')), fx.cjk_ratio(lit("中文ab")), fx.equation_id(lit("A 01.002'")),
        fx.url_encode_path(lit("a b/c*~é")), fx.encode_asset_url(lit("https://h.org/a%20b/c d")), fx.sentence_for_word(lit("One cat. Two dogs! Cats here."), lit("dogs")), fx.count_hits(lit("aXa.x a"), lit("a")),
        fx.chips(lit("a；b;, c。 ,，")), fx.as_list(lit('["a", b , ]')), fx.join_lines(F.array(lit("exam-"), lit("ple of"), lit("中"), lit("文"))), fx.title_case_surname(lit("SMITH")),
        fx.jaccard(lit("The cats sat"), lit("the cats ran")), fx.doi_key(lit("https://doi.org/10.1/AB")), fx.strip_heading_emoji(lit("📥 Title")), fx.heading_slug(lit("A b!"), lit(3)),
    )
    assert list(r) == ["étudecfddem①", "tudecfddem中", "a b c d", "page # of #", "a b c d", '"a\\"b\\\\c"', 0.5, "A.1.2′", "a%20b/c%2A~%C3%A9", "https://h.org/a%20b/c%20d", "Two dogs!", 3, ["a", "b", "c"], ["a", "b"], "example of 中文", "Smith", 0.5, "10.1/ab", "Title", "h3-a-b"]


def test_section_functions(spark):
    md = "---\na: 1\n---\n# T\n\n## One\nline\n<!-- c -->\n- **题目**：[x](y) z\n## Two\n\n$$a$$ text $b$ `c`\n"
    lit = F.lit(md)
    r = one(spark, fx.section_after(lit, "One"), fx.field_from_card(lit, "题目"), fx.drop_section(lit, "One"), fx.strip_math(lit), fx.strip_frontmatter(lit))
    assert r[0] == "line\n- **题目**：[x](y) z" and r[1] == "x z" and "line" not in r[2] and "$" not in r[3] and r[4].startswith("# T")


def test_unicode_udfs(spark):
    r = spark.createDataFrame([("Étude №1", "Müller-Ö", "[A](b) Ｘ １")], "a string, b string, c string").select(fx.ascii_name_udf("a"), fx.author_key_udf("b"), fx.reference_identity_udf("c")).first()
    assert list(r) == ["EtudeNo1", "mullero", "ax1"]


def test_frontmatter(spark):
    md = "---\ntitle: \"A: b\"\ntags:\n  - x\n  - y\nlist: [p, 'q']\nempty:\nbad line\nkind: one\n  - two\n---\nbody"
    fm = catalog.frontmatter(F.lit(md))
    r = one(spark, fm, catalog.field(fm, "title"), catalog.fields(fm, "tags"), catalog.field(fm, "nope"), catalog.frontmatter(F.lit("no")), catalog.plain_frontmatter(F.lit(md))["body"])
    assert r[0] == {"title": ["A: b"], "tags": ["x", "y"], "list": ["p", "q"], "empty": [], "kind": ["one", "two"]}
    assert (r[1], r[2], r[3], r[4], r[5]) == ("A: b", ["x", "y"], "", {}, "\nbody")


def test_catalogue_scalars(spark):
    lit = F.lit
    r = one(
        spark,
        catalog.slug(lit("Smith_2020"), lit("x")), catalog.slug(lit(None).cast("string"), lit("中")), catalog.infer_kind(F.array(lit("综述")), lit("")), catalog.infer_status(lit("已读"), lit(""))["visibility"],
        catalog.infer_lang(lit(""), lit("中文"), lit("")), catalog.infer_lang(lit(""), lit("中文"), lit("English")), catalog.score(lit("8.5/10")), catalog.fallback_caption(lit("p_page03_figA2.png")), catalog.mime(lit("a/b.PNG")),
        catalog.titles(lit("中"), lit("En"), lit("zh"))["secondary"], catalog.with_origin(lit('{"u":"/vault/x"}'), "https://h/"),
    )
    assert list(r) == ["smith-2020", "paper", "review", "shared", "zh", "en", "8.5", "第 3 页 · 图 A.2", "image/png", "En", '{"u":"https://h/vault/x"}']


def test_vault_scan(spark, tmp_path):
    p = tmp_path / "Papers" / "P1"
    (p / "content").mkdir(parents=True)
    (tmp_path / "Topics" / "Dom").mkdir(parents=True)
    (p / "P1.md").write_text("---\nnoteType: index\npid: P1\ntitle: A Title\nyear: 2021\nreading: 已读\ntags: [主题/a, review]\n---\n")
    (p / "_skip.md").write_text("---\nnoteType: index\n---\n")
    (tmp_path / "Papers" / "Lost.md").write_text("---\nnoteType: index\npid: Lost\n---\n")
    for s in (".pdf", ".正文.md"):
        (p / "content" / f"P1{s}").write_text("x")
    (tmp_path / "Topics" / "Dom" / "t.md").write_text("---\ntitle: T\nupdatedAt: 2024-01-01\n---\n")
    (r,) = catalog.papers(spark, str(tmp_path)).collect()
    assert (r.pid, r.year, r.status, r.hasPdf, r.hasNotes, r.hasTranslation, r.kind) == ("P1", 2021, "ready", True, False, True, "review")
    (t,) = catalog.topic_docs(spark, str(tmp_path)).collect()
    assert (t.slug, t.title, t.domain) == ("topic-1", "T", "Dom")
    reg = spark.createDataFrame([('{"k1":{"term":"b","domain":"x/y","aliases":["", "B1"],"note":"n.md","usages":[{"paper":""},{"paper":"p"}]},"k2":{"term":"A","domain":["z"]}}',)], "value string")
    a, b = catalog.terms(reg).collect()
    assert (a.key, a.domains, b.domains, b.aliases, b.noteStem, [u.paper for u in b.usages]) == ("k2", ["z"], ["x/y"], ["B1"], "n", ["p"])


def test_images_in_figure_order(spark):
    ls = spark.createDataFrame([("b.png", 1), ("a.png", 2), ("c.png", 3), ("c.png.webp", 4), ("x.txt", 5)], "name string, size long")
    meta = spark.createDataFrame([("c.png", "cap", 1)], "name string, caption string, `order` int")
    assert [r.name for r in catalog.images(ls, meta).collect()] == ["c.png", "a.png", "b.png"]


def test_facets_ignore_their_own_choice(spark):
    rows = spark.createDataFrame([(1, "a", ["x/1", "x/2"]), (2, "b", ["y"]), (3, "a", ["y/3"])], "id int, type string, domains array<string>")
    majors = F.transform("domains", lambda d: F.split(d, "/")[0])
    got = search.facet_counts(rows, {"type": F.col("type"), "domain": majors}, {"type": F.col("type") == "a"}).collect()
    assert {(r.facet, r.value): r.n for r in got} == {("type", "a"): 2, ("type", "b"): 1, ("domain", "x"): 1, ("domain", "y"): 1}


def test_search_predicates(spark):
    d = spark.createDataFrame([("a/b",), ("a",), ("ab",), ("c/a",), ("",)], "domain string")
    pick = lambda w: [r[0] for r in d.where(search.domain_matches("domain", w)).collect()]
    assert pick("a") == ["a/b", "a", "c/a"] and len(pick("all")) == 5
    assert [r[0] for r in d.where(search.topic_matches("domain", "a/b")).collect()] == ["a/b", "a", ""]
    assert one(spark, search.display_tags(F.array(*map(F.lit, ("主题/a", "a", "主题/b/c", "")))))[0] == ["a"]
    assert one(spark, search.short_authors(F.array(F.lit("A"), F.lit("B"))))[0] == "A et al."


def test_filter_blocks(spark):
    r = search.filter_blocks(spark.createDataFrame([("# A\nfoo\n\nbar Foo\n\n# B\nbaz",)], "text string"), "foo").first()
    assert r.hits == 2 and r.blocks == "# A\nfoo\n\nbar Foo"


def test_activity_window_and_zero_fill(spark):
    days = spark.createDataFrame([("2024-01-07", 1, 0), ("2024-01-08", 2, 1), ("2023-01-08", 5, 5), ("bad", 9, 9)], "day string, mine int, ai int")
    now = F.lit(dt.datetime(2024, 1, 8, 12))
    assert {r.key: r.mine for r in activity.rebucket(days, "week", now).collect()} == {"2024-01-01": 1, "2024-01-08": 2}
    s = activity.series(days, "week", now, 3).orderBy("key").collect()
    assert [(r.key, r.mine) for r in s] == [("2023-12-25", 0), ("2024-01-01", 1), ("2024-01-08", 2)]
    assert activity.chart_series(days, now).count() == 21
    assert [one(spark, activity.bucket_key(F.lit("2024-03-05"), u))[0] for u in ("day", "week", "month", "year")] == ["2024-03-05", "2024-03-04", "2024-03", "2024"]
    assert list(one(spark, activity.week_label(F.lit("2024-03-04")), activity.month_label(F.lit("2024-03")))) == ["3/4", "3月"]
    m = activity.merged(days.limit(1), spark.createDataFrame([("2024-01-07", 4)], "day string, n int")).first()
    assert (m.mine, m.ai) == (5, 0)


def test_throttle_boundaries(spark):
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in (0, 599, 600, 900, 1200)]
    e = spark.createDataFrame([("a", t) for t in at], "k string, ts timestamp")
    assert sorted(r.ts for r in activity.throttle(e, "k", "ts").collect()) == [at[0], at[2], at[4]]


def test_last_write_wins(spark):
    doc = "slug string, updatedAt string"
    local = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", "3")], doc)
    remote = spark.createDataFrame([("a", "2"), ("b", "2"), ("d", "1"), ("e", "1")], doc)
    assert {r.slug: r.direction for r in sync.direction(local, remote).collect()} == {"a": "pull", "b": "none", "c": "none", "d": "push", "e": "pull"}
    assert sync.newer_collection(local, remote).first().direction == "push"
    kind = "slug string, note string, highlights array<string>, vocab array<string>, updatedAt string"
    h = sync.hydrate(spark.createDataFrame([("a", "mine", ["h"], [], "1"), ("b", "mine", [], [], "2")], kind), spark.createDataFrame([("a", "", [], ["v"], "2"), ("b", "theirs", [], [], "2")], kind)).orderBy("slug").collect()
    assert [tuple(r) for r in h] == [("a", "mine", ["h"], ["v"], "2"), ("b", "mine", [], [], "2")]


def test_sessions_merge(spark):
    kind = "slug string, title string, tab string, scroll int, progress map<string,int>, at long"
    a = spark.createDataFrame([("x", "t", "txt", 1, {"txt": 1, "article": 5}, 10)], kind)
    b = spark.createDataFrame([("x", "u", "txt", 2, {"txt": 2}, 11), ("y", "v", "txt", 0, {}, 5)], kind)
    rows = sync.merge_sessions(a, b).collect()
    assert [(r.slug, r.title, r.progress) for r in rows] == [("x", "u", {"txt": 2, "article": 5}), ("y", "v", {})]
    assert list(one(spark, sync.clamp_scroll(F.lit("3.6")), sync.clamp_scroll(F.lit(-1.0)), sync.clamp_scroll(F.lit(float("nan"))), sync.reading_tab(F.lit("x")))) == [4, 0, 0, "article"]


def test_vocabulary(spark):
    book = spark.createDataFrame([("Cat", ["A cat."])], "word string, examples array<string>")
    words = spark.createDataFrame([("cat", " a  CAT. ", 1), ("cat", "Another cat", 2), ("dog", "A dog", 3), (" ", "x", 4)], "word string, sentence string, ord int")
    rows = {r.key: (r.word, r.examples, r.status) for r in sync.import_vocab(book, words).collect()}
    assert rows == {"cat": ("Cat", ["A cat.", "Another cat"], "merged"), "dog": ("dog", ["A dog"], "added")}
    g = sync.match_gloss(spark.createDataFrame([("a", 0), ("b", 1)], "word string, ord int"), spark.createDataFrame([("B", "eb", "zb", 0), ("x", "ex", "zx", 1)], "word string, en string, zh string, ord int"))
    assert {r.word: r.en for r in g.collect()} == {"a": "eb", "b": "eb"}
    v = spark.createDataFrame([("cat", "A cat."), ("dog", "D")], "word string, context string")
    t = sync.toggle_pair(v, spark.createDataFrame([("Cat", "a  cat."), ("cow", "C")], "word string, context string"))
    assert sorted(r.word for r in t.collect()) == ["cow", "dog"]


def test_shares_and_access(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 0, "2024-01-02"), (3, 0, "2024-01-01"), (4, 1, None)], "id int, revoked int, e string")
    assert [r.id for r in rows.where(sync.share_valid(F.col("revoked"), F.col("e"), F.lit("2024-01-02"))).collect()] == [1, 2]
    ok = one(spark, sync.may_read(F.lit("/vault/papers/a%20b/x?q"), F.lit(False), F.lit("a b")), sync.may_read(F.lit("/vault/papers/c/x"), F.lit(False), F.lit("a b")))
    assert list(ok) == [True, False]


def test_links(spark):
    terms = spark.createDataFrame([("k1", 1, "Alpha", ["A-1"]), ("k2", 2, "alpha", ["B"])], "key string, ord int, term string, aliases array<string>")
    amap = links.alias_map(terms, ["term"], "ord")
    assert {r.alias: r.key for r in amap.collect()} == {"alpha": "k1", "a1": "k1", "b": "k2"}
    ls = spark.createDataFrame([("_nav",), ("P1",), ("ALPHA",), ("zzz",)], "target string")
    pids = spark.createDataFrame([("P1", "s1")], "pid string, slug string")
    assert {r.target: (r.kind, r.ref) for r in links.resolve_links(ls, "target", pids, amap).collect()} == {"_nav": ("nav", None), "P1": ("paper", "s1"), "ALPHA": ("term", "k1"), "zzz": ("text", None)}
    md = "see [[P1]] and [[Q|label]] ![[img 1.png|w]] [[#here]]"
    r = one(spark, links.wiki_targets(F.lit(md)), links.delink(F.lit(md), F.array(F.lit("P1"))), links.rewrite_embeds(F.lit(md), "/i"))
    assert r[0] == ["P1", "Q"] and r[1].startswith("see [[P1]] and label") and "![img 1.png](/i/img%201.png)" in r[2]


def test_citations(spark):
    refs = ["[1] Smith, J., and Jones, K.: A title, J. Geo., 12, 1, 2018.", "[2] PRAKASH N, MANCONI A, LOEW S. Mapping landslides[J]. RS, 2020, 12: 3.", "[3] 张三, 李四. 题目[J]. 学报, 2019.", "[4] Aksoy B, Ercanoglu M (2012) Title. Nat Haz", "[5] A. Müller and B. Zed, Title, 2015a."]
    md = "Body (Smith and Jones, 2018) and [1, 3–4] `[1]` and (Nobody, 1999).\n## 参考文献\n" + "\n".join(f"- **{r[:3]}** {r[4:]} ^ref-{i + 1}" for i, r in enumerate(refs))
    b = {r.n: r for r in citations.bibliography(spark.createDataFrame([(1, md)], "id int, text string"), "id").collect()}
    assert [b[str(i)].label for i in range(1, 6)] == ["Smith and Jones, 2018", "Prakash et al., 2020", "张三和李四, 2019", "Aksoy and Ercanoglu, 2012", "Müller and Zed, 2015a"]
    assert b["5"].keys == ["muller|2015a", "muller|2015"]
    entries = F.array(*[F.struct(F.lit(r.n).alias("n"), F.lit(r.label).alias("label"), F.array(*map(F.lit, r.keys)).alias("keys")) for r in b.values()])
    split = citations.split_at_refs(F.lit(md))
    out = one(spark, citations.link_citations_udf(split["body"], entries), citations.expand_numbers(F.lit("1, 3–5, 7-90, 9-8")), citations.cite_parts(F.lit("Smith et al., 2020a, b; 2021")))
    assert "[[#^ref-1|Smith and Jones, 2018]] and [[#^ref-1|1]],[[#^ref-3|3]],[[#^ref-4|4]]" in out[0] and "[[#^ref-4|" in out[0] and "`[1]`" in out[0] and "(Nobody, 1999)" in out[0]
    assert out[1] == ["1", "3", "4", "5", "7", "9"] and out[2].author == "Smith" and out[2].years == ["2020a", "2020b", "2021"]


def test_reference_lists(spark):
    page = "Intro\nReferences\n[1] First entry of a spe-\ncial kind\n2. Second\n[4] Last one\n[4] Again\nAcknowledgements\n[9] no"
    r = citations.references(spark.createDataFrame([(1, page)], "id int, text string"), "id")
    assert sorted((x.num, x.text) for x in r.collect()) == [(1, "First entry of a special kind"), (2, "Second"), (4, "Again"), (4, "Last one")]
    w = citations.reference_warnings(r, "id").first()
    assert (w.repeated, w.missing, w.empty) == ([4], [3], [])


def test_ordered_rows(spark):
    md = "# T\nlead\n## 1. One\ntext here that is long enough to count\n![[a.png]]\n\n**图 1：** cap\n## 2 Two\n\n### 2.1 Sub\nx\n"
    docs = spark.createDataFrame([(1, md)], "id int, text string")
    assert {r.key: r.chars > 20 for r in ordered.section_lengths(docs, "id").collect()} == {"_front": False, "1": True, "2": False}
    assert [r.title for r in ordered.empty_sections(docs, "id").orderBy("line_no").collect()] == ["2 Two", "2.1 Sub"]
    (c,) = ordered.figure_captions(docs, "id").collect()
    assert (c.image, c.ordinal, c.caption) == ("a.png", 1, "**图 1：** cap")
    n = spark.createDataFrame([(k,) for k in (1, 2, 3, 5)], "n long").withColumn("k", F.lit(1))
    assert ordered.format_runs(ordered.islands(n, ["k"], "n"), ["k"]).first().runs == "1–3、5"
    assert ordered.gaps(n, ["k"], "n").first().missing == [4]
    p = ordered.paragraphs(spark.createDataFrame([(1, "a\nb\n\n$$\nx\n$$\n# h\nc\n| t |\n")], "id int, text string"), "id").orderBy("start").collect()
    assert [r.para for r in p] == ["a b", "c"]


def test_rules(spark):
    texts = {1: "fine", 2: "$$ x", 3: "[[[a]]]", 4: "| a < b |\n| \\lt &lt; |", 5: "x <!--TLDR-->", 6: "<!--REFS_AUTO-->"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {(r.id, r.rule) for r in rules.findings(docs, "id", rules.DOC_RULES).collect()}
    assert got == {(2, "odd_math"), (3, "triple_bracket"), (4, "table_angle"), (5, "marker"), (6, "refs_auto")}
    rep = {r.id: (r.ok, r.errors, r.warnings) for r in rules.report(rules.findings(docs, "id", rules.DOC_RULES), "id").collect()}
    assert rep[2] == (False, ["odd_math"], []) and rep[3] == (True, [], ["triple_bracket"])
    m = spark.createDataFrame([(1, "$$a{b$$"), (2, "a_{x} b^{y} c_{z}"), (3, "$$\\tag{1}\\tag{2}$$"), (4, "\ue000"), (5, "Received: 2 May"), (6, "\x01")], "id int, text string")
    assert {(r.id, r.rule) for r in rules.findings(m, "id", rules.MATH_RULES).collect()} == {(1, "braces"), (2, "stray_some"), (3, "multi_tag"), (4, "private_use"), (5, "shell"), (6, "control")}
    en = spark.createDataFrame([(1, "# T\nA^{1}, B\n## Key Points\n"), (2, "# T\nA\n## Highlights\n")], "id int, text string")
    assert {(r.id, r.rule) for r in rules.findings(en, "id", rules.EN_RULES).collect()} == {(1, "author_sup"), (1, "forbidden_h2")}
    tree = [(".env", ""), (".env.example", ""), ("a/b.db", ""), ("c.py", "sk-" + "a" * 24), ("d.py", "sk-short"), ("target/x.py", ""), ("vault/y", ""), ("a/我的笔记.md", ""), ("p.txt", "see C:\\Users\\me"), ("examples/vault/x.pdf", "sk-" + "a" * 24), ("examples/vault/Papers/D/P.md", "")]
    got = {(r.path, r.rule) for r in rules.public_tree(spark.createDataFrame(tree, "path string, text string")).collect()}
    assert got == {(".env", "env"), ("a/b.db", "runtime"), ("c.py", "credential"), ("target/x.py", "folder"), ("vault/y", "folder"), ("a/我的笔记.md", "runtime"), ("p.txt", "machine_path")}
    assert {r.rule for r in rules.public_tree(spark.createDataFrame([("b/x.pdf", "")], "path string, text string")).collect()} == {"one_pdf", "one_index"}
    e = spark.createDataFrame([(1, "1", 1000), (1, "abstract", 1000), (1, "9", 10)], "id int, key string, chars long")
    z = spark.createDataFrame([(1, "1", 100), (1, "摘要", 400)], "id int, key string, chars long")
    assert {r.key: r.band for r in rules.fidelity(e, z, "id", {"abstract": "摘要"}).collect()} == {"1": "error", "abstract": "ok"}


def test_layout(spark):
    cap = spark.createDataFrame([(1, "1", 60.0, 320.0, 300.0, 330.0), (1, "2", 60.0, 700.0, 300.0, 710.0)], "page int, num string, x0 double, y0 double, x1 double, y1 double")
    reg = spark.createDataFrame([(1, 50.0, 60.0, 330.0, 280.0), (1, 60.0, 285.0, 300.0, 310.0), (1, 400.0, 1.0, 450.0, 20.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    (r,) = layout.assign_regions(cap, reg, ["page"]).collect()
    assert (r.num, r.x0, r.y0, r.x1, r.y1) == ("1", 50.0, 60.0, 330.0, 310.0)
    u = layout.unite_rects(reg, ["page"]).collect()
    assert sorted((x.x0, x.y1) for x in u) == [(50.0, 310.0), (400.0, 20.0)]
    nan = float("nan")
    ok = [one(spark, layout.valid_rect(*[F.lit(float(v)) for v in b], F.lit(400.0), F.lit(500.0)))[0] for b in ((1, 2, 3, 4), (3, 2, 1, 4), (1, 2, 500, 4), (nan, 1, 2, 3))]
    assert ok == [True, False, False, False]
    sp = spark.createDataFrame([(1, "base", 0.0, 30.0, 0.0, 100.0, False), (1, "2", 31.0, 34.0, 0.0, 97.0, True)], "page int, t string, x0 double, x1 double, y0 double, by double, small boolean")
    (s,) = layout.attach_scripts(sp, ["page"], "t").collect()
    assert (s.base, s.role) == ("base", "sup")
    words = [("two", 0.0, 20.0), ("words", 23.0, 50.0), ("close", 50.5, 70.0), ("far", 120.0, 140.0)]
    scattered = [(1, t, x0, y - 8.0, x1, y, y, 10.0) for y in (100.0, 112.0, 140.0) for t, x0, x1 in reversed(words)] + [(1, "up", 70.5, 90.0, 75.0, 97.0, 97.0, 6.0), (1, " ", 0.0, 0.0, 1.0, 1.0, 1.0, 10.0), (2, "z", 0.0, 0.0, 9.0, 9.0, 9.0, 0.0)]
    ln = layout.regroup_lines(spark.createDataFrame(scattered, "page int, t string, x0 double, y0 double, x1 double, y1 double, by double, size double"), ["page"]).orderBy("page", "block", "line").collect()
    # the raised word lies over 2.1 points off the line's baseline; two lines make a block, a third stands apart
    assert [x.text for x in ln].count("two wordsclose") == 3 and ln[-1].text == "z"
    assert len({x.block for x in ln if x.page == 1 and x.text == "two wordsclose"}) == 2 and sum(x.text == "far" for x in ln) == 3
    el = spark.createDataFrame([(1, 1, "It goes"), (1, 2, "on here."), (1, 3, "New one"), (1, 4, "- item"), (1, 5, "(said) “so.”"), (1, 6, "not joined"), (1, 7, "exam-"), (1, 8, "ple; é"), (1, 9, "École"), (1, 10, "中"), (1, 11, "文")], "doc int, ord int, text string")
    assert [r.text for r in layout.merge_paragraphs(el, "doc", "ord").orderBy("ord").collect()] == ["It goes on here.", "New one", "- item (said) “so.”", "not joined example; é", "École", "中文"]
    el = spark.createDataFrame([(1, 1, "para", "It goes"), (1, 2, "caption", "on"), (1, 3, "para", "and here")], "doc int, ord int, kind string, text string")
    assert [(r.kind, r.text) for r in layout.merge_paragraphs(el, "doc", "ord").orderBy("ord").collect()] == [("para", "It goes"), ("caption", "on"), ("para", "and here")]
    h = [one(spark, layout.heading_level(F.lit(t), F.lit(s), F.lit(b), F.lit(10.0)))[0] for t, s, b in (("2.1 Methods", 10.0, False), ("2.1 Methods", 10.0, True), ("3 Theory", 11.0, False), ("1 2 = 3", 14.0, True), ("B.1 More", 12.0, False), ("References", 10.0, False), ("a b s t r a c t", 10.0, False), ("plain text", 10.0, False), ("Big", 14.0, False), ("Bold", 11.0, True), ("Ends here.", 14.0, True))]
    assert h == [0, 3, 2, 0, 3, 2, 2, 0, 3, 3, 0]


def test_markdown(spark):
    html = "<h1>T</h1><p>A<sup>1</sup>, B</p><h2>📥 One</h2><p>x</p><h3>Two</h3><h2>Highlights</h2><ul>AI</ul>"
    r = one(spark, markdown.html_headings(F.lit(html)), markdown.inject_ids(F.lit(html)), markdown.highlights(F.lit(html)), markdown.byline(F.lit(html)))
    assert [(h.id, h.text, h.level) for h in r[0]] == [("h0-one", "One", 2), ("h1-two", "Two", 3), ("h2-highlights", "Highlights", 2)]
    assert '<h2 id="h0-one">' in r[1] and '<h3 id="h1-two">Two' in r[1] and r[1].startswith("<h1>")
    assert r[2].body == "<ul>AI</ul>" and r[2].ai and r[3] == ["A, B"]
    md = "---\na: b\n---\n<!-- c -->\n> 返回索引：x\n**图 1：**说明 ｜ [🔗 DOI](https://doi.org/10.1234/a%20b)\n\n\n\n![[x.png]]"
    assert one(spark, markdown.preprocess(F.lit(md), "/i"))[0] == "**图 1：** 说明 [https://doi.org/10.1234/a b](https://doi.org/10.1234/a%20b)\n\n![x.png](/i/x.png)"
    moved = one(spark, markdown.reorder_sections(F.lit("# A\n## ❓ 问答\nq\n# 🔬 深度分析\nd\n# B\ne")))[0]
    assert moved == "# A\n\n# 🔬 深度分析\nd\n\n## ❓ 问答\nq\n# B\ne"
    assert list(one(spark, markdown.reader_href(F.lit("s"), F.lit("txt"), F.lit("")), markdown.compare_href(F.lit("a"), F.lit("a"), F.lit("")), markdown.short_title(F.lit("x" * 20)), markdown.word_shape(F.lit("don’t")))) == ["/reader/s?tab=txt", "/reader/a", "x" * 16 + "…", True]


MD = "## H\n\nText $a_1$ and `c $x$`.\n\n$$E=mc^2 \\tag{1}$$\n\n![[f.png]]\n\n| a | 12.5 |\n|---|---|\n\n```\n$no$\n```\n\n## References\n[1] x"


def test_protection_round_trip(spark):
    locked, tokens = protect.lock(MD)
    assert [t[1] for t in tokens] == ["math_inline", "code_inline", "math_block", "image", "table_cell", "code_fence", "references"]
    assert protect.restore(locked.replace("Text", "文本"), locked, tokens) == (MD.replace("Text", "文本"), [])
    bad = {"token_missing": locked.replace(tokens[0][0], ""), "token_repeated": locked.replace(tokens[0][0], tokens[0][0] * 2), "token_unknown": locked + "⟦WS999999⟧", "token_order": locked.replace(tokens[0][0], "@").replace(tokens[1][0], tokens[0][0]).replace("@", tokens[1][0]), "new_protected": locked.replace("Text", "Text $z$"), "blocks": locked + "\n\nmore", "empty_block": locked.replace("## H", "")}
    for error, text in bad.items():
        out, errors = protect.restore(text, locked, tokens)
        assert out == "" and error in errors or error == "empty_block" and errors, error
    df = spark.createDataFrame([(MD,), (None,)], "md string").withColumn("l", protect.lock_udf("md"))
    r = df.select(protect.restore_udf("l.text", "l.text", "l.tokens").alias("r"), protect.protected_spans_udf("md").alias("s")).collect()
    assert r[0].r.text == MD and r[0].r.errors == [] and len(r[0].s) == 7 and r[1].s == []
    assert list(one(spark, protect.unpaired_dollar(F.lit("a $b$ $$c$$ `$`")), protect.unpaired_dollar(F.lit("a $b")))) == [False, True]
    z = one(spark, protect.insert_supplement(F.lit("x\n## 摘要\ny"), F.lit(">【说明】n"), ), protect.insert_supplement(F.lit("x\n## 摘要\ny"), F.lit(">【说明】$n$")))
    assert z[0] == "x\n>【说明】n\n\n## 摘要\ny" and z[1] == "x\n## 摘要\ny"


def test_compare_protected(spark):
    kind = "id int, md string"
    en, zh = (spark.createDataFrame([(1, t)], kind).select("id", protect.protected_spans_udf("md").alias("spans")) for t in ("$a$ $b$", "$a$ $c$ `d`"))
    assert [(r.pos, r.en, r.zh) for r in protect.compare_protected(en, zh, "id").orderBy("pos").collect()] == [(1, "$b$", "$c$"), (2, None, "`d`")]


def test_figures_and_accounts(spark):
    rec = "num string, status string, reviewed boolean, reviewNote string, reviewedAt string, file string, sourcePage int, bbox array<double>"
    r = spark.createDataFrame([("1", "cut", True, "ok", "t", "a.png", 1, [1.0, 2.0, 3.0, 4.0]), ("2", "cut", False, "", None, "../b.png", 9, [1.0]), ("3", "missing", True, "ok", None, "c.png", 1, None)], rec)
    lay = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "num string")
    assert {x.num: x.error for x in figures.review_errors(lay, r).collect()} == {"2": "unreviewed", "3": "missing", "4": "no_record"}
    g = {x.num: x.g for x in r.select("num", figures.geometry(F.lit(400.0), F.lit(500.0), F.lit(2)).alias("g")).collect()}
    assert g == {"1": [], "2": ["file", "page", "box"], "3": ["box"]}
    assert {x.status: x.n for x in figures.status_counts(r).collect()} == {"cut": 2, "missing": 1, "carry": 0, "manual": 0, "fallback": 0, "error": 0}
    assert [x.reviewed for x in figures.clear_review(r, F.col("num") == "1").orderBy("num").collect()] == [False, False, True]
    with pytest.raises(ValueError):
        figures.approve(r, "1", " ", "now")
    a = spark.createDataFrame([(1, "x" * 50), (2, "abc"), (2, "abc"), (4, "z")], "num int, key string")
    b = spark.createDataFrame([(1, "x" * 50), (2, "abc"), (3, "q"), (4, "y")], "num int, key string")
    assert {x.num: x.error for x in figures.reference_check(a, b).collect()} == {2: "duplicate", 3: "missing", 4: "identity"}
    users = spark.createDataFrame([(1, "A@b.c", "", "admin", 0)], "id int, email string, displayName string, role string, disabled int")
    every, bad = figures.create_users(users, spark.createDataFrame([(2, "a@B.c"), (3, "bad"), (4, "n@b.c")], "id int, email string"))
    assert every.count() == 2 and {x.id for x in bad.collect()} == {2, 3} and users.select(*figures.public_user()).first().displayName == "A"


def test_sinks_and_files(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    src = spark.createDataFrame([("a", 1, now), ("b", 2, now), ("c", 3, now), ("d", 4, now)], "name string, size int, mtime timestamp")
    dst = spark.createDataFrame([("a", 1, now - dt.timedelta(seconds=2)), ("b", 9, now), ("c", 3, now - dt.timedelta(seconds=3))], "name string, size int, mtime timestamp")
    assert {r.name: r.action for r in files.copy_plan(src, dst, "name").collect()} == {"a": "skip", "b": "copy", "c": "copy", "d": "copy"}
    new, old = (spark.createDataFrame(x, "k string, v string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "x")]))
    assert {r.k for r in sinks.changed(new, old, "k", "v").collect()} == {"b", "c"} and [r.k for r in sinks.orphans(new, old, "k").collect()] == ["c"]
    st = sinks.stale_images(spark.createDataFrame([("a.png.webp",), ("b.png",)], "name string"), spark.createDataFrame([("a.png",)], "name string"))
    assert [r.name for r in st.collect()] == ["b.png"]
    assert [sinks.publish_status(1, True), sinks.publish_status(0, None), sinks.publish_status(0, True), sinks.publish_status(0, False)] == ["failed", "assembled", "ready", "failed"]
    path = f"{tmp_path}/t"
    none = spark.createDataFrame([], "x int")
    assert sinks.overwrite_checked(new, path, none) and not sinks.overwrite_checked(old, path, old) and spark.read.parquet(path).count() == 3
    document = lambda: json.loads("".join(x.read_text() for x in sorted((tmp_path / "doc").glob("part-*"))))
    pids, names = (spark.createDataFrame(x, s) for x, s in (([("P", "s"), ('Q"', "é\\")], "pid string, slug string"), ([("x", "k")], "alias string, key string")))
    sinks.write_lines(sinks.link_map_lines(pids, names), f"{tmp_path}/doc")
    assert document() == {"papers": {"P": "s", 'Q"': "é\\"}, "terms": {"x": "k"}}
    sinks.write_lines(sinks.catalog_lines(spark.range(40).repartition(7), spark.range(0), 'a "b"', "id", "id"), f"{tmp_path}/doc")
    assert document() == {"generatedAt": 'a "b"', "count": 40, "papers": [{"id": i} for i in range(40)], "topicDocs": []}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbad\n{"a": 2}\n')
    (tmp_path / "c.json").write_text('{"papers": [{"a": 1}, {"a": 2}]}')
    assert [r.a for r in files.json_lines(spark, f"{tmp_path}/l.jsonl", "a int").collect()] == [1, 2]
    assert files.json_rows(spark, f"{tmp_path}/c.json", "a:int", "papers").count() == 2 and files.json_rows(spark, f"{tmp_path}/nope.json", "a:int", "papers").count() == 0
