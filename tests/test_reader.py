"""Reader state, checks of texts, and decorators on literal rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foliant.operators import citations, layout, links, markdown, ordered, protect, reader, rules, search
from foliant.sources import sinks


def one(spark, *values):
    return spark.range(1).select(*[v.alias(f"c{i}") for i, v in enumerate(values)]).first()


def test_documents_are_whole(spark):
    store = spark.createDataFrame([("a", '{"note":"n","flags":{"cited":true,"reading":"在读"}}'), ("b", "{broken"), ("c", None), ("d", '{"flags":{"cite":"待引用","cited":true,"starred":true}}')], "key string, value string")
    d = {r.key: r.document for r in reader.documents(store).collect()}
    assert (d["a"].note, d["a"].highlights, tuple(d["a"].flags)) == ("n", [], ("在读", False, "已引用"))
    assert d["b"] == d["c"] and d["b"].updatedAt == "" and tuple(d["d"].flags) == ("", True, "待引用")
    assert [r.slug for r in reader.keys_under(spark.createDataFrame([("w.notes.x",), ("other",)], "key string"), "w.notes.").collect()] == ["x"]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, pos int, v string")
    asked = spark.createDataFrame([("a",), ("q",)], "k string")
    assert [r.v for r in reader.by_key(rows, asked, ["k"], last="pos").collect()] == ["y"] and [r.v for r in reader.by_key(rows, asked, ["k"], first="pos").collect()] == ["x"]
    users = spark.createDataFrame([(1, "A@x"), (2, "a@x"), (2, "b@x")], "id long, email string")
    assert {(r.key, r.n) for r in reader.store_conflicts(users, "users").collect()} == {("2", 2), ("a@x", 2)}


def test_sessions_in_normal_form(spark):
    raw = [
        {"slug": "a", "tab": "txt", "scroll": 10.6, "progress": {"article": "5", "images": "9"}, "at": 3},
        {"slug": "b", "tab": "images", "scroll": 9, "progress": {"txt": "-4", "articleEn": "7"}},
        {"slug": "", "tab": "txt"},
        {"slug": "a", "title": "later"},
        {"slug": "c"},
    ]
    rows = spark.createDataFrame([(1, json.dumps(raw)), (2, '["p", "", "q", "p"]'), (3, "nonsense"), (4, None)], "owner int, value string")
    got = reader.recent_sessions(rows, "owner")
    s = {(r.owner, r.session.slug): r.session for r in got.collect()}
    assert set(s) == {(1, "a"), (1, "b"), (1, "c"), (2, "p"), (2, "q")}
    assert (s[1, "a"].tab, s[1, "a"].scroll, s[1, "a"].progress, s[1, "a"].title) == ("txt", 11, {"article": 5, "txt": 11}, "")
    assert (s[1, "b"].tab, s[1, "b"].scroll, s[1, "b"].progress) == ("articleEn", 7, {"txt": 0, "articleEn": 7})
    assert (s[1, "c"].tab, s[1, "c"].progress) == ("article", {"article": 0})
    assert {r.owner: r.slugs for r in reader.recent_slugs(got, "owner").collect()} == {1: ["a", "b", "c"], 2: ["p", "q"]}
    current = got.where("session.slug = 'b'").select("owner", "session")
    asked = spark.createDataFrame([(1, "b"), (1, "a"), (2, "zzz")], "owner int, slug string")
    assert {r.slug: r.session and r.session.tab for r in reader.paper_session(current, got, asked, "owner").collect()} == {"b": "articleEn", "a": "txt", "zzz": None}
    assert {r.owner: len(r.recent) for r in reader.snapshot(current, got, "owner").collect()} == {1: 3, 2: 2}
    kept, first = reader.overview(got, spark.createDataFrame([("a", 1), ("z", 0)], "slug string, pos int"), "owner", 1)
    assert [r.session.slug for r in kept.collect()] == ["a"] and [r.slug for r in first.collect()] == ["z"]
    e = spark.createDataFrame([("a", 1, 0, True, False), ("a", 2, 50, True, True), ("a", 3, 0, False, False), ("b", 1, 0, True, True)], "k string, at int, scroll int, ready boolean, scrolled boolean")
    assert {(r.k, r.scroll) for r in reader.kept_progress(e, ["k"], "at").collect()} == {("a", 50), ("b", 0)}
    assert list(one(spark, reader.is_reader_path(F.lit("/reader/a/b"), F.lit("a")), reader.is_reader_path(F.lit("/reader/ab"), F.lit("a")), reader.vault_paths(F.lit("F"), F.lit("P"))["article"])) == [True, False, "F/P/content/P.正文.md"]


def test_vocabulary(spark):
    book = spark.createDataFrame([("Cat", "n", "a cat", "", 1), ("cat", "n", "", "", 2), ("dog house", "", "x", "狗屋", 3), ("", "", "", "", 4)], "word string, pos string, en string, zh string, ord int")
    got = {r.word: r.glossed for r in reader.lookup(book, spark.createDataFrame([("CAT",), ("Dog House",), ("none",)], "word string")).collect()}
    assert got == {"CAT": False, "Dog House": True, "none": False}
    assert {r.word for r in reader.pending(book.where("ord > 1")).collect()} == {"cat", ""} and reader.pending(book, spark.createDataFrame([("DOG HOUSE",)], "word string")).count() == 0
    full = book.withColumn("ipa", F.lit(None).cast("string")).withColumn("examples", F.lit(None).cast("array<string>")).withColumn("updatedAt", F.concat(F.lit("t"), "ord"))
    b = reader.normal_book(full)
    assert b.count() == 3 and b.first().examples == [] and reader.book_latest(b).first()[0] == "t3" and reader.book_latest(b.limit(0)).first()[0] == ""
    r = one(spark, reader.gloss_list(F.lit('```json\n[{"word":"a","en":"x"}]\n```')), reader.gloss_list(F.lit("no list")), reader.gloss_list(F.lit("[broken")))
    assert r[0][0].en == "x" and r[1] == r[2] == []
    texts = spark.createDataFrame([(1, "A cat, a Cat and catalog: the DOG HOUSE."), (2, "dogs only")], "id int, text string")
    marks = sorted((m.id, m.start, m.word) for m in reader.mark_words(texts, spark.createDataFrame([("cat",), ("dog",), ("dog house",)], "word string"), "id").collect())
    assert marks == [(1, 2, "cat"), (1, 9, "cat"), (1, 30, "dog house")]
    v = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "x"), ("B", "y")], "word string, context string")
    gone = spark.createDataFrame([("A", "One"), ("b", "not there")], "word string, context string")
    assert [tuple(r) for r in reader.without_words(v, gone).collect()] == [("a", "two")]


def test_marks_and_files(spark):
    sel = spark.createDataFrame([("s", "article", 1, 1, 9, 4, " hi "), ("s", "article", 1, 2, 0, 4, "x"), ("s", "article", 1, 1, 0, 4, "  ")], "slug string, tab string, startBlock int, endBlock int, start int, end int, text string")
    assert [tuple(r)[2:] for r in reader.new_highlights(sel).collect()] == [(1, 4, 9, "hi")]
    files = spark.createDataFrame([('{"note":"<script>x</script>ok","highlights":[],"vocab":[]}',), ('{"note":1,"highlights":[],"vocab":[]}',), ('{"note":"","highlights":{},"vocab":[]}',), ("bad",)], "value string")
    got = reader.imported(files).collect()
    assert [r.ok for r in got] == [True, False, False, False] and got[0].document.note == "ok"
    assert reader.exported(spark.createDataFrame([("a", None)], "x string, y string"), "x", "y").first()[0] == '{"x":"a","y":null}'
    terms = spark.createDataFrame([("k", [("p", "first"), ("p", "second"), ("q", "other")])], "key string, usages array<struct<paper:string,context:string>>")
    assert [r.context for r in reader.usage_in(terms, spark.createDataFrame([("p",)], "paper string")).collect()] == ["first"]


def test_accounts_and_shares(spark):
    users = spark.createDataFrame([(1, "a@x", "A", "admin", 0, "h1"), (2, "b@x", "B", "reader", 0, "h2"), (3, "c@x", "C", "reader", 1, "h3")], "id long, email string, display_name string, role string, disabled int, pass_hash string")
    patches = spark.createDataFrame([(2, " Bee ", "admin", None), (1, None, "reader", None), (3, None, "king", None), (9, "x", None, None), (3, None, None, False)], "id long, display_name string, role string, disabled boolean")
    got, bad = reader.patch_users(users, patches.where("id <> 3 or role is null"), 1)
    assert {(r.id, r.display_name, r.role, r.disabled) for r in got.collect()} == {(1, "A", "admin", 0), (2, "Bee", "admin", 0), (3, "C", "reader", 0)}
    assert {(r.id, r.why) for r in bad.collect()} == {(1, "own_role"), (9, "unknown")}
    assert [r.why for r in reader.patch_users(users, patches.where("role = 'king'"), 1)[1].collect()] == ["role"]
    up = reader.upsert_admin(users, spark.createDataFrame([("C@x",), ("new@x",)], "email string"))
    assert {(r.id, r.role, r.disabled) for r in up.where("role = 'admin'").collect()} == {(1, "admin", 0), (3, "admin", 0), (4, "admin", 0)}
    assert reader.bootstrap(users.limit(0), users).count() == 3 and reader.bootstrap(users, users).count() == 3
    new, why = reader.change_passwords(users, spark.createDataFrame([(1, "h1", "n1", 8), (2, "no", "n2", 8), (3, "h3", "n3", 3)], "id long, old_hash string, new_hash string, length int"))
    assert {r.id: r.pass_hash for r in new.collect()} == {1: "n1", 2: "h2", 3: "h3"} and {(r.id, r.why) for r in why.collect()} == {(2, "wrong"), (3, "short")}
    ses = spark.createDataFrame([("t1", 1, "2024"), ("t2", 3, "2030"), ("t3", 2, "2030"), ("t4", 7, "2030")], "token string, user_id long, expires string")
    assert [r.token for r in reader.active_users(users, ses, F.lit("2025")).collect()] == ["t3"]
    shares = spark.createDataFrame([("x", "p1", 1, "2024-01-01", None, 0), ("y", "p2", 1, "2024-01-02", "2024-02", 0), ("z", "p1", 1, "2024-01-03", None, 1), ("w", "gone", 2, "2024-01-04", None, 0)], "token string, slug string, created_by long, created_at string, expires_at string, revoked int")
    assert [r.token for r in reader.shares_of(shares, 1).collect()] == ["y", "x"] and [r.token for r in reader.shares_of(shares, 1, "p1").collect()] == ["x"]
    papers = spark.createDataFrame([("p1", "P1", 1), ("p1", "other", 2), ("p2", "P2", 3)], "slug string, pid string, pos int")
    pages = reader.share_pages(spark.createDataFrame([(t,) for t in "xyzwq"], "token string"), shares, papers, F.lit("2025"))
    assert {r.token: (r.status, r.pid) for r in pages.collect()} == {"x": (200, "P1"), "y": (410, None), "z": (410, None), "w": (410, None), "q": (410, None)}
    listed = reader.share_rows(shares)
    assert {r.token for r in reader.with_share(listed, listed.limit(0), listed.where("token = 'x'")).collect()} == {"y", "z", "w"}


def test_filters_by_mark(spark):
    kind = "slug string, status string, domain string, reading string, flags struct<reading:string,starred:boolean,cite:string,cited:boolean>, haystack string"
    rows = spark.createDataFrame([("a", "ready", "x/y", "已读", None, "alpha"), ("b", "ready", "x", "other", ("在读", True, "", True), "beta"), ("c", "notes", "z", None, ("", False, "待引用", True), "alpha gamma")], kind)
    pick = lambda **k: {r.slug for r in search.filter_papers(rows, **k).collect()}
    assert pick() == pick(mark="all", status="all") == {"a", "b", "c"} and pick(domain="x") == {"a", "b"} and pick(query="ALPHA", status="ready") == {"a"}
    assert pick(mark="已读") == {"a"} and pick(mark="在读") == {"b"} and pick(mark="重点") == {"b"} and pick(mark="已引用") == {"b"} and pick(mark="待引用") == {"c"}
    blank = search.filter_blocks(spark.createDataFrame([("# A\nx",)], "text string"), "  ").first()
    assert (blank.blocks, blank.hits) == ("# A\nx", 0)


EN = "# T\n\n## 1 Intro\n![[a.png]]\n**Fig. 1.** Cap\n$$x \\tag{1}$$\n## 2 More\ntext\n![[c.png]]\n**Figure 2.** Other\n**Table 1.** T\n| a |\n## Equations\n$$y \\tag{2}$$\n$$z \\tag{A.1}$$"
ZH = "# T\n\n## 1 引言\n$$x \\tag{1}$$\n## 2 多\n![[a.png]]\n**图 1.** 中文图注\n**图 2.** An English caption that nobody translated\n**表 1.** 表\n\n## Equations\n$$y \\tag{2}$$"


def test_checks_of_captions_and_places(spark):
    en, zh = (spark.createDataFrame([(1, t)], "id int, text string") for t in (EN, ZH))
    exp = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3")], "id int, label string")
    assert {(r.label, r.fault) for r in rules.missing_captions(en, "id", exp, rules.EN_CAP).collect()} == {("3", "absent")}
    assert {(r.label, r.fault) for r in rules.missing_captions(zh, "id", exp, rules.ZH_CAP).collect()} == {("3", "absent")}
    assert {(r.label, r.fault) for r in rules.missing_captions(zh, "id", exp.limit(1), rules.ZH_TAB, "table").collect()} == {("1", "not_table")}
    assert rules.missing_captions(en, "id", exp.limit(1), rules.EN_TAB, "table").count() == 0
    files = spark.createDataFrame([(1, "1", "a.png"), (1, "2", "b.png")], "id int, num string, file string")
    assert {(r.num, r.fault) for r in rules.caption_files(en, "id", files, rules.EN_CAP).collect()} == {("2", "other_image")}
    assert [(r.n, r.preview[0][:6]) for r in rules.untranslated_captions(zh, "id").collect()] == [(1, "**图 2.*")] or rules.untranslated_captions(zh, "id").first().n == 1
    assert [(r.title, r.n) for r in rules.dump_sections(en, "id").collect()] == [("Equations", 2)] and rules.dump_sections(zh, "id").count() == 0
    a, b = rules.item_sections(en, "id"), rules.item_sections(zh, "id")
    assert {r.item: r.section for r in a.collect()} == {"式(1)": "1", "式(2)": "equations", "式(A.1)": "equations", "图1": "1", "图2": "2", "表1": "2"}
    for x in (a, rules.dump_sections(en, "id")):  # no line is shuffled or sorted: a text's sections are worked out in its row
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    twice = spark.createDataFrame([(1, "$$x \\tag{1}$$\n## Appendix B\n$$x \\tag{1}$$\r\n  **Fig. 2.** c\n##\n###  \n$$\\tag{3} \\tag{4}$$\n### 2.1 C\n**Figure 02.** d"), (2, None), (3, "## 1 A")], "id int, text string")
    assert {(r.id, r.item, r.section) for r in rules.item_sections(twice, "id").collect()} == {(1, "式(1)", "_front"), (1, "图2", "appendix B"), (1, "式(3)", "appendix B"), (1, "式(4)", "appendix B")}
    m = rules.moved_items(a, b, "id").first()
    assert (m.items, m.moved, m.band) == (5, 1, "warning")
    lab = lambda df: df.select("id", F.col("item").alias("label"))
    d = rules.label_differences(lab(a.where("item <> '图2'")), lab(a), lab(b), "id").first()
    assert (d.extra, d.unmatched) == (["图2"], ["式(A.1)"])
    secs = [spark.createDataFrame([(1, k) for k in ks], "id int, key string") for ks in (["1", "2.1", "x"], ["1", "3", "y"])]
    assert {(r.key, r.level) for r in rules.numbered_sections(*secs, "id").collect()} == {("2.1", "E"), ("3", "W")}
    bal = spark.createDataFrame([(1, "![[a]]" * 5, "![[a]]"), (2, "", ""), (3, "", "![[a]]" * 2)], "id int, en string, zh string")
    assert [tuple(r) for r in rules.image_balance(bal, "id", "en", "zh").collect()] == [(1, 5, 1)]
    rule = {r.rule for r in rules.findings(spark.createDataFrame([(1, "# T\nA^{1}\n## 要点\nReceived 3 May\n"), (2, "# T\nA^{+}\nreceived: 3")], "id int, text string"), "id", rules.EN_RULES).where("id = 1").collect()}
    assert rule == {"author_sup", "forbidden_h2", "journal_shell"}


def test_check_fields(spark):
    kind = "id int, lang string, meta struct<pdf:string,title:string,authors:array<string>>, fields struct<title:string,authors:array<string>,shortTitle:string,translatedTitle:string,domain:string,firstAuthorPinyin:string,tldr:string,question:string,score:string,topics:array<string>>"
    good = (1, "zh", ("d/a.pdf", "T", ["A"]), ("", [], "short", "tt", "a/b", "Li", "x", "y", "z", ["t"]))
    bad = (2, "zh", ("d/a.pdf", "a", []), (None, [" "], "has space", "", "/flat/", "李", "", None, "1", []))
    got = {(r.id, r.rule) for r in rules.check_fields(spark.createDataFrame([good, bad], kind), "id").collect()}
    assert got == {(2, r) for r in ("title", "authors", "short_title", "translated_title", "domain_flat", "pinyin", "tldr", "question", "topics")}


def test_fidelity_leaves_missing_sections(spark):
    e = spark.createDataFrame([(1, "1", 1000), (1, "2", 1000), (1, "_front", 900)], "id int, key string, chars long")
    z = spark.createDataFrame([(1, "1", 700), (1, "_front", 1)], "id int, key string, chars long")
    assert [(r.key, r.band) for r in rules.fidelity(e, z, "id").collect()] == [("1", "warning")]


def test_filler_statistics(spark):
    run = "".join(map(chr, range(0x4E00, 0x4E00 + 80)))
    text = "的一是在不了有和人这，" * 8
    got = {r.id: r for r in ordered.filler_stats(spark.createDataFrame([(1, run), (2, text), (3, "短")], "id int, text string"), "id").collect()}
    assert set(got) == {1, 2} and got[1].seq == 1.0 and got[1].punct == 0 and got[2].top20 == 1.0 and abs(got[2].punct - 100 / 11) < 1e-9
    assert [r.id for r in rules.filler(ordered.filler_stats(spark.createDataFrame([(1, run), (2, text)], "id int, text string"), "id")).collect()] == [1]


def test_citations_in_running_text(spark):
    md = "See Smith and Jones (2018, 2019) and 张三等, 2020; also [2] and [x](y) [3](z).\n\n## 📚 参考文献\n- **[1]** Smith, J., and Jones, K.: A title, J. Geo., 2018. ｜ [🔗 DOI](https://doi.org/1) ^ref-1\n- **[2]** 张三, 李四, 王五. 题目[J]. 学报, 2020. ^ref-2\n- no number\n- **[3]** ^ref-3"
    docs = spark.createDataFrame([(1, md), (2, "no [1] list")], "id int, text string")
    e = citations.bibliography(docs, "id")
    rows = {r.n: r for r in e.collect()}
    assert (rows["1"].label, rows["2"].label, rows["3"].label) == ("Smith and Jones, 2018", "张三等, 2020", "文献 3") and rows["3"].keys == []
    lists = e.groupBy("id").agg(F.collect_list(F.struct("n", "label", "keys")).alias("es"))
    out = {r.id: r.t for r in docs.join(lists, "id", "left").select("id", citations.link_citations_udf("text", "es").alias("t")).collect()}
    assert out[2] == "no [1] list" and "[[#^ref-2|2]]" in out[1] and "[[#^ref-2|张三等, 2020]]" in out[1] and "[3](z)" in out[1] and "See [[#^ref-1|Smith and Jones, 2018]] and" in out[1] and "- **[1]** Smith" in out[1]
    # a text's own list is linked in its row, to the same result
    more = docs.unionByName(spark.createDataFrame([(3, None), (4, "Ng, 2020b and Müller (2019)\n## 参考文献\n- **[1]** Müller, A.: X, 2019.\n- **[2]** Ng, B.: Y, 2020b. ^ref-2\n - **[1]** Ng, B.: Z, 2020.")], "id int, text string"))
    every = citations.bibliography(more, "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "n", "label", "keys"))), lambda x: F.struct(x["n"], x["label"], x["keys"])).alias("es"))
    want = {r.id: r.t for r in more.join(every, "id", "left").select("id", citations.link_citations_udf("text", "es").alias("t")).collect()}
    own = citations.link_own_list(more, "text", "t")
    assert {r.id: r.t for r in own.collect()} == want and "[[#^ref-2|Ng, 2020b]] and [[#^ref-1|Müller, 2019]]" in want[4]
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    dup = e.unionByName(e.where("n = '1'").withColumns({"ord": F.lit(99), "label": F.lit("last")}))
    assert citations.cite_map(dup, "id").where("n = '1'").first().label == "last"
    html = "a \ue1001\ue101, \ue1002\ue101 b \ue1001\ue101"
    got = one(spark, citations.restore_placeholders(F.lit(html), F.create_map(F.lit("1"), F.lit("S, 2018"))))[0]
    assert got.count("paper-cite") == 3 and got.startswith('a (<a class="paper-cite" href="#ref-1" data-ref="1">S, 2018</a>; <a') and ">2</a>) b (" in got


def test_links_and_duplicates(spark):
    pages = spark.createDataFrame([(1, ["P1.notes", "alpha!", "_nav", "", "lost", "P2"])], "id int, ts array<string>")
    known = spark.createDataFrame([("P1",)], "pid string")
    al = spark.createDataFrame([("alpha",)], "alias string")
    assert links.dangling(pages, "id", F.col("ts"), known, "pid", aliases=al).first().preview == ["P2", "lost"]
    pids = spark.createDataFrame([("P", "z", 1), ("P", "a", 2)], "pid string, slug string, pos int")
    ls = spark.createDataFrame([("P",)], "target string")
    none = spark.createDataFrame([], "alias string, key string")
    assert links.resolve_links(ls, "target", pids, none, "pos").first().ref == "a"
    cand = spark.createDataFrame([("x/A.md", "https://doi.org/10.1/X "), ("x/B.md", "10.9/z"), ("x/C.md", "doi:10.1/x"), ("x/D.md", "")], "index string, doi string")
    cat = spark.createDataFrame([("10.1/x", "PX")], "doi string, pid string")
    got = links.duplicate_papers(cand, cat, spark.createDataFrame([("x/B.md",)], "path string"))
    assert {(r["index"], r.pid) for r in got.collect()} == {("x/A.md", "PX"), ("x/B.md", "B")}
    terms = spark.createDataFrame([("k", "Alpha")], "key string, term string")
    assert links.term_of(spark.createDataFrame([("AL-PHA",)], "name string"), "name", al.withColumn("key", F.lit("k")), terms).first().term == "Alpha"


def test_decorators(spark):
    html = '<h1>🔬 T（中文翻译）</h1><p><img a></p><p><img b></p><p>图 1 cap</p><table><tr></tr></table><blockquote><p>q</p></blockquote><blockquote><p><strong>【说明】</strong> n</p></blockquote><ul><li>\ue2001\ue201 x \ue2002\ue201</li><li>y</li></ul>'
    r = one(spark, *[f(F.lit(html)) for f in (markdown.wrap_figures, markdown.wrap_tables, markdown.wrap_notes, markdown.ref_anchors, markdown.plain_headings)])
    assert '<figure class="md-fig"><img a><img b><figcaption>图 1 cap</figcaption></figure>' in r[0]
    assert '<div class="tbl-wrap"><table><tr></tr></table></div>' in r[1]
    assert '<blockquote><p>q</p></blockquote><aside class="formula-note"><div class="formula-note-title">说明</div><p>n</p></aside>' in r[2].replace("<p> n", "<p>n")
    assert '<li id="ref-1" class="paper-ref"><span id="ref-2"></span>x</li><li>y</li>' in r[3] and "<h1>T</h1>" in r[4]
    moc = one(spark, markdown.moc_target(F.lit("__📚 术语库")), markdown.moc_target(F.lit("_A b")))
    assert (moc[0].url, moc[0].label, moc[1].url, moc[1].label) == ("/terms", "术语库", "/papers?domain=A%20b", "A b")


def test_layout_texts(spark):
    lit = F.lit
    r = one(spark, layout.despaced(lit("F I G U R E 1 0 x")), layout.despaced_anywhere(lit("see a b c d now")), layout.junk_heading(lit("J. Smith, A")), layout.junk_heading(lit("Methods")), layout.equation_number(lit("a = b + c (12)"), lit(False)), layout.equation_number(lit("the sum of all is = + (3)"), lit(False)), layout.label_like(lit("Fig. 3 x")), layout.citation_brackets(lit("word^{12,13} x^{2} by^{3}")))
    assert list(r) == ["FIGURE 10 x", "see abcd now", True, False, "12", None, True, "word[12,13] x^{2} by[3]"]
    cap = spark.createDataFrame([(1, "1", 100.0, 400.0, 300.0, 410.0, 0.0)], "page int, num string, x0 double, y0 double, x1 double, y1 double, page_y0 double")
    blocks = spark.createDataFrame([(1, 100.0, 50.0, 300.0, 120.0, "w " * 60, False), (1, 100.0, 200.0, 300.0, 210.0, "short", False)], "page int, x0 double, y0 double, x1 double, y1 double, text string, caption boolean")
    g = layout.gap_above(cap, blocks, ["page"]).first()
    assert (g.x0, g.y0, g.x1, g.y1) == (96.0, 122.0, 304.0, 398.0)
    figs = spark.createDataFrame([(1, "1", "x"), (1, "9", "Second figure of all, and more than that")], "doc int, num string, caption string")
    caps = spark.createDataFrame([(1, "1", 5.0, "First"), (1, "2", 6.0, "Second figure OF all, and more text")], "doc int, num string, y0 double, text string")
    assert {r.num: r.cap_num for r in layout.find_caption(figs, caps, ["doc"]).collect()} == {"1": "1", "9": "2"}
    kind = "page int, id string, x0 double, y0 double, x1 double, y1 double, size double, body double, height double"
    b = spark.createDataFrame([(1, "head", 0.0, 1.0, 9.0, 20.0, 9.0, 10.0, 1000.0), (1, "in", 10.0, 110.0, 20.0, 120.0, 10.0, 10.0, 1000.0), (1, "foot", 0.0, 900.0, 9.0, 910.0, 7.0, 10.0, 1000.0), (1, "text", 0.0, 500.0, 9.0, 510.0, 10.0, 10.0, 1000.0)], kind)
    reg = spark.createDataFrame([(1, 0.0, 100.0, 50.0, 200.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.id for r in layout.page_body(b, ["page"], reg).collect()] == ["text"]


def test_spans_of_tables_and_fences(spark):
    md = "~~~\n$a$\n~~~\n| Name 3 | 12.5 kg | x |\n|---|---|---|\n### References\n[1] $b$\n## Next\n$c$ \\$5"
    spans = [(k, t) for k, t, *_ in protect.find_spans(md)]
    assert spans == [("code_fence", "~~~\n$a$\n~~~\n"), ("table_number", "3"), ("table_cell", " 12.5 kg "), ("references", "\n[1] $b$\n"), ("math_inline", "$c$")]


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        sinks.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    try:
        sinks.replace_table(bad, path)
    except Exception:
        pass
    assert spark.read.parquet(path).count() == 5 and sinks.overwrite_checked(spark.range(1), path, spark.range(1)) is False


def test_which_parts_of_tables_and_references_stay():
    found = lambda md: [(k, t) for k, t, *_ in protect.find_spans(md)]
    assert found("| a \\| 5 | -1.5e-3 m² | 中 7 | : --- | | 12% | 3 № |") == [("table_number", "5"), ("table_cell", " -1.5e-3 m² "), ("table_number", "7"), ("table_cell", " 12% "), ("table_number", "3")]
    assert found("| 1.2.3 | x9 |\nno | 5 | row\n  | 4 |  ") == [("table_cell", " 1.2.3 "), ("table_number", "9"), ("table_cell", " 4 ")]
    assert found("# References\na\n## References\nb\n# End\nc") == [("references", "\na\n## References\nb\n")]
    assert found("## 参考文献\r\na\n## references\nb\n# x\n### References") == [("references", "\na\n"), ("references", "\nb\n")]
    assert found("`a` ``b`c`` \\$5 $x$ $$y\nz$$ ![[i.png]] ![t](u)") == [("code_inline", "`a`"), ("code_inline", "``b`c``"), ("math_inline", "$x$"), ("math_block", "$$y\nz$$"), ("image", "![[i.png]]"), ("image", "![t](u)")]
