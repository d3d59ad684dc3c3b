"""Sealed derivations: round trips, every kind of tampering, and what it voids."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.operators import seals

SOURCE = """# A study of flow

## Abstract

The speed $u_*$ is defined here.

$$
x^2 + y^2 \\tag{1}
$$

![[Flow_page1_fig1.png]]
**Fig. 1.** Whole caption with $u_*$

| Case | Speed | Length |
| --- | :---: | --- |
| Case 1 | 0.5 m/s | $L=2$ |

- first `code()` point
- second point


```
kept

as it is
```

## References

[1] Exact reference ^ref-1
"""
LAYOUT = json.dumps({"headings": [{"title": "Abstract", "page": 1}], "equations": [{"num": "1", "page": 1}], "tables": [{"num": "1", "page": 2}]})
NOTE = "every page was compared"


def locked(md: str = SOURCE) -> str:
    return seals.locked_body(seals.named(seals.pieces(md)))


def test_a_skeleton_holds_what_is_kept_and_leaves_the_words():
    body = locked()
    for kept in ("x^2", "0.5 m/s", "^ref-1", "code()", "as it is", "| Case", "- first", "##"):
        assert kept not in body
    for words in ("A study of flow", "References", "Whole caption with", "Case 1".split()[0], "second point"):
        assert words in body
    assert seals.merged(SOURCE, body, None) == (SOURCE, [])


def test_words_are_translated_between_tokens():
    zh, errors = seals.merged(SOURCE, locked().replace("The speed", "速度").replace("References", "参考文献"), None)
    assert errors == [] and "速度 $u_*$ is" in zh and "## 参考文献" in zh and "| Case 1 | 0.5 m/s | $L=2$ |" in zh


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda s, a, b: s.replace(a, "", 1), "token"),
        (lambda s, a, b: s + a, "token"),
        (lambda s, a, b: s.replace(a, "⟦WS999999⟧", 1), "token"),
        (lambda s, a, b: s.replace(a, "@", 1).replace(b, a, 1).replace("@", b, 1), "token"),
        (lambda s, a, b: s.replace("The speed", "⟦WS1⟧ speed"), "damaged"),
        *[(lambda s, a, b, x=x: s.replace("The speed", x), "syntax") for x in ("$new$", "![x](x.png)", "![[new.png]]", "`new()`", "\\(x\\)")],
        (lambda s, a, b: s.replace("The speed ", "").replace(" is defined here.", ""), "empty:3"),
        (lambda s, a, b: s.replace("The speed", "The\n\nspeed"), "split:3"),
        (lambda s, a, b: s + "\n\nOne more paragraph", "outside"),
    ],
)
def test_a_changed_translation_is_refused(change, error):
    body = locked()
    a, b = seals.MARK.findall(body)[:2]
    text, errors = seals.merged(SOURCE, change(body, a, b), None)
    assert text == "" and error in errors


GOOD = "## 亮点\n\n- one\n- two\n- three\n\n>【说明】 by hand"


@pytest.mark.parametrize(
    ("supplement", "error"),
    [(GOOD, None), (GOOD.replace("- three\n", ""), "supplement_form"), (GOOD + "\n\n## Other", "supplement_heading"), (GOOD.replace("one", "$x$"), "supplement_protected"), (GOOD.replace("【说明】", ""), "supplement_form")],
)
def test_a_supplement_stands_before_the_abstract(supplement, error):
    text, errors = seals.merged(SOURCE, locked().replace("Abstract", "摘要"), supplement)
    assert errors == ([error] if error else [])
    assert (f"{GOOD}\n\n## 摘要" in text) == (error is None)
    assert seals.merged(SOURCE, locked(), GOOD)[1] == ["supplement_place"]
    printed = SOURCE + "\n## Highlights\n\nPrinted.\n"
    assert seals.merged(printed, locked(printed), "anything") == (printed, [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a b", "\n", "\n\n", " \t", "# h", "## References", "$x$", "$$y$$", "`c`", "```\n", "|", "|-|", "- ", "1. ", "![[i.png]]", "\\$", "[1]", "é中"]), max_size=30).map("".join))
def test_every_text_comes_back(md):
    text, errors = seals.merged(md, locked(md), None)
    assert errors in ([], ["syntax"]) and (errors or text == md)


def test_long_texts_take_linear_time():
    md = "".join(f"Words of line {i} with $x_{i}$ and more.\n\n" for i in range(30_000))
    assert seals.merged(md, locked(md), None) == (md, [])


@pytest.mark.parametrize(
    ("layout", "pages", "want"),
    [
        (LAYOUT, 3, []), (LAYOUT, 1, ["page:tables:1"]), (LAYOUT, 0, ["pages"]), (LAYOUT, None, ["pages"]), ("{", 3, ["layout"]), (None, 3, ["layout"]), ("{}", 3, ["headings"]),
        ('{"headings": [], "equations": 5}', 3, ["headings", "list:equations"]),
        ('{"headings": [7, {"title": "A", "page": true}, {"title": "B", "page": "1"}, {"page": 1.5}, {"title": "C", "page": 2}]}', 3, ["item:headings", "page:headings:A", "page:headings:B", "page:headings:?"]),
        ('{"headings": [{"page": 1}], "tables": [{"num": 4}]}', 3, ["page:tables:4"]),
    ],
)
def test_layouts_name_pages_of_the_document(spark, layout, pages, want):
    df = spark.createDataFrame([(layout, pages)], "layout string, pages int")
    assert df.select(seals.layout_faults(F.col("layout"), F.col("pages")).alias("e")).first().e == want


PAPER = {"id": 1, "lang": "en", "source": SOURCE, "layout": LAYOUT, "pages": 3, "note": NOTE}
FIGURE = {"id": 1, "num": "1", "status": "cut", "reviewed": True, "reviewNote": "seen", "reviewedAt": "2024-01-01"}


def frame(spark, rows, schema):
    return spark.createDataFrame([Row(**r) for r in rows], schema) if rows else spark.createDataFrame([], schema)


def papers(spark, **over):
    return frame(spark, [{**PAPER, **over}], "id long, lang string, source string, layout string, pages int, note string")


def figures(spark, **over):
    return frame(spark, [{**FIGURE, **over}], "id long, num string, status string, reviewed boolean, reviewNote string, reviewedAt string")


def test_only_what_was_looked_at_is_sealed(spark):
    one = lambda **over: seals.review(papers(spark, **over), "id").first()
    assert one().errors == [] and one().seal.note == NOTE and one().seal.equations
    for over, want in (({"note": " "}, "note"), ({"lang": "de"}, "lang"), ({"source": None}, "source"), ({"source": "costs $5"}, "dollar"), ({"pages": 1}, "page:tables:1")):
        r = one(**over)
        assert r.errors == [want] and r.seal is None
    assert one(source="costs \\$5").errors == []
    assert one(lang=None, note=None, source=None, layout=None, pages=None).errors == ["layout", "note", "lang", "source"]


@pytest.mark.parametrize(
    ("over", "fig", "want"),
    [
        ({}, {}, []), ({"source": SOURCE + "x"}, {}, ["source_changed"]), ({"layout": LAYOUT + " "}, {}, ["layout_changed"]), ({"lang": "zh"}, {}, ["lang", "not_english"]),
        ({}, {"reviewed": False}, ["figure:1:review"]), ({}, {"reviewNote": ""}, ["figure:1:note"]), ({}, {"reviewedAt": None}, ["figure:1:date"]), ({}, {"status": "missing"}, ["figure:1:missing"]),
    ],
)
def test_the_gate_before_a_translation(spark, over, fig, want):
    seal = seals.review(papers(spark), "id")
    p = seals.prepare(papers(spark, **over), seal, figures(spark, **fig), "id").first()
    assert p.errors == want and (p.body is None) == bool(want) and (p.link is None) == bool(want)


def test_the_gate_without_a_seal_or_over_another_source(spark):
    seal = seals.review(papers(spark), "id")
    none = seals.prepare(papers(spark), seal.limit(0), figures(spark), "id").first()
    assert none.errors == ["unreviewed"]
    flag = seal.withColumn("seal", F.col("seal").withField("tables", F.lit(False)))
    assert seals.prepare(papers(spark), flag, figures(spark), "id").first().errors == ["tables"]
    old = spark.createDataFrame([(1, "other")], "id long, source string")
    assert seals.prepare(papers(spark), seal, figures(spark), "id", old).first().errors == ["prepared_from_other"]
    own = seals.prepare(papers(spark), seal, figures(spark), "id")
    assert seals.prepare(papers(spark), seal, figures(spark), "id", own).first().errors == []
    assert seals.prepare(papers(spark).limit(0), seal, figures(spark), "id").count() == 0


def test_a_change_voids_what_hangs_on_it_and_no_more(spark):
    seal = seals.review(papers(spark), "id")
    made = seals.prepare(papers(spark), seal, figures(spark), "id").first()
    work = {"id": 1, "body": made.body, "manifest": made.manifest, "locked": made.body, "supplement": None}
    schema = "id long, body string, manifest array<struct<token:string,kind:string,text:string>>, locked string, supplement string"
    done = seals.merge(papers(spark), seal, figures(spark), spark.createDataFrame([tuple(work.values())], schema), "id").first()
    assert done.errors == [] and done.text == SOURCE and done.prepared_link == made.link
    full = {**work, "output": done.text, "made": made.link, "joined": done.link}

    def check(paper=(), fig=(), **over):
        w = spark.createDataFrame([tuple({**full, **over}.values())], schema + ", output string, made string, joined string")
        return seals.check_translation(papers(spark, **dict(paper)), seal, figures(spark, **dict(fig)), w, "id").first()

    r = check()
    assert r.ok and r.errors == [] and r.void == []
    r = check(output=SOURCE + " ")
    assert not r.ok and r.errors == ["output_differs"] and r.void == ["output"]
    r = check(supplement=GOOD)
    assert r.errors == ["supplement_place", "output_differs"] and r.void == ["merge", "output"]
    r = check(locked=made.body.replace("The speed", "A speed"))
    assert r.errors == ["output_differs"] and r.void == ["merge", "output"]
    r = check(paper={"source": SOURCE + "Changed"})
    assert "source_changed" in r.errors and "prepared_differs" in r.errors and r.void == ["review", "prepare", "merge", "output"]
    r = check(paper={"layout": LAYOUT + " "})
    assert r.errors == ["layout_changed", "output_differs"] and r.void == ["review", "prepare", "merge", "output"]
    r = check(fig={"reviewNote": "seen again"})
    assert r.ok and r.void == ["prepare", "merge", "output"]
    r = check(body=made.body + "x")
    assert "prepared_differs" in r.errors
    assert "prepared_differs" in check(manifest=[]).errors
