"""All checks of a work as one report: every rule hit once, and the plan."""

from __future__ import annotations

from foliant.operators import report

BODY = "The quick measure of flow over hills was taken twice a day in all weather."
HAN = "气流越过山丘的测量在各种天气下每天进行两次并且记录完整。"
EN = f"""# A study

## Abstract

{BODY}

## 1 Flow

{BODY}

![[a.png]]

**Fig. 1.** Flow.

**Table 1.** Cases.

| a | b |

$$
x \\tag{{1}}
$$
"""
ZH = f"""# 一项研究

## 亮点

{HAN}

## 摘要

{HAN}

## 1 流动

{HAN}

![[a.png]]
**图 1.** 流动。

**表 1.** 工况。

| 甲 | 乙 |

$$
x \\tag{{1}}
$$
"""
WORK = {"id": 1, "lang": "en", "kind": "article", "en": EN, "zh": ZH, "notes": "# 笔记", "figures": ["1"], "tables": ["1"], "equations": ["1"], "images": ["a.png"], "files": {"1": "a.png"}}
SCHEMA = "id long, lang string, kind string, en string, zh string, notes string, figures array<string>, tables array<string>, equations array<string>, images array<string>, files map<string,string>"


def cases():
    yield {}, [], []
    yield {"en": EN.replace("**Fig. 1.**", "**Fig. 2.**")}, ["en.md:caption_file:2", "en.md:no_figures:1"], []
    yield {"zh": ZH.replace("![[a.png]]", "字\n字\n字\n")}, ["zh.md:caption_file:1", "zh.md:not_embedded:1"], []
    yield {"zh": ZH.replace("![[a.png]]\n", "![[a.png]]\n字\n")}, ["zh.md:caption_file:1"], []
    yield {"zh": ZH.replace("| 甲 | 乙 |", "字")}, ["zh.md:not_table:1"], []
    yield {"en": EN.replace("\\tag{1}", "")}, ["en.md:no_equation:1"], ["zh.md:unmatched_equation:1"]
    yield {"equations": []}, [], ["en.md:unexpected_equation:1"]
    yield {"images": ["a.png", "b.png", "_page.png"]}, [], ["images:unused:b.png"]
    yield {"images": []}, ["en.md:no_image:a.png", "zh.md:no_image:a.png"], []
    yield {"notes": "![[_page.png]] ![[n.png]]"}, ["notes.md:no_image:_page.png", "notes.md:no_image:n.png"], []
    yield {"files": {"1": "other.png"}}, ["en.md:caption_file:1", "zh.md:caption_file:1"], []
    yield {"files": None}, [], []
    yield {"zh": ZH + "\n![[a.png]]\n**图 1.** 流动。\n"}, ["zh.md:caption_twice:1"], []
    yield {"zh": ZH.replace("## 1 流动", "## 2 流动")}, ["zh.md:no_section:1"], ["zh.md:more_section:2"]
    yield {"en": EN + "\n## 2 Bare\n\n## Thanks\n\nx\n"}, ["en.md:empty_section:2 Bare", "zh.md:no_section:2"], ["en.md:empty_section:Thanks"]
    yield {"en": EN + f"\n## Notes\n\n### Held\n\n{BODY}\n"}, [], []
    yield {"en": EN + "\n## Equations\n\n$a \\tag{1}$\n\n$b \\tag{1}$\n"}, ["en.md:dump:Equations"], []
    yield {"en": EN.replace("# A study", "A study")}, ["en.md:title"], []
    yield {"en": EN.replace("## Abstract", "## Summary")}, ["en.md:section:Abstract"], []
    yield {"kind": "book"}, ["en.md:section:Preface", "zh.md:section:前言"], []
    yield {"zh": ZH.replace(HAN, BODY)}, ["zh.md:language"], []
    yield {"zh": ZH.replace("**图 1.** 流动。", f"**图 1.** {BODY}")}, ["zh.md:untranslated_caption:1"], []
    yield {"en": EN + "\n$$\n"}, ["en.md:odd_math"], []
    yield {"zh": ZH + "\n[[link]] 其余各节\n"}, ["zh.md:omission"], ["zh.md:wikilink"]
    yield {"zh": ZH + "\n" + "![[a.png]]\n" * 4}, [], ["zh.md:balance"]
    yield {"lang": "zh", "en": None}, [], []
    none = dict.fromkeys(WORK, None) | {"id": 1}
    yield none, ["notes.md:absent", "zh.md:absent"], []
    yield none | {"lang": "en", "figures": ["1"]}, ["en.md:absent", "en.md:no_figures:1", "notes.md:absent", "zh.md:absent", "zh.md:no_figures:1"], []


def test_each_rule(spark):
    all_ = list(cases())
    rows = [tuple({**WORK, **over, "id": i}.values()) for i, (over, _, _) in enumerate(all_)]
    got = {r.id: r for r in report.verify(spark.createDataFrame(rows, SCHEMA), "id").collect()}
    assert len(got) == len(all_)
    for i, (_, errors, warnings) in enumerate(all_):
        assert (i, got[i].errors, got[i].warnings, got[i].ok) == (i, errors, warnings, not errors)
    c = got[0].counts
    assert (c.figures_en, c.tables_zh, c.equations_en, c.lines_no) == (1, 1, 1, 1)
    assert report.verify(spark.createDataFrame([], SCHEMA), "id").count() == 0


def test_one_explode_and_one_shuffle(spark):
    df = report.verify(spark.createDataFrame([tuple(WORK.values())], SCHEMA), "id")
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate posexplode") == 1
