"""Sealed derivations: a reviewed source, its locked skeleton, the translation, the output.

A review is sealed by digests of what was reviewed.  Each later stage is derived
again from the present contents and compared, and its link is a digest over its
inputs and the link before, so a change voids exactly what hangs on it.  All of it
is row-wise but for three equi-joins on the id; texts are read by one Arrow
function per stage, everything else stays in the JVM.
"""

from __future__ import annotations

import re
from itertools import groupby, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from foliant.functions.text import text
from foliant.operators.protect import HEADING, ROW, SOURCES, every, find_spans

# What a skeleton keeps besides protected spans, and what a translation may not add.
LINE_HEAD = re.compile(r"(?m)^(#{1,6}[ \t]+|[ \t]*(?:[-+*]|\d+[.)])[ \t]+)")
TABLE_MARK = re.compile(r"(?<!\\)\||(?<=\|)[ \t]*:?-+:?[ \t]*(?=\|)")
SEPARATOR = re.compile(r"(\n[ \t]*\n+)")
NEW_SYNTAX = re.compile(r"(?<!\\)\$|!\[|`|(?<!\\)\\[([]")
MARK = re.compile(r"⟦WS\d{6,}⟧")
LANGUAGES = ("en", "zh")
LAYOUT_GROUPS = ("headings", "equations", "tables")
SUPPLEMENT_HEAD, SUPPLEMENT_NOTE = "## 亮点", ">【说明】"

#: Kinds in order of precedence; the last two belong to the skeleton alone.
SKELETON = (*SOURCES, every("structure", LINE_HEAD), lambda md: (("structure", *m.span()) for row in (ROW.finditer(md) if "|" in md else ()) for m in TABLE_MARK.finditer(md, *row.span())))


def pieces(md: str) -> list[tuple[str, str]]:
    """(kind, text) of the whole text in order: prose, what is kept, and marks around each block between separators."""
    spans = [("", "", 0, 0), *find_spans(md, SKELETON), ("", "", len(md), len(md))]
    flat = []
    for (*_, last), (kind, body, s, _) in pairwise(spans):
        prose = SEPARATOR.split(md[last:s])
        flat += [(("prose", "separator")[i % 2], x) for i, x in enumerate(prose)] + [(kind, body)]
    out = []
    for separator, block in groupby((p for p in flat if p[1]), key=lambda p: p[0] == "separator"):
        out += block if separator else [("block_begin", ""), *block, ("block_end", "")]
    return out


def named(parts: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(token, kind, text); prose has no token.  Tokens are numbered as they stand."""
    k = iter(range(1, len(parts) + 1))
    return [("" if kind == "prose" else f"⟦WS{next(k):06d}⟧", kind, body) for kind, body in parts]


def locked_body(parts: list[tuple[str, str, str]]) -> str:
    return "".join(token + "\n\n" if kind == "separator" else token or body for token, kind, body in parts)


def merged(source: str, translated: str, supplement: str | None, parts: list[tuple[str, str, str]] | None = None) -> tuple[str, list[str]]:
    """(text, errors): the translation with what was locked back in place, and the supplement before its abstract.
    parts: the source's named pieces, where they are at hand.

    Errors: token (one is missing, repeated, renamed or moved), damaged, syntax (math, images or code that the source
    lacks), outside (words between blocks), empty and split (blocks, by number), protected (kept matter differs), and supplement_*.
    """
    parts = named(pieces(source)) if parts is None else parts
    kept = [p for p in parts if p[0]]
    gaps, errors = MARK.split(translated), []
    residue = "".join(gaps)
    if "⟦WS" in residue or "⟧" in residue:
        errors.append("damaged")
    if any(x in residue for x in ("$", "![", "`", "\\")) and NEW_SYNTAX.search(residue):
        errors.append("syntax")
    if MARK.findall(translated) != [t for t, *_ in kept]:
        return "", ["token", *errors]
    want = words_of_blocks(parts)
    out, block, inside, number = [], "", False, 0
    for gap, (token, kind, body) in zip(gaps, [*kept, ("", "", "")], strict=True):
        out += [gap if inside else "", body]  # white space between blocks is the separators' own
        if not inside and gap.strip():
            errors.append("outside")
        block += gap + token
        if kind == "block_begin":
            inside, block, number = True, "", number + 1
        elif kind == "block_end":
            inside, block = False, block.removesuffix(token).strip()
            if want[number - 1] and not MARK.sub("", block).strip():
                errors.append(f"empty:{number}")
            if re.search(r"\n[ \t]*\n", block):
                errors.append(f"split:{number}")
    if errors:
        return "", list(dict.fromkeys(errors))
    done = "".join(out)
    if [s[:2] for s in find_spans(source)] != [s[:2] for s in find_spans(done)]:
        errors.append("protected")
    return supplemented(source, done, supplement, errors)


def words_of_blocks(parts: list[tuple[str, str, str]]) -> list[bool]:
    """Whether each block has words to translate."""
    out: list[bool] = []
    for _, kind, body in parts:
        if kind == "block_begin":
            out.append(False)
        elif kind == "prose" and out:
            out[-1] = out[-1] or bool(body.strip())
    return out


def supplemented(source: str, done: str, supplement: str | None, errors: list[str]) -> tuple[str, list[str]]:
    """The analyst's highlights before the abstract, where the source prints none."""
    if supplement is None or re.search(r"(?im)^##[ \t]+Highlights[ \t]*$", source):
        return done, errors
    extra = supplement.strip()
    place = re.search(r"(?m)^##[ \t]+摘要[ \t]*$", done)
    faults = {
        "supplement_protected": bool(find_spans(extra) or NEW_SYNTAX.search(extra)),
        "supplement_form": not (re.match(r"^##[ \t]+亮点\s*\n", extra) and 3 <= len(re.findall(r"(?m)^[-*] ", extra)) <= 5 and SUPPLEMENT_NOTE in extra),
        "supplement_heading": [m[0] for m in HEADING.finditer(extra)] != [SUPPLEMENT_HEAD],
    }
    found = [k for k, v in faults.items() if v] or ([] if place else ["supplement_place"])
    return (done, errors + found) if found else (f"{done[: place.start()]}{extra}\n\n{done[place.start() :]}", errors)


PREPARED = T.StructType([T.StructField("body", T.StringType()), T.StructField("manifest", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("token", "kind", "text")])))])
MERGED = T.StructType([*PREPARED.fields, T.StructField("text", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))])


def prepared(done: list[list[tuple[str, str, str]]]) -> dict[str, list]:
    kept = [[dict(zip(("token", "kind", "text"), p, strict=True)) for p in parts if p[0]] for parts in done]
    return {"body": [locked_body(parts) for parts in done], "manifest": kept}


@pandas_udf(PREPARED)
def prepared_udf(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(prepared([named(pieces(x or "")) for x in source]))


@pandas_udf(MERGED)
def merged_udf(source: pd.Series, translated: pd.Series, supplement: pd.Series) -> pd.DataFrame:
    """What is prepared from the source, and the translation merged with it: the source is cut into pieces once."""
    done = [named(pieces(x or "")) for x in source]
    out = [merged(a or "", b or "", c, parts) for a, b, c, parts in zip(source, translated, supplement, done, strict=True)]
    return pd.DataFrame(prepared(done) | {"text": [x[0] for x in out], "errors": [x[1] for x in out]})


@pandas_udf(T.BooleanType())
def open_dollar_udf(source: pd.Series) -> pd.Series:
    """A dollar sign that is neither escaped nor part of a protected span."""
    spans = lambda md: [(s, e) for _, _, s, e in find_spans(md)]
    bare = lambda md: "".join(md[a:b] for (_, a), (b, _) in pairwise([(0, 0), *spans(md), (len(md), len(md))]))
    return pd.Series(["$" in (x or "") and bool(re.search(r"(?<!\\)\$", bare(x))) for x in source], dtype=bool)


def link(*parts: Column) -> Column:
    """A digest over parts: the length of each in bytes, then the part; absent is told from empty."""
    one = lambda p: F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-"))
    return F.sha2(F.concat(*[one(p.cast("string")) for p in parts]), 256)


def some(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order; an unknown condition counts as a fault."""
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in pairs]), lambda x: x.isNotNull())


def layout_faults(layout: Column, pages: Column) -> Column:
    """What is wrong with a layout (JSON) of a document of so many pages: no JSON, no pages, no headings, a group
    that is no list, an item that is no object, a page that is no whole number from 1 to ``pages``."""
    v = F.try_parse_json(layout)

    def group(name: str) -> Column:
        items = F.try_variant_get(v, f"$.{name}", "array<variant>")
        label = lambda i: F.coalesce(F.try_variant_get(i, "$.num", "string"), F.try_variant_get(i, "$.title", "string"), F.lit("?"))
        whole = lambda i: F.schema_of_variant(F.try_variant_get(i, "$.page", "variant")) == "BIGINT"
        page = lambda i: F.try_variant_get(i, "$.page", "bigint")
        fault = lambda i: F.when(~F.schema_of_variant(i).startswith("OBJECT"), f"item:{name}").when(~F.coalesce(whole(i) & page(i).between(1, pages), F.lit(False)), F.concat(F.lit(f"page:{name}:"), label(i)))
        there = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(items.isNotNull(), F.filter(F.transform(items, fault), lambda x: x.isNotNull())).when(there.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit(f"list:{name}")))

    none = F.coalesce(F.size(F.try_variant_get(v, "$.headings", "array<variant>")), F.lit(0)) < 1
    all_ = F.concat(some(("headings", none)), *[group(g) for g in LAYOUT_GROUPS])
    return F.when(v.isNull(), F.array(F.lit("layout"))).when(F.coalesce(pages < 1, F.lit(True)), F.array(F.lit("pages"))).otherwise(all_)


def review(papers: DataFrame, id_: str) -> DataFrame:
    """id, errors, seal: the review of papers (lang, source, layout, pages, note), sealed where nothing is wrong.

    The seal is struct<lang, note, source, layout, equations, tables, structure>: digests of what was reviewed, and that all three
    kinds were.  A blank note, an unknown language, an empty source or an open dollar sign seals nothing; no
    other language stands in for the source's.
    """
    blank = lambda x: F.trim(text(x)) == ""
    errors = F.concat(layout_faults(F.col("layout"), F.col("pages")), some(("note", blank("note")), ("lang", ~F.col("lang").isin(*LANGUAGES)), ("source", blank("source")), ("dollar", open_dollar_udf("source"))))
    seal = F.struct("lang", F.trim("note").alias("note"), link(F.col("source")).alias("source"), link(F.col("layout")).alias("layout"), *[F.lit(True).alias(k) for k in ("equations", "tables", "structure")])
    return papers.select(id_, errors.alias("errors"), seal.alias("seal")).withColumn("seal", F.when(F.size("errors") == 0, F.col("seal")))


def review_faults(seal: Column) -> Column:
    """What is wrong with a seal beside its paper's lang, source, layout and pages now."""
    now = lambda name: F.coalesce(link(F.col(name)) != seal[name], F.lit(True))
    own = some(*[(k, ~F.coalesce(seal[k], F.lit(False))) for k in ("equations", "tables", "structure")], ("note", F.trim(text(seal["note"])) == ""), ("lang", ~seal["lang"].isin(*LANGUAGES) | (seal["lang"] != F.col("lang"))), ("source_changed", now("source")), ("layout_changed", now("layout")))
    return F.concat(layout_faults(F.col("layout"), F.col("pages")), F.when(seal.isNull(), F.array(F.lit("unreviewed"))).otherwise(own))


def figure_faults(figures: DataFrame, id_: str) -> DataFrame:
    """id, figure_errors, figures (digest): records (num, status, reviewed, reviewNote, reviewedAt) that aren't reviewed whole.

    Numbers that stand twice are a fault; records come in any order.
    """
    each = some(("review", ~F.coalesce("reviewed", F.lit(False))), ("note", F.trim(text("reviewNote")) == ""), ("missing", F.coalesce("status", F.lit("missing")) == "missing"), ("date", F.trim(text("reviewedAt")) == ""))
    bad = F.transform(each, lambda x: F.concat(F.lit("figure:"), text("num"), F.lit(":"), x))
    g = figures.groupBy(id_).agg(
        F.array_sort(F.flatten(F.collect_list(bad))).alias("_bad"), (F.count("num") > F.count_distinct("num")).alias("_twice"),
        F.array_sort(F.collect_list(F.to_json(F.struct("num", "status", "reviewed", "reviewNote", "reviewedAt")))).alias("_all"),
    )
    return g.select(id_, F.concat("_bad", some(("figure:twice", F.col("_twice")))).alias("figure_errors"), link(F.to_json("_all")).alias("figures"))


def gated(papers: DataFrame, seals: DataFrame, figures: DataFrame, id_: str) -> DataFrame:
    """Papers with seal, gate (what forbids to translate) and figures (digest)."""
    both = papers.join(seals.select(id_, "seal"), id_, "left").join(figure_faults(figures, id_), id_, "left")
    none = F.array().cast("array<string>")
    more = some(("not_english", F.col("lang") != "en"), ("token_in_source", text("source").contains("⟦WS")))
    return both.withColumn("gate", F.concat(review_faults(F.col("seal")), F.coalesce("figure_errors", none), more)).drop("figure_errors")


def links(seal: Column, figures: Column, body: Column, manifest: Column) -> tuple[Column, Column]:
    """The links of the review and of what was prepared from it, by the present source and layout."""
    reviewed = link(F.to_json(seal.withField("source", link(F.col("source"))).withField("layout", link(F.col("layout")))))
    return reviewed, link(reviewed, figures, body, F.to_json(manifest))


def prepare(papers: DataFrame, seals: DataFrame, figures: DataFrame, id_: str, before: DataFrame | None = None) -> DataFrame:
    """id, errors, body, manifest, source (digest), link: the locked skeletons of papers that may be translated.

    before: what was prepared earlier (id, source); where its source was another, nothing is prepared over it.
    """
    g = gated(papers, seals, figures, id_)
    if before is not None:
        g = g.join(before.select(id_, F.col("source").alias("_before")), id_, "left").withColumn("gate", F.concat("gate", some(("prepared_from_other", F.col("_before").isNotNull() & (F.col("_before") != link(F.col("source")))))))
    ok = F.size("gate") == 0
    # texts that the gate stops are not read
    p = g.withColumn("_p", prepared_udf(F.when(ok, F.col("source"))))
    keep = lambda x: F.when(ok, x)
    _, made = links(F.col("seal"), F.col("figures"), F.col("_p.body"), F.col("_p.manifest"))
    return p.select(id_, F.col("gate").alias("errors"), keep(F.col("_p.body")).alias("body"), keep(F.col("_p.manifest")).alias("manifest"), keep(link(F.col("source"))).alias("source"), keep(made).alias("link"))


def merge(papers: DataFrame, seals: DataFrame, figures: DataFrame, work: DataFrame, id_: str) -> DataFrame:
    """The work (id, body and manifest as prepared, locked, supplement, any others) with errors, text, link, prepared_link
    and review_holds: translations put together anew.

    What was prepared is derived again from the source; where it differs, nothing is merged.
    """
    g = gated(papers, seals, figures, id_).select(id_, "lang", "source", "layout", "pages", "seal", "figures", "gate").join(work.select(id_, F.struct("*").alias("_w")), id_, "inner")
    g = g.withColumn("_m", merged_udf("source", "_w.locked", "_w.supplement"))
    drift = (F.col("_w.body") != F.col("_m.body")) | (F.to_json("_w.manifest") != F.to_json("_m.manifest"))
    _, made = links(F.col("seal"), F.col("figures"), F.col("_m.body"), F.col("_m.manifest"))
    errors = F.concat("gate", some(("prepared_differs", drift)), "_m.errors")
    holds = F.coalesce((F.col("seal.source") == link(F.col("source"))) & (F.col("seal.layout") == link(F.col("layout"))), F.lit(False))
    return g.select("_w.*", errors.alias("errors"), F.when(F.size(errors) == 0, F.col("_m.text")).alias("text"), link(made, F.col("_w.locked"), F.col("_w.supplement")).alias("link"), made.alias("prepared_link"), holds.alias("review_holds"))


def check_translation(papers: DataFrame, seals: DataFrame, figures: DataFrame, work: DataFrame, id_: str) -> DataFrame:
    """id, ok, errors, void, text: outputs (work: as for merge, with output and the links recorded as ``made`` and ``joined``) compared
    with what their inputs give now.  void: the stages whose inputs changed since, each with all that follows from it."""
    m = merge(papers, seals, figures, work, id_)
    other = ~F.col("output").eqNullSafe(F.col("text"))
    # an input that changed changes its link and, as links hold the one before, every later one
    gone = some(("review", ~F.col("review_holds")), ("prepare", F.col("prepared_link") != F.col("made")), ("merge", F.col("link") != F.col("joined")), ("output", (F.col("link") != F.col("joined")) | other))
    errors = F.concat("errors", some(("output_differs", other)))
    return m.select(id_, (F.size(errors) == 0).alias("ok"), errors.alias("errors"), gone.alias("void"), "text")
