"""Translation protection: spans that must survive, tokens for them, and the checks.

A text is locked by tokens in order, translated, and restored; anything that
changes a token or adds protected matter is an error.  Numbering is sequential
within a text, so the work is an Arrow batch per text; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("text", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()))]))
# The patterns of what is protected.
NUMBER = re.compile(r"(?<![\d.])[-+−]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?:%|‰)?")
REFERENCES = re.compile(r"^(#{1,6})[ \t]+(?:References|参考文献)[ \t]*\r?$", re.I | re.M)
CODE_FENCE = re.compile(r"(?m)^([ \t]*)(`{3,}|~{3,})[^\n]*\n[\s\S]*?^\1\2[ \t]*(?:\n|$)")
MATH_BLOCK = re.compile(r"(?<!\\)\$\$[\s\S]*?(?<!\\)\$\$")
IMAGE = re.compile(r"!\[\[[^\]\n]+\]\]|!\[[^\]\n]*\]\([^\n]+?\)")
CODE_INLINE = re.compile(r"(?<!`)(`+)([^\n]+?)\1(?!`)")
MATH_INLINE = re.compile(r"(?<![\\$])\$(?!\$)(?:\\.|[^$\n])+?(?<!\\)\$(?!\$)")
TOKEN = re.compile(r"⟦WS\d{6}⟧")

HEADING = re.compile(r"^(#{1,6})[ \t]+.+$", re.M)
ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$", re.M)
#: A cell runs from a bar to the next one; a bar behind a backslash is text.
CELL = re.compile(r"(?<!\\)\|(?P<cell>(?:[^|\n]|(?<=\\)\|)*)(?=\|)")
#: What a cell is, by the first form that its text has as a whole: nothing to keep, a
#: quantity with signs and units, or else words, of which the numbers stay.
CELL_FORMS = (
    (re.compile(r"[\s:\-]*"), None),
    (re.compile(rf"\s*{NUMBER.pattern}(?:(?![㐀-鿿])[\w\s.,/%‰°+−\-±×^()\[\]{{}}*·⁻¹²³])*"), "table_cell"),
    (re.compile(r"[\s\S]*"), "table_number"),
)


def reference_sections(md: str) -> Iterator[tuple[str, int, int]]:
    """What stands below reference headings, which stay open to translation, up to a
    heading as high; one fold over the headings, with the section that is open."""
    begin, level = None, 0
    for h in HEADING.finditer(md) if REFERENCES.search(md) else ():
        if begin is not None and len(h[1]) <= level:
            yield "references", begin, h.start()
            begin = None
        if begin is None and (r := REFERENCES.match(md, h.start())):
            begin, level = r.end(), len(r[1])
    if begin is not None:
        yield "references", begin, len(md)


def table_values(md: str) -> Iterator[tuple[str, int, int]]:
    """Cells that are quantities, and the numbers in other cells."""
    for row in ROW.finditer(md) if "|" in md else ():
        for cell in CELL.finditer(md, *row.span()):
            kind = next(k for form, k in CELL_FORMS if form.fullmatch(cell["cell"]))
            spans = {"table_cell": [cell], "table_number": NUMBER.finditer(md, *cell.span("cell"))}.get(kind, ())
            yield from ((kind, *m.span("cell" if m is cell else 0)) for m in spans)


def every(kind: str, pattern: re.Pattern, *signs: str) -> Callable[[str], Iterator[tuple[str, int, int]]]:
    """All matches; signs: one of these stands in every match, so that a text without them isn't read by the pattern."""
    return lambda md: ((kind, *m.span()) for m in (pattern.finditer(md) if not signs or any(x in md for x in signs) else ()))


#: Where spans come from, in order of precedence: an earlier kind keeps its place.
SOURCES = (every("code_fence", CODE_FENCE, "```", "~~~"), reference_sections, every("math_block", MATH_BLOCK, "$$"), every("image", IMAGE, "!["), every("code_inline", CODE_INLINE, "`"), every("math_inline", MATH_INLINE, "$"), table_values)


def find_spans(md: str, sources: tuple = SOURCES) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) in order; a span that meets an earlier kind's is left out."""
    taken: list[tuple[int, int, str]] = []  # sorted, disjoint
    for kind, s, e in (x for source in sources for x in source(md)):
        i = bisect.bisect_left(taken, (s,))
        if e > s and (i == len(taken) or taken[i][0] >= e) and (i == 0 or taken[i - 1][1] <= s):
            taken.insert(i, (s, e, kind))
    return [(kind, md[s:e], s, e) for s, e, kind in taken]


@pandas_udf(SPANS)
def protected_spans_udf(md: pd.Series) -> pd.Series:
    """Ordered spans that do not overlap."""
    return pd.Series([[dict(zip(("kind", "text", "start", "end"), s, strict=True)) for s in find_spans(x or "")] for x in md])


def lock(md: str) -> tuple[str, list[tuple[str, str, str]]]:
    """(text with tokens, [(token, kind, text)])."""
    out, last, tokens = [], 0, []
    for k, (kind, body, s, e) in enumerate(find_spans(md), 1):
        token = f"⟦WS{k:06d}⟧"
        tokens.append((token, kind, body))
        out += [md[last:s], token]
        last = e
    return "".join([*out, md[last:]]), tokens


def restore(translated: str, locked: str, tokens: list) -> tuple[str, list[str]]:
    """(text, errors): every token once and in order, nothing protected besides, blocks one to one and none empty."""
    want, got, errors = [t[0] for t in tokens], TOKEN.findall(translated), []
    if got != want:
        kind = "missing" if set(want) - set(got) else "unknown" if set(got) - set(want) else "repeated" if len(got) != len(want) else "order"
        errors.append(f"token_{kind}")
    if find_spans(TOKEN.sub("", translated)):
        errors.append("new_protected")
    blocks = lambda s: [b for b in re.split(r"\n{2,}", s.strip())]
    a, b = blocks(locked), blocks(translated)
    if len(a) != len(b):
        errors.append("blocks")
    elif any(not TOKEN.sub("", y).strip() and TOKEN.sub("", x).strip() for x, y in zip(a, b, strict=True)):
        errors.append("empty_block")
    if errors:
        return "", errors
    text_of = {t[0]: t[2] for t in tokens}
    return TOKEN.sub(lambda m: text_of[m[0]], translated), []


LOCKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("token", "kind", "text")])))])
RESTORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))])


@pandas_udf(LOCKED)
def lock_udf(md: pd.Series) -> pd.DataFrame:
    done = [lock(x or "") for x in md]
    return pd.DataFrame({"text": [d[0] for d in done], "tokens": [[dict(zip(("token", "kind", "text"), t, strict=True)) for t in d[1]] for d in done]})


@pandas_udf(RESTORED)
def restore_udf(translated: pd.Series, locked: pd.Series, tokens: pd.Series) -> pd.DataFrame:
    done = [restore(t or "", k or "", [(x["token"], x["kind"], x["text"]) for x in (s if s is not None else [])]) for t, k, s in zip(translated, locked, tokens, strict=True)]
    return pd.DataFrame({"text": [d[0] for d in done], "errors": [d[1] for d in done]})


def token_context(tokens: Column, kinds: tuple[str, ...] = ("math_inline", "table_cell", "table_number")) -> Column:
    """JSON of the tokens whose text a translator must see."""
    return F.to_json(F.filter(tokens, lambda t: t["kind"].isin(*kinds)))


def compare_protected(en: DataFrame, zh: DataFrame, id_: str, first: int = 8) -> DataFrame:
    """id, pos, en, zh: the first places where the ordered spans differ (spans columns)."""
    side = lambda df, name: df.select(id_, F.posexplode("spans").alias("pos", "s")).select(id_, "pos", F.col("s.text").alias(name))
    diff = side(en, "en").join(side(zh, "zh"), [id_, "pos"], "full").where(~F.col("en").eqNullSafe(F.col("zh")))
    return diff.withColumn("_r", F.row_number().over(Window.partitionBy(id_).orderBy("pos"))).where(F.col("_r") <= first).drop("_r")


def insert_supplement(md: Column, supplement: Column, marker: str = ">【说明】") -> Column:
    """The supplement before ``## 摘要``; one with math or without its marker changes nothing."""
    ok = supplement.startswith(marker) & ~supplement.contains("$") & F.regexp_like(md, F.lit(r"(?m)^##\s+摘要"))
    at = F.regexp_instr(md, F.lit(r"(?m)^##\s+摘要"))
    return F.when(ok, F.concat(F.substring(md, F.lit(1), at - 1), supplement, F.lit("\n\n"), F.substring(md, at, F.length(md)))).otherwise(md)


def layout_errors(items: DataFrame, pages: Column) -> DataFrame:
    """items (kind, num, page) with error: no number, no page, a page outside the document."""
    page = F.col("page").try_cast("int")
    err = F.when(F.trim(F.coalesce("num", F.lit(""))) == "", "number").when(page.isNull(), "page").when(~page.between(1, pages), "range")
    return items.withColumn("error", err).where("error is not null")


def sealed(now: DataFrame, seal: DataFrame, id_: str) -> DataFrame:
    """id, ok: flags set, a note, a known language, and contents as they were sealed (sha256)."""
    both = now.select(id_, F.sha2("content", 256).alias("h")).join(seal, id_, "left")
    ok = F.col("reviewed") & (F.trim(F.coalesce("note", F.lit(""))) != "") & F.col("lang").isin("en", "zh") & (F.col("h") == F.col("digest"))
    return both.select(id_, F.coalesce(ok, F.lit(False)).alias("ok"))


def unpaired_dollar(md: Column) -> Column:
    """An odd number of single dollars outside math blocks and code."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(md, r"(?s)```.*?```", ""), r"(?s)\$\$.*?\$\$", ""), r"`[^`\n]*`|\\\$", "")
    return F.regexp_count(t, F.lit(r"\$")) % 2 == 1
