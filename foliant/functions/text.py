"""Text scalars as column expressions; all stay in the JVM unless named ``*_udf``.

Absent text is the empty string, as in the library's own data model: callers
coalesce at the boundary.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Fixed character classes and separators.
CJK = r"一-鿿"
SEARCH_SEPARATORS = r"[/\-_·,，。：:；;]+"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x: Column | str, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c(x), F.lit(pattern), F.lit(to))


def text(x: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(c(x), F.lit(""))


def blank_to_null(x: Column | str) -> Column:
    return F.when(F.trim(c(x)) != "", c(x))


def first_of(*xs: Column | str) -> Column:
    """The first that is not blank, else the empty string."""
    return F.coalesce(*[blank_to_null(x) for x in xs], F.lit(""))


def squeeze(x: Column | str) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(sub(x, r"\s+", " "))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return sub(text(x), r"^\s+|\s+\z")


def link_key_unicode(x: Column | str) -> Column:
    """Lower case, letters and digits of any script only (catalogue side)."""
    return sub(F.lower(text(x)), r"[^\p{L}\p{N}]")


def link_key_ascii(x: Column | str) -> Column:
    """Lower case, ASCII letters and digits and CJK only (client side)."""
    return sub(F.lower(text(x)), rf"[^a-z0-9{CJK}]")


def search_text(x: Column | str) -> Column:
    return sub(F.lower(text(x)), SEARCH_SEPARATORS, " ")


def line_key(x: Column | str) -> Column:
    """Lower case, white space collapsed, runs of digits as one #: for repeated lines."""
    return sub(squeeze(F.lower(text(x))), r"\d+", "#")


def file_name(x: Column | str, limit: int = 120) -> Column:
    """A file name: forbidden characters and controls to spaces, collapsed, cut."""
    clean = squeeze(sub(text(x), r'[\\/:*?"<>|\x00-\x1f]', " "))
    return sub(F.substring(sub(clean, r"^[ .]+|[ .]+$"), 1, limit), r"[ .]+$")


def yaml_quote(x: Column | str) -> Column:
    body = F.replace(F.replace(text(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), body, F.lit('"'))


def strip_frontmatter(x: Column | str) -> Column:
    return sub(text(x), r"(?s)\A---\r?\n.*?\r?\n---\r?\n?")


def strip_front_junk(x: Column | str) -> Column:
    """Without a code fence around the whole text, and without frontmatter."""
    open_ = F.regexp_extract(text(x), r"(?s)\A\s*```[a-z]*\n(.*?)\n```\s*\z", 1)
    return F.trim(strip_frontmatter(F.when(open_ != "", open_).otherwise(F.trim(text(x)))))


def drop_section(x: Column | str, heading: str) -> Column:
    """Without the ``## heading…`` section, up to the next heading of its level."""
    return sub(text(x), rf"(?ims)^##[ \t]+{heading}.*?(?=^##[ \t]|\z)")


def section_after(x: Column | str, heading: str) -> Column:
    """The non-blank, stripped lines of the first ``## …heading…`` section, comments left out."""
    body = F.regexp_extract(text(x), rf"(?ms)^##[ \t][^\n]*{heading}[^\n]*\n(.*?)(?=^##[ \t]|\z)", 1)
    lines = F.transform(F.split(body, "\n"), lambda s: F.trim(s))
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~s.startswith("<!--")), "\n")


def field_from_card(x: Column | str, label: str) -> Column:
    """``- **label**：value`` with Markdown links as their text."""
    value = F.regexp_extract(text(x), rf"(?m)^[ \t]*-[ \t]*\*\*{label}\*\*[ \t]*[：:][ \t]*(.*)$", 1)
    return F.trim(sub(value, r"\[([^\]]*)\]\([^)]*\)", "$1"))


def strip_math(x: Column | str) -> Column:
    return sub(sub(sub(text(x), r"(?s)\$\$.*?\$\$", " "), r"\$[^$\n]*\$", " "), r"`[^`\n]*`", " ")


def prose_length(x: Column | str) -> Column:
    """Characters without math, embeds, captions, table and quote lines, and white space."""
    t = strip_math(x)
    t = sub(t, r"!\[\[[^\]]*\]\]")
    t = sub(t, r"(?m)^(?:\||>).*$")
    t = sub(t, r"(?m)^\*\*(?:Fig\.?|Figure|Table|图|表)[^\n]*$")
    return F.length(sub(t, r"\s+"))


def cjk_count(x: Column | str) -> Column:
    return F.length(sub(text(x), rf"[^{CJK}]"))


def letter_count(x: Column | str) -> Column:
    return F.length(sub(text(x), r"[^\p{L}]"))


def cjk_ratio(x: Column | str) -> Column:
    return F.when(letter_count(x) > 0, cjk_count(x) / letter_count(x)).otherwise(0.0)


def anchor_text(x: Column | str) -> Column:
    """Lower-case ASCII letters and digits, TeX commands of inline math left out."""
    return sub(F.lower(sub(text(x), r"\\[A-Za-z]+", " ")), r"[^a-z0-9]")


def url_encode_path(x: Column | str) -> Column:
    """Each segment percent-encoded; spaces as %20, slashes kept."""
    def one(s):
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            s = F.replace(s if a != "+" else F.url_encode(s), F.lit(a), F.lit(b))
        return s

    return F.array_join(F.transform(F.split(text(x), "/"), one), "/")


def encode_asset_url(x: Column | str) -> Column:
    """Idempotent: each segment decoded where it is valid, then encoded as a component of a URI; the origin stays."""
    origin = F.regexp_extract(text(x), r"(?i)^([a-z][a-z0-9+.-]*://[^/]+)", 1)
    rest = F.substring(text(x), F.length(origin) + 1, F.length(text(x)))

    def one(s: Column) -> Column:
        plain = F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
        # octets that are no UTF-8 decode to a replacement character, which counts as invalid
        whole = F.when(~plain.contains("\ufffd") | s.contains("\ufffd"), plain)
        out = F.url_encode(F.coalesce(whole, s))
        for a, b in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.concat(origin, F.array_join(F.transform(F.split(rest, "/"), one), "/"))


def join_asset_url(base: Column | str, name: Column | str) -> Column:
    """A name below a base that may end in a slash, encoded."""
    return encode_asset_url(F.concat(sub(text(base), r"/\z"), F.lit("/"), text(name)))


def has_web_variant(url: Column | str) -> Column:
    """Whether an image is of a kind that is also kept in a smaller size."""
    return F.regexp_like(text(url), F.lit(r"(?i)\.(png|jpe?g)\z"))


def is_cjk(x: Column | str) -> Column:
    """Whether a text begins with a Chinese character, CJK punctuation or a full-width form."""
    return F.regexp_like(text(x), F.lit(r"^[一-鿿　-〿＀-￯]"))


def scoped_path(path: Column | str, root: str) -> Column:
    """The path if it lies in the root and no part of it is ``..``, else null; links aren't followed."""
    parts, top = F.split(text(path), "/+"), root.rstrip("/")
    inside = (text(path) == top) | text(path).startswith(f"{top}/")
    return F.when(inside & ~F.array_contains(parts, ".."), text(path))


def split_sentences(x: Column | str) -> Column:
    return F.split(text(x), r"(?<=[.!?;])\s+")


def quoted(word: Column | str) -> Column:
    """A regular expression for the literal text."""
    return sub(text(word), r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")


def whole_word(word: Column | str) -> Column:
    return F.concat(F.lit(r"(?i)(?<![A-Za-z])"), quoted(word), F.lit(r"(?![A-Za-z])"))


def sentence_for_word(x: Column | str, word: Column | str) -> Column:
    """The first sentence with the whole word, else the first that contains it, else the text."""
    s = split_sentences(x)
    whole = F.filter(s, lambda t: F.regexp_like(t, whole_word(word)))
    part = F.filter(s, lambda t: F.contains(F.lower(t), F.lower(text(word))))
    return F.coalesce(F.get(whole, F.lit(0)), F.get(part, F.lit(0)), F.trim(text(x)))


def count_hits(x: Column | str, query: Column | str) -> Column:
    """Case-insensitive literal hits; a blank query has none."""
    q = F.lower(F.trim(text(query)))
    return F.when(q == "", 0).otherwise(F.regexp_count(F.lower(text(x)), quoted(q)))


def chips(x: Column | str) -> Column:
    """Keywords: split at commas and semicolons of both scripts, final dots and blanks dropped."""
    return F.filter(F.transform(F.split(text(x), r"[；;,，]"), lambda s: strip(sub(strip(s), r"[.。]+\z"))), lambda s: s != "")


def as_list(x: Column | str) -> Column:
    """``[a, b]`` or ``a, b`` -> trimmed, unquoted, non-blank parts."""
    inner = sub(F.trim(text(x)), r"^\[|\]$")
    return F.filter(F.transform(F.split(inner, ","), lambda s: sub(F.trim(s), r"""^["']|["']$""")), lambda s: s != "")


def strip_heading_emoji(x: Column | str) -> Column:
    return squeeze(sub(text(x), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"))


def heading_slug(x: Column | str, index: Column | str) -> Column:
    body = sub(sub(F.lower(text(x)), rf"[^a-z0-9{CJK}]+", "-"), r"^-+|-+$")
    return F.concat(F.lit("h"), c(index).cast("string"), F.lit("-"), F.substring(body, 1, 32))


def let(x: Column, f) -> Column:  # noqa: ANN001
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def join_lines(lines: Column | str) -> Column:
    """Lines to one: CJK neighbours without a space, hyphenated words whole, else a space."""
    def add(acc, line):
        line = F.trim(line)
        hyphen = F.regexp_like(acc, F.lit(r"[A-Za-z]-$")) & F.regexp_like(line, F.lit(r"^[a-z]"))
        tight = F.regexp_like(acc, F.lit(rf"[{CJK}，。；：、]$")) & F.regexp_like(line, F.lit(rf"^[{CJK}]"))
        return F.when(acc == "", line).when(line == "", acc).when(hyphen, F.concat(sub(acc, "-$"), line)).when(tight, F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(c(lines), F.lit(""), add)


def title_case_surname(x: Column | str) -> Column:
    """ALL CAPS to Capitalised; mixed case stays."""
    x = text(x)
    return F.when(F.regexp_like(F.substring(x, 2, 10_000), F.lit(r"[a-zà-ÿ]")), x).otherwise(F.concat(F.substring(x, 1, 1), F.lower(F.substring(x, 2, 10_000))))


def equation_id(x: Column | str) -> Column:
    """A label in canonical form: no blanks, one kind of prime, no leading zeros, no dot after the prefix."""
    x = sub(sub(text(x), r"\s+"), "'", "′")
    return sub(sub(x, r"^([A-Za-z])(?=\d)", "$1."), r"(^|\.)0+(?=\d)", "$1")


def natural_key(num: Column | str) -> Column:
    """Sort key of hierarchical labels: prefix, numbers, prime."""
    x = text(num)
    numbers = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)")), lambda s: s.cast("int"))
    return F.struct(F.ascii(F.regexp_extract(x, r"^([A-Za-z]?)", 1)).alias("prefix"), numbers.alias("numbers"), F.regexp_like(x, F.lit("[′']$")).alias("prime"))


def jaccard(a: Column | str, b: Column | str, token: str = r"([a-z0-9]{3,})") -> Column:
    """Token Jaccard of two texts; 0 if neither has tokens."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(text(t)), F.lit(token))) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def doi_key(x: Column | str) -> Column:
    return sub(F.lower(F.trim(text(x))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)")


# Unicode normal forms have no JVM expression: Arrow batches.
@pandas_udf(T.StringType())
def ascii_name_udf(x: pd.Series) -> pd.Series:
    """Compatibility-decomposed, accents dropped, ASCII letters and digits only."""
    plain = x.fillna("").map(lambda s: "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)))
    return plain.str.replace(r"[^A-Za-z0-9]", "", regex=True)


@pandas_udf(T.StringType())
def author_key_udf(x: pd.Series) -> pd.Series:
    """Accents dropped, lower case, ASCII letters, digits and CJK only."""
    plain = x.fillna("").map(lambda s: "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.category(ch).startswith("M")))
    return plain.str.lower().str.replace(r"[^a-z0-9一-鿿]", "", regex=True)


@pandas_udf(T.StringType())
def reference_identity_udf(x: pd.Series) -> pd.Series:
    """Links and anchors dropped, NFKC, lower case, letters and digits only."""
    out = x.fillna("").str.replace(r"\[([^\]]*)\]\([^)]*\)", r"\1", regex=True).str.replace(r"https?://\S+|\^ref-\w+", "", regex=True)
    return out.map(lambda s: "".join(ch for ch in unicodedata.normalize("NFKC", s).lower() if ch.isalnum()))
