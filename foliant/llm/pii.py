"""PII by weak supervision, with DataFrame and SQL functions only.

Candidates come from the base patterns (email, ip, card, phone) and from looser
spellings of each.  Four labelers vote on each (1 yes, -1 no, 0 abstains): the
shape of the value (its check digits, ranges, lengths), a gazetteer (top-level
domains, issuer prefixes, country and area codes, reserved networks), context cues
before the span, and contrary cues.  Votes are counted per kind and vote pattern: at
most kinds * 3**4 rows reach the driver, where expectation-maximisation
estimates each labeler's reliability for each kind, and the probability of every
pattern.  A naive Bayes span classifier is trained on these: its features
are the votes, the word before the span, the characters on either side, separators
and length; their sums over all candidates are a second aggregate, of a
few hundred rows.  It scores each candidate by a sum of log odds.  Base spans always
stay; the classifier adds spans of its own.

Positions: ``split`` and ``regexp_extract_all`` run the same pattern, so piece
lengths give the starts, in code points; they are added up in chunks, so the work
is linear in the text.  A pattern starts only where its run of characters does, or
right after the last match, and its repeats are possessive, so every pattern is
linear as well.  What stands before a span is read from the piece before it.

Each document stays in its row; candidates are written once to the shared folder
(ids, spans and features, no text) and only counts are shuffled.

Defined results: a null text is empty and has no spans; repeated rows are judged
alike; an empty table gives an empty result; without candidates the classifier
adds nothing; a loose span that meets a base span is a spelling of it and goes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "gazetteer", "context", "contrary")
WORD_BUCKETS = 64
FEATURE_SHARE = 0.5  # features depend on each other and on the votes: they count half

# Fixed patterns of the op9 contract, made linear; (pattern, text that every match holds).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser spellings, judged by the classifier alone.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|[\[(](?:dot|DOT)[\])]|\x20\.)\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/]|[\x20-]{2})[0-9]{4}(?:[._/]|[\x20-]{2})[0-9]{4}(?:[._/]|[\x20-]{2})[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z])",
}
# Fixed word lists of the labelers.
CUES = {
    "email": "mail|e-mail|email|contact|write|reach|courriel|correo|kontakt",
    "ip": "ip|address|server|host|login|client|adresse|from",
    "card": "card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte",
    "phone": "call|phone|tel|mobile|fax|cell|contact|text|ring|telefon|teléfono|téléphone",
}
CONTRARY = "version|release|isbn|issn|order|invoice|chapter|section|page|lines|build|serial|part|item|model"
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|us|eu|ch|at)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9](?!11)[0-9]{2})",
}


def _raw(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


def matches(text: str, pattern: str, chunk: int = 128) -> Column:
    """array<struct<s int, e int, v string, before string, after string>> of the matches of a pattern in a
    column; before is what stands there since the last match, 32 characters at most, after one character.

    ``transform(array(x), y -> ...)[0]`` evaluates x once.  Piece lengths are added up by
    chunk, so no array grows by more than a chunk's or the chunks' number of elements.
    """
    p = _raw(pattern)
    piece = "length(x['g']) + coalesce(length(x['1']), 0)"
    found = "named_struct('s', a.at + length(x['g']), 'e', a.at + length(x['g']) + length(x['1']), 'v', x['1'], 'before', right(x['g'], 32), 'after', left(coalesce(x['2'], ''), 1))"
    none = "cast(array() as array<struct<s:int,e:int,v:string,before:string,after:string>>)"
    return F.expr(f"""flatten(
        transform(array(split({text}, {p}, -1)), g ->
        transform(array(arrays_zip(g, regexp_extract_all({text}, {p}, 0), slice(g, 2, greatest(size(g), 1)))), z ->
        transform(array(transform(sequence(0, (size(z) - 1) div {chunk}), c -> slice(z, c * {chunk} + 1, {chunk}))), cs ->
        transform(array(aggregate(cs, struct(0 as at, cast(array() as array<int>) as o), (a, c) -> struct(a.at + aggregate(c, 0, (n, x) -> n + {piece}) as at, array_append(a.o, a.at) as o), a -> a.o)), o ->
            flatten(transform(arrays_zip(cs, o), q -> aggregate(q['cs'], struct(q['o'] as at, {none} as found),
                (a, x) -> struct(a.at + {piece} as at, if(x['1'] is null, a.found, array_append(a.found, {found})) as found), a -> a.found))))[0])[0])[0]))""")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    r = F.reverse(d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(r)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.ascii(r.substr(i, F.lit(1))) - 48).otherwise((F.ascii(r.substr(i, F.lit(1))) - 48) * 2 - F.when(F.ascii(r.substr(i, F.lit(1))) >= 53, 9).otherwise(0)),
    )
    return total % 10 == 0


def valid(kind: str, v: Column) -> Column:
    """The base pattern's own check."""
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255) | (F.length(F.ltrim(p, F.lit("0"))) == 0))
    if kind == "card":
        n = F.length(digits(v))
        return F.when(n.between(14, 19), luhn(digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(v)).between(10, 15)
    return F.lit(True)


def shape(kind: str, v: Column) -> Column:
    """Whether a loose value has the form of its kind."""
    if kind == "email":
        return F.regexp_like(plain_email(v), F.lit(r"\.[a-z]{2,10}$"))
    if kind == "ip":
        return F.forall(F.regexp_extract_all(v, F.lit("([0-9]+)")), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return valid("card", v)
    return F.regexp_like(digits(v), F.lit(r"^[2-9][0-9]{2}[2-9][0-9]{6}$")) | F.length(digits(v)).between(11, 15)


def plain_email(v: Column) -> Column:
    """An address spelled with words in its usual form."""
    return F.regexp_replace(F.regexp_replace(F.lower(v), r"\x20?[\[(]dot[\])]\x20?", "."), r"\x20?[\[(]at[\])]\x20?", "@")


def char_class(c: Column) -> Column:
    return F.when(c == "", "edge").when(c == " ", "space").when(F.regexp_like(c, F.lit(r"[0-9]")), "digit").when(F.regexp_like(c, F.lit(r"\p{L}")), "letter").otherwise("mark")


def votes(kind: str, base: bool, x: Column) -> Column:
    """A candidate with its labelers' votes and features."""
    before, v = F.lower(x["before"]), x["v"]
    form = F.lit(1) if base else F.when(shape(kind, v), 1).otherwise(-1)
    known = {"card": digits(v), "email": plain_email(v)}.get(kind, v)
    gaz = F.when(F.regexp_like(known, F.lit(GAZETTEER[kind])), 1).otherwise(-1)
    context = F.when(F.regexp_like(before, F.lit(rf"(?:^|[^a-z])(?:{CUES[kind]})[^a-z]")), 1).otherwise(0)
    contrary = F.when(F.regexp_like(before, F.lit(rf"(?:^|[^a-z])(?:{CONTRARY})[^a-z]")), -1).otherwise(0)
    n = x["e"] - x["s"]
    word = F.regexp_extract(before, r"([a-z]+)[^a-z]*$", 1)
    marks = F.regexp_replace(v, r"[\p{L}\p{N}]", "")
    features = {
        "size": F.when(n < 10, "short").when(n < 20, "middle").otherwise("long"),
        "word": F.when(word == "", "none").otherwise(F.pmod(F.crc32(word.cast("binary")), F.lit(WORD_BUCKETS)).cast("string")),
        "left": char_class(F.right(x["before"], F.lit(1))),
        "right": char_class(x["after"]),
        "marks": F.when(marks == "", "none").when(F.length(F.regexp_replace(marks, r"(.)(?=.*\1)", "")) == 1, F.left(marks, F.lit(1))).otherwise("several"),
    }
    return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), x["s"].alias("s"), x["e"].alias("e"), form.alias("shape"), gaz.alias("gazetteer"), context.alias("context"), contrary.alias("contrary"), *[f.alias(k) for k, f in features.items()])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, cands: all candidates of each document with their votes and features."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base_has = {
        "email": F.col("text").contains("@"),
        "ip": F.regexp_like("text", F.lit(r"[0-9]\.[0-9]")),
        "card": F.regexp_like("text", F.lit(r"[0-9][\x20-]?[0-9]")),
        "phone": F.col("text").contains("+"),
    }
    loose_has = {
        "email": F.regexp_like("text", F.lit(r"[\[(](?:at|AT)[\])]")),
        "ip": F.regexp_like("text", F.lit(r"[0-9]\x20?(?:[\[(](?:\.|dot|DOT)[\])]|\x20\.)")),
        "card": F.regexp_like("text", F.lit(r"[0-9]{4}(?:[._/]|[\x20-]{2})[0-9]{4}")),
        "phone": F.regexp_like("text", F.lit(r"[0-9)][.\x20-]?[0-9]{3}[.\x20-][0-9]{4}")),
    }
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string,before:string,after:string>>)")
    df = df.withColumns({f"b_{k}": F.when(base_has[k], matches("text", p)).otherwise(none) for k, p in BASE.items()} | {f"l_{k}": F.when(loose_has[k], matches("text", p)).otherwise(none) for k, p in LOOSE.items()})
    checked = lambda k: F.filter(f"b_{k}", lambda x: valid(k, x["v"]))
    voted = lambda k, base, found: F.transform(found, lambda x: votes(k, base, x))
    parts = [*(voted(k, True, checked(k)) for k in BASE), *(voted(k, False, F.col(f"l_{k}")) for k in LOOSE)]
    return df.select("doc_id", F.concat(*parts).alias("cands"))


def posterior(v: tuple[int, ...], reliability: list[float], prior: float) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for a, x in zip(reliability, v, strict=True):
        if x:
            yes += math.log(a if x > 0 else 1 - a)
            no += math.log(1 - a if x > 0 else a)
    return 1 / (1 + math.exp(min(700, no - yes)))


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple, float]:
    """EM over (kind, votes, count) -> probability of each (kind, votes).

    A labeler has one reliability for each kind, at least one half, with ten
    pseudo-votes of four fifths; abstaining says nothing.
    """
    out = {}
    for kind in {k for k, *_ in counts}:
        own = [(v, c) for k, v, c in counts if k == kind]
        rel, prior = [0.8] * len(LABELERS), 0.5
        for _ in range(rounds):
            post = [posterior(v, rel, prior) for v, _ in own]
            prior = min(0.98, max(0.02, (5 + sum(p * c for p, (_, c) in zip(post, own, strict=True))) / (10 + sum(c for _, c in own))))
            for j in range(len(LABELERS)):
                seen = sum(c for v, c in own if v[j])
                right = sum(c * (p if v[j] > 0 else 1 - p) for p, (v, c) in zip(post, own, strict=True) if v[j])
                rel[j] = min(0.98, max(0.55, (right + 8) / (seen + 10)))
        # base candidates are nearly all of a kind, and right: they must not decide for loose ones alone
        out |= {(kind, *v): posterior(v, rel, min(prior, 0.6)) for v, _ in own}
    return out


def feature_weights(sums: list[tuple[str, str, str, float, float]], votes_of: dict[tuple, float], counts: list[tuple[str, tuple[int, ...], int]]) -> dict[str, dict[str, float]]:
    """(kind, feature, value, yes, no) sums -> kind -> ``feature=value`` -> log odds, add-one smoothed."""
    out: dict[str, dict[str, float]] = {}
    for kind in {k for k, *_ in counts}:
        own = [r for r in sums if r[0] == kind]
        w = out.setdefault(kind, {})
        for name in {r[1] for r in own}:
            values = [r for r in own if r[1] == name]
            yes, no, n = sum(r[3] for r in values), sum(r[4] for r in values), len(values) + 1
            for _, _, value, y, x in values:
                w[f"{name}={value}"] = math.log((y + 1) / (yes + n)) - math.log((x + 1) / (no + n))
    return out


FEATURES = ("size", "word", "left", "right", "marks")


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id -> base and all: arrays of (s, rank of kind, e, kind), in order."""
    cands = written(candidates(docs), "pii")
    # looser candidates that touch a base span are spellings of it
    apart = F.expr("filter(cands, x -> x.base or not exists(cands, y -> y.base and y.s < x.e and x.s < y.e))")
    cands = cands.select("doc_id", F.when(F.expr("exists(cands, x -> not x.base)"), apart).otherwise(F.col("cands")).alias("cands"))
    flat = cands.select(F.inline("cands"))
    counts = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in flat.groupBy("kind", *LABELERS).count().collect())
    believed = estimate(counts)
    key = lambda x: F.concat_ws(":", x["kind"], *[x[n].cast("string") for n in LABELERS])
    table = lambda d: F.create_map(*[F.lit(y) for kv in sorted(d.items()) for y in kv]) if d else F.expr("cast(map() as map<string,double>)")
    belief = table({":".join(map(str, k)): p for k, p in believed.items()})
    col = {n: F.col(n) for n in ("kind", *LABELERS)}
    soft = flat.withColumn("p", F.coalesce(F.try_element_at(belief, key(col)), F.lit(0.5)))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in FEATURES]))
    # loose candidates teach what loose ones look like
    sums = soft.where("not base").select("kind", "p", pairs.alias("f")).groupBy("kind", "f.name", "f.value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    weights = feature_weights([(r["kind"], r["name"], r["value"], r["yes"], r["no"]) for r in sums], believed, counts)
    odds = table({f"{k}|{f}": w for k, ws in weights.items() for f, w in ws.items()})
    limit = math.log(threshold / (1 - threshold))

    def added(x: Column) -> Column:
        p = F.coalesce(F.try_element_at(belief, key(x)), F.lit(0.5))
        own = [F.coalesce(F.try_element_at(odds, F.concat(x["kind"], F.lit(f"|{n}="), x[n])), F.lit(0.0)) for n in FEATURES]
        return F.ln(p / (1 - p)) + sum(own[1:], own[0]) * FEATURE_SHARE > limit

    rank = F.create_map(*[F.lit(y) for i, k in enumerate(KINDS) for y in (k, i)])

    def put(array: Column) -> Column:
        return F.array_sort(F.transform(array, lambda x: F.struct(x["s"].alias("s"), rank[x["kind"]].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"))))

    return cands.select("doc_id", put(F.filter("cands", lambda x: x["base"])).alias("base"), put(F.filter("cands", lambda x: x["base"] | added(x))).alias("all"))


def pii_digests(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("all").alias("spans"))
