"""Patterns are tried only on texts that hold a sign of theirs, and find what they would find on all."""

from __future__ import annotations

import random
import re

from foliant.operators import protect, seals


def test_every_pattern_is_gated_and_finds_the_same():
    class Counted:
        def __init__(self):
            self.read = []

        def finditer(self, md):
            self.read.append(md)
            return re.finditer(r"\$", md)

    p = Counted()
    source = protect.every("dollar", p, "$", "~~~")
    assert [list(source(x)) for x in ("plain words", "a $ b", "~~~")] == [[], [("dollar", 2, 3)], []]
    assert p.read == ["a $ b", "~~~"]
    rnd, bits = random.Random(5), ["`", "```", "~~~\n", "$", "$$", "\\$", "![", "![[a.png]]", "![x](y)", "| a | 3 % |", "|:--|", "\n", "\n\n", "## References", "# Head", "words", "- item", "3.5"]
    plain = (
        protect.every("code_fence", protect.CODE_FENCE), protect.reference_sections, protect.every("math_block", protect.MATH_BLOCK), protect.every("image", protect.IMAGE),
        protect.every("code_inline", protect.CODE_INLINE), protect.every("math_inline", protect.MATH_INLINE), protect.table_values,
    )
    for _ in range(3000):
        md = "".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(1, 12)))
        assert protect.find_spans(md) == protect.find_spans(md, plain)


def test_a_merge_cuts_its_source_once(monkeypatch):
    n, cut = [], seals.pieces
    monkeypatch.setattr(seals, "pieces", lambda md: n.append(md) or cut(md))
    source = "# A\n\nwords of $x$ here\n\n- one"
    parts = seals.named(seals.pieces(source))
    body = seals.locked_body(parts)
    assert seals.merged(source, body, None, parts) == seals.merged(source, body, None) == (source, [])
    got = seals.merged_udf.func(*map(seals.pd.Series, ([source], [body], [None])))
    assert got["text"][0] == source and got["body"][0] == body and n == [source] * 3


def test_rules_of_texts_hold_with_and_without_their_signs(spark):
    from pyspark.sql import functions as F

    from foliant.operators import rules

    bits = ["<!--TLDR-->", "<!-- EQ", "| a < b |", "| a &lt; b |", "x < y", "a_{1} ", "$a_{1}$ ", "b^{2} ", "", "�", "\U0001d400", "é", "plain words", "\n", "$$x$$"]
    rnd = random.Random(4)
    texts = [*bits, "", "a_{1} " * 10, *["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(300)]]
    x, n = F.col("text"), lambda y, p: F.regexp_count(y, F.lit(p))
    rows = F.filter(F.split(x, "\n"), lambda s: F.ltrim(s).startswith("|"))
    plain = {
        "marker": rules.rx(x, rules.MARKER), "leftover": rules.rx(x, rules.LEFTOVER), "private_use": rules.rx(x, rules.PUA),
        "table_angle": F.exists(rows, lambda s: rules.rx(F.regexp_replace(s, F.lit(r"\\lt|\\gt|&lt;|&gt;"), F.lit("")), r"(?<!\\)[<>]")),
        "stray_many": n(rules.strip_math(x), r"[A-Za-z0-9)\]][_^]\{[^}]{1,12}\}") >= 10, "stray_some": n(rules.strip_math(x), r"[A-Za-z0-9)\]][_^]\{[^}]{1,12}\}").between(3, 9),
    }
    own = {r[0]: r[2](x) for r in [*rules.DOC_RULES, *rules.MATH_RULES] if r[0] in plain}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(*[c.alias(f"{k}_1") for k, c in own.items()], *[c.alias(f"{k}_2") for k, c in plain.items()]).toPandas()
    assert set(own) == set(plain)
    for k in plain:
        assert (df[f"{k}_1"] == df[f"{k}_2"]).all() and df[f"{k}_2"].any(), k


def test_a_report_shuffles_no_line(spark):
    from pyspark.sql import functions as F

    from foliant.operators import report

    none = F.array().cast("array<string>")
    works = spark.range(2).select("id", F.lit("en").alias("lang"), F.lit("article").alias("kind"), *[F.concat(F.lit("# "), F.col("id").cast("string")).alias(c) for c in ("en", "zh", "notes")], none.alias("figures"), none.alias("tables"), none.alias("equations"), none.alias("images"), F.create_map(F.lit("1"), F.lit("a")).alias("files"))
    assert not {"line", "s"} & set(report.marked_lines(works, "id").columns)
