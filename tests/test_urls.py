"""URL helpers: RFC 3986 resolution goldens, hosts, fingerprints, partitions."""

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import urls as U

BASE = "http://a/b/c/d;p?q"
RFC = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"),
    ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"),
    ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"),
    ("../..", "http://a/"), ("../../", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"),
    ("../../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."),
    (".g", "http://a/b/c/.g"), ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"),
    ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"),
    ("g/../h", "http://a/b/c/h"), ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y"),
]
OTHERS = [
    ("http://h.org", "x", "http://h.org/x"),
    ("https://m.x.net/en/25#top", "/für", "https://m.x.net/für"),
    ("http://h.org/fr/825?page=2&ref=x", "next", "http://h.org/fr/next"),
]


def test_resolve_rfc_examples(spark):
    rows = [(BASE, r, e) for r, e in RFC] + OTHERS
    df = spark.createDataFrame(rows, "base string, ref string, expected string")
    got = df.select("ref", "expected", U.resolve_url(F.col("base"), F.col("ref")).alias("got")).collect()
    bad = [(r.ref, r.expected, r.got) for r in got if r.got != r.expected]
    assert not bad


def test_resolve_matches_urljoin(spark):
    from urllib.parse import urljoin
    rows = [(BASE, r) for r, _ in RFC if not r.startswith("g:")]
    df = spark.createDataFrame(rows, "base string, ref string")
    for r in df.select("base", "ref", U.resolve_url(F.col("base"), F.col("ref")).alias("got")).collect():
        assert r.got == urljoin(r.base, r.ref), r.ref


def test_fingerprints_and_partition(spark):
    df = spark.createDataFrame([("http://example.com/",), ("http://example.com/a;p?q=1#f",),
                                ("https://EXAMPLE.com:8080/x",)], "url string")
    out = df.select(U.url_fingerprint("url").alias("fp"), U.host_crc32("url").alias("crc"),
                    U.host_partition("url", 2).alias("p"), U.host_fingerprint("url").alias("hfp")).collect()
    assert [r.fp for r in out] == ["b6fa4eb96666cd76f96956469e7be39d750cc7d9",
                                   "b6fa4eb9b23527715d7d9fc527a11ff5168cb449",
                                   "b6fa4eb9cc8755609ad61864910f145119713de9"]
    assert out[0].crc == 3069857465 and out[0].p == 1
    assert out[0].hfp == "0caaf24ab1a0c33440c06afe99df986365b0781f"


@pytest.mark.parametrize("url,host", [("http://User@Ex.COM:80/x", "ex.com"), ("https://[::1]:8/a", "[::1]"),
                                      ("http://under_score.org/", "under_score.org"), ("mailto:x@y", "")])
def test_host(spark, url, host):
    assert spark.range(1).select(U.url_host(F.lit(url))).first()[0] == host


def test_homepage_rules(spark):
    cases = {"http://h.org/": True, "http://h.org/?q=1": True, "http://h.org/?q=1#top": True,
             "http://h.org/;p=1": True, "http://h.org": False, "http://h.org/#top": False,
             "http://h.org//": False, "http://h.org/a": False}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    for r in df.select("url", U.is_homepage("url").alias("h")).collect():
        assert r.h == cases[r.url], r.url
