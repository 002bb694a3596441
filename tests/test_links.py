"""Link extraction goldens (T1, T3, T4), on-site filter (T6), embeds (X7), sitemaps."""

from crawlframe.operators import links as L

PAGES = [
    (1, "http://h.org/", '<a href="/x">1</a><a class=q href=\'/y\'>2</a><A HREF=/z>3</A>'),
    (2, "http://h.org/", '<a href="/x">1</a><a href="/x">2</a>'),
    (3, "http://h.org/", '<!-- <a href="/c">c</a> --><script>\'<a href="/s">\'</script>'),
    (4, "http://h.org/", '<a href="/q?a=1&amp;b=2">q</a><a name="n">n</a><link href="/l.css">'),
    (5, "http://h.org/", '<a href="mailto:x@y">m</a>'),
    (6, "http://h.org/a/", '<base href="http://b.org/d/"><a data-href="/no" href="e">E <b>x</b></a><abbr href="/no">'),
]


def _pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_extract_links(spark):
    got = {}
    for r in L.extract_links(_pages(spark)).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.href)
    assert got == {1: ["/x", "/y", "/z"], 2: ["/x", "/x"], 4: ["/q?a=1&b=2"], 5: ["mailto:x@y"], 6: ["e"]}


def test_count_links(spark):
    got = {r.page_id: r.n_links for r in L.count_links(_pages(spark)).collect()}
    assert got == {1: 3, 2: 2, 3: 0, 4: 1, 5: 1, 6: 1}


def test_resolve_with_base(spark):
    r = L.resolve_links(L.extract_links(_pages(spark))).where("page_id = 6").first()
    assert r.target_url == "http://b.org/d/e"


def test_unique_links(spark):
    rows = L.extract_unique_links(_pages(spark)).collect()
    by = {(r.page_id, r.target_url): r.link_text for r in rows}
    assert by[(2, "http://h.org/x")] == "1"
    assert (5, "mailto:x@y") not in by          # not a followable scheme
    assert by[(6, "http://b.org/d/e")] == "E x"
    assert len([k for k in by if k[0] == 2]) == 1


def test_ignored_extension(spark):
    df = spark.createDataFrame([(1, "http://h/", '<a href="/a.PDF">p</a><a href="/b.html">b</a>')],
                               "page_id long, url string, html string")
    assert [r.target_url for r in L.extract_unique_links(df).collect()] == ["http://h/b.html"]


def test_onsite_filter(spark):
    links = spark.createDataFrame([("http://a.example.com/x",), ("http://example.com/",), ("http://badexample.com/",),
                                   ("http://other.org/",), ("mailto:x@y",)], "target_url string")
    domains = spark.createDataFrame([("example.com",), ("a.example.com",)], "domain string")
    got = sorted(r.target_url for r in L.filter_onsite(links, domains).collect())
    assert got == ["http://a.example.com/x", "http://example.com/"]


def test_gates_and_size(spark):
    df = spark.createDataFrame([("text/html; charset=utf-8", b"x"), ("application/xhtml+xml", b"xx"),
                                ("text/plain", b"x"), ("image/png", b"x"), (None, b"x")],
                               "content_type string, body binary")
    assert L.where_text(df).count() == 3
    assert L.where_html(df).count() == 2
    assert L.filter_max_size(df, 1).count() == 4


def test_embeds_and_sitemap(spark):
    df = spark.createDataFrame([(1, "http://h/p/", '<img src="i.png"><script src="/s.js">var a="<img src=no>"</script>')],
                               "page_id long, url string, html string")
    got = [(r.tag, r.target_url) for r in L.extract_embeds(df).collect()]
    assert ("img", "http://h/p/i.png") in got and ("script", "http://h/s.js") in got and len(got) == 2
    sm = spark.createDataFrame([(1, "http://h/sitemap.xml", "<urlset><url><loc> http://h/a?x=1&amp;y=2 </loc></url></urlset>")],
                               "id long, url string, body string")
    assert L.extract_sitemap_urls(sm, "id", "url", "body").first().target_url == "http://h/a?x=1&y=2"


def test_character_references(spark):
    from pyspark.sql import functions as F
    from crawlframe.functions.html import unescape
    cases = {"/a&amp;b": "/a&b", "&amp;#39;": "&#39;", "&#39;x&#x2F;": "'x/", "&#128512;": "\U0001F600",
             "&#0;": "�", "&#xD800;": "�", "a & b": "a & b", "&lt;&gt;&quot;&nbsp;": "<>\" ",
             "&unknown;": "&unknown;", "plain": "plain", "caf&eacute; &copy;&Eacute;": "café ©É",
             "&amp": "&amp"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for r in df.select("s", unescape(F.col("s")).alias("u")).collect():
        assert r.u == cases[r.s], r.s


def test_href_whitespace_and_text(spark):
    df = spark.createDataFrame([(1, "http://h/a/", '<a href=" b ">  two\n words </a>')],
                               "page_id long, url string, html string")
    r = L.resolve_links(L.extract_links(df)).first()
    assert r.href == " b " and r.target_url == "http://h/a/b "      # as the attribute selector + urljoin give it
    u = L.extract_unique_links(df).first()
    assert u.target_url == "http://h/a/b" and u.link_text == "  two\n words "


def test_huge_and_unclosed_pages_keep_document_order(spark):
    from crawlframe.operators import links as L
    pages = [(1, "http://h/", "<a href=/x>" + "<b>i</b><i>" * 50_000 + "<a href='/y' id=q>t</a>"),
             (2, "http://h/", "<a " + "x=1 " * 20_000 + "href=/many>n</a>"),
             (3, "http://h/", "<area href=/m1><a href=/a1>one <area href=/m2> two</a><a href=/m1>late</a>"),
             (4, "http://h/", "<a href=/l&#0000000000065;&#x00000000041;&#99999999999;>z</a>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {}
    for r in L.extract_links(df, with_text=True, include_area=True).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.href, r.link_text))
    assert got[1] == [("/x", ""), ("/y", "t")] and got[2] == [("/many", "n")]
    assert got[3] == [("/m1", ""), ("/a1", "one  two"), ("/m2", ""), ("/m1", "late")]
    assert got[4] == [("/lAA�", "z")]
    assert {r.page_id: r.n_links for r in L.count_links(df).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}
    first = [r.link_text for r in L.extract_unique_links(df).where("target_url = 'http://h/m1'").collect()]
    assert first == [""]
    embeds = L.extract_embeds(spark.createDataFrame([(1, "http://h/", "<img src=a><script src=b></script><img src=c><link href=d>")],
                                                    "page_id long, url string, html string"))
    assert [r.tag for r in embeds.orderBy("pos").collect()] == ["img", "script", "img", "link"]


def test_areas_inside_and_beside_anchors_keep_document_order(spark):
    from crawlframe.operators.links import extract_links
    html = ('<AREA href=0><a href="1">one <area href="2" /> <b>x</b><area nohref><area href=3></a> text <area href=4> stray </a>'
            '<a href=5>open <area href=6><a href="7">seven</a ><a name=n>no</a><a href=8 />eight</a>')
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    got = extract_links(df, with_text=True, include_area=True).orderBy("pos").collect()
    assert [(r.pos, r.href, r.link_text) for r in got] == [
        (0, "0", ""), (1, "1", "one  x"), (2, "2", ""), (3, "3", ""), (4, "4", ""), (5, "5", ""), (6, "6", ""), (7, "7", "seven"), (8, "8", "eight")]
    assert [r.href for r in extract_links(df, with_text=True).orderBy("pos").collect()] == ["1", "5", "7", "8"]
