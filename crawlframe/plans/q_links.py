"""Queries for the link jobs (T1-T7, T9, T11, J3, A1 on pages, X7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import host_fingerprint, url_host
from ..operators import discovery as D
from ..operators import links as L
from . import inputs as I
from . import sqlgen as sg
from .catalog import register

LINKS = sg.links_cte("pages")
# T3 reads the pages with two area links in front, one of which repeats the page's first anchor.
AREA_PAGES = """(SELECT page_id, url, '<map><area shape=rect href="/map/' || page_id || '"><AREA alt="x > y" href=/The></map>' || html AS html FROM pages)"""
LINKS_TEXT = sg.links_cte(AREA_PAGES, with_text=True, strip_href=True, areas=True)
RESOLVED = f"SELECT *, {sg.resolve('base_url', 'href')} AS target_url FROM ({LINKS})"


def _pages(spark, sf_dir):
    return I.table(spark, sf_dir, "pages")


# -- flagship: links per target host (T1 -> T2 -> F2 -> A1) -----------------
def links_per_target_host(spark, sf_dir):
    links = L.resolve_links(L.extract_links(_pages(spark, sf_dir)))
    keyed = links.select("page_id", "url", "pos", "target_url",
                         url_host("target_url").alias("target_host"),
                         host_fingerprint("target_url").alias("host_fp")).where(F.col("host_fp").isNotNull())
    return keyed.groupBy("page_id", "url", "host_fp", "target_host").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.min("pos").alias("first_pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target_url"))),
                                 lambda x: x["target_url"]), "\n").alias("links"))


register("links_per_target_host", f"""
SELECT page_id, url, host_fp, target_host, count(*) AS n_links, min(pos) AS first_pos,
       string_agg(target_url, chr(10) ORDER BY pos) AS links
FROM (SELECT page_id, url, pos, target_url, {sg.host('target_url')} AS target_host,
             {sg.host_fingerprint('target_url')} AS host_fp FROM ({RESOLVED}))
WHERE host_fp IS NOT NULL
GROUP BY page_id, url, host_fp, target_host""")(links_per_target_host)


@register("t1_extract_links", f"SELECT page_id, url, pos, href FROM ({LINKS})")
def t1_extract_links(spark, sf_dir):
    return L.extract_links(_pages(spark, sf_dir)).select("page_id", "url", "pos", "href")


@register("t2_resolve_links", f"SELECT page_id, pos, href, target_url FROM ({RESOLVED})")
def t2_resolve_links(spark, sf_dir):
    return L.resolve_links(L.extract_links(_pages(spark, sf_dir))).select("page_id", "pos", "href", "target_url")


_FOLLOW = ", ".join(sg.q(s) for s in L.FOLLOW_SCHEMES)
_IGNORED = ", ".join(sg.q(s) for s in L.IGNORED_EXTENSIONS)
_T3_SQL = f"""
SELECT page_id, url, pos, href, target_url, link_text FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, target_url ORDER BY pos) AS rn FROM (
    SELECT page_id, url, pos, href, {sg.resolve('base_url', 'href')} AS target_url, link_text FROM ({LINKS_TEXT})
  )
  WHERE lower(regexp_extract(target_url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) IN ({_FOLLOW})
    AND (CASE WHEN contains(split_part(regexp_extract(target_url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/', -1), '.')
         THEN lower(split_part(split_part(regexp_extract(target_url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/', -1), '.', -1))
         ELSE '' END) NOT IN ({_IGNORED})
) WHERE rn = 1"""


@register("t3_unique_links", _T3_SQL)
def t3_unique_links(spark, sf_dir):
    areas = F.concat(F.lit('<map><area shape=rect href="/map/'), F.col("page_id").cast("string"),
                     F.lit('"><AREA alt="x > y" href=/The></map>'), F.col("html"))
    return L.extract_unique_links(_pages(spark, sf_dir).withColumn("html", areas))


@register("t4_count_links", f"""
SELECT page_id, CAST(len(regexp_extract_all({sg.strip_inert('html')}, {sg.q(sg.A_RE)}, 0)) AS BIGINT) AS n_links
FROM pages""")
def t4_count_links(spark, sf_dir):
    return L.count_links(_pages(spark, sf_dir))


_MT = "lower(trim(split_part(coalesce(content_type, ''), ';', 1)))"
_HTML_IN = ", ".join(sg.q(s) for s in L.HTML_TYPES)
_TEXT_IN = ", ".join(sg.q(s) for s in L.HTML_TYPES + L.TEXT_TYPES_EXTRA)


@register("t5_content_gates", f"""
SELECT page_id, content_type, {_MT} IN ({_HTML_IN}) AS is_html
FROM ({I.RESPONSES_SQL})
WHERE starts_with({_MT}, 'text/') OR ends_with({_MT}, '+xml') OR {_MT} IN ({_TEXT_IN})""")
def t5_content_gates(spark, sf_dir):
    r = L.where_text(I.responses(spark, sf_dir))
    return r.select("page_id", "content_type",
                    L.normalise_mimetype("content_type").isin(L.HTML_TYPES).alias("is_html"))


# Allowed domains: every three-label page host (its subdomains pass too).
@register("t6_onsite_links", f"""
WITH d AS (
  SELECT DISTINCT {sg.host('url')} AS domain FROM pages
  WHERE len(string_split({sg.host('url')}, '.')) = 3
), l AS (
  SELECT page_id, pos, target_url, {sg.host('target_url')} AS h FROM ({RESOLVED})
)
SELECT page_id, pos, target_url FROM l
WHERE EXISTS (SELECT 1 FROM d WHERE l.h = d.domain OR ends_with(l.h, '.' || d.domain))""")
def t6_onsite_links(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    h = url_host("url")
    domains = pages.where(F.size(F.split(h, r"\.")) == 3).select(h.alias("domain"))
    links = L.resolve_links(L.extract_links(pages)).select("page_id", "pos", "target_url")
    return L.filter_onsite(links, domains)


# Seeds (the page URLs themselves) pass whatever their host; their links do not.
@register("t6_seeds_exempt", f"""
WITH d AS (SELECT DISTINCT {sg.host('url')} AS domain FROM pages WHERE len(string_split({sg.host('url')}, '.')) = 4),
l AS (SELECT page_id, target_url, FALSE AS is_seed FROM ({RESOLVED}) UNION ALL SELECT page_id, url, TRUE FROM pages)
SELECT page_id, target_url, is_seed FROM l
WHERE is_seed OR EXISTS (SELECT 1 FROM d WHERE {sg.host('target_url')} = d.domain OR ends_with({sg.host('target_url')}, '.' || d.domain))""")
def t6_seeds_exempt(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    h = url_host("url")
    domains = pages.where(F.size(F.split(h, r"\.")) == 4).select(h.alias("domain"))
    links = L.resolve_links(L.extract_links(pages)).select("page_id", "target_url", F.lit(False).alias("is_seed"))
    seeds = pages.select("page_id", F.col("url").alias("target_url"), F.lit(True).alias("is_seed"))
    return L.filter_onsite(links.unionByName(seeds), domains, seed_col="is_seed")


@register("t7_max_body", """
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages
WHERE octet_length(encode(html)) <= 20000""")
def t7_max_body(spark, sf_dir):
    r = I.responses(spark, sf_dir)
    return L.filter_max_size(r, 20000).select("page_id", F.octet_length("body").cast("bigint").alias("n_bytes"))


# Homepages: every distinct origin of a page, plus a query and a fragment
# variant of each to exercise the path rules (only the first two qualify).
_HOME_SQL = """
SELECT DISTINCT o || suffix AS url FROM (
  SELECT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1) AS o FROM pages
) CROSS JOIN (VALUES ('/'), ('/?q=1'), ('/#top'), ('')) AS v(suffix)"""


def homepage_candidates(spark, sf_dir):
    o = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    origins = _pages(spark, sf_dir).select(o.alias("o")).distinct()
    sfx = F.explode(F.array(*[F.lit(s) for s in ("/", "/?q=1", "/#top", "")]))
    return origins.select("o", sfx.alias("_s")).select(F.concat("o", "_s").alias("url")).distinct()


_WK_VALUES = ", ".join(f"({i}, {sg.q(u)})" for i, u in enumerate(D.DEFAULT_WELL_KNOWN_URIS))


@register("t9_well_known", f"""
SELECT h.url AS via,
       regexp_extract(h.url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)/(.*)$', 1) || w.u
         || regexp_extract(h.url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)/(.*)$', 2) AS url,
       'I' AS hop, CAST(w.ord AS INTEGER) AS ord
FROM ({_HOME_SQL}) h CROSS JOIN (VALUES {_WK_VALUES}) AS w(ord, u)
WHERE {sg.is_homepage('h.url')}""")
def t9_well_known(spark, sf_dir):
    return D.expand_well_known(homepage_candidates(spark, sf_dir))


@register("t11_annotate_links", f"""
SELECT l.page_id, l.pos, l.target_url AS url, coalesce(r.hop_path, '') AS hop_path, 'L' AS hop,
       r.url AS via, r.source AS source
FROM ({RESOLVED}) l JOIN ({I.RESPONSES_SQL}) r ON l.page_id = r.page_id""")
def t11_annotate_links(spark, sf_dir):
    links = L.resolve_links(L.extract_links(_pages(spark, sf_dir))).select(
        "page_id", "pos", F.col("target_url").alias("url"))
    parents = I.responses(spark, sf_dir).select("page_id", "url", "hop_path", "source")
    return D.annotate_links(links, parents).select("page_id", "pos", "url", "hop_path", "hop", "via", "source")


@register("j3_discover", f"""
WITH p AS (SELECT page_id, url FROM pages
           UNION ALL
           SELECT -1 - ('0x' || substr(md5(url), 1, 15))::BIGINT AS page_id, url FROM ({_HOME_SQL})),
wk AS (
  SELECT p.page_id, CAST(w.ord AS INTEGER) AS ord,
         regexp_extract(p.url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)/(.*)$', 1) || w.u
           || regexp_extract(p.url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)/(.*)$', 2) AS url, 'I' AS hop
  FROM p CROSS JOIN (VALUES {_WK_VALUES}) AS w(ord, u) WHERE {sg.is_homepage('p.url')}
), ex AS (
  SELECT page_id, pos + 8 AS ord, target_url AS url, 'L' AS hop FROM ({RESOLVED})
)
SELECT x.page_id, x.ord, x.url, x.hop, '' AS hop_path, p.url AS via, p.url AS source
FROM (SELECT * FROM wk UNION ALL SELECT * FROM ex) x JOIN p ON x.page_id = p.page_id""")
def j3_discover(spark, sf_dir):
    full = _pages(spark, sf_dir)
    pages = full.select("page_id", "url")
    # extra homepages get a synthetic negative id from the URL (60 bits of md5)
    homes = homepage_candidates(spark, sf_dir).select(
        (F.lit(-1) - F.conv(F.substr(F.md5("url"), F.lit(1), F.lit(15)), 16, 10).cast("bigint")).alias("page_id"),
        "url")
    parents = D.tag_seeds(pages.unionByName(homes))
    links = L.resolve_links(L.extract_links(full))
    return D.discover(parents, links)


# The tables' pages embed nothing: every page gets an image, a script, a style sheet and a frame around its html.
_EMBED_HTML = ("'<LINK rel=stylesheet href=\"/s/' || page_id || '.css\"><img alt=\"a > b\" src=''i.png''>' || html || "
               "'<script async src=/s.js>var x = \"<img src=no.png>\";</script><iframe src=\"//f.example.org/?p=' || page_id || "
               "'&amp;q\"></iframe><img src=last.gif><!-- <img src=none> -->'")
_EMBED_CLEAN = ("regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<style\\b.*?</style\\s*>', '', 'g'), "
                "'(?is)(<script\\b[^>]*>).*?</script\\s*>', '\\1', 'g')")
_EMBED_RE = "(?i)<(?:" + "|".join(t + sg._SQL_ATTR + r"*?\s+" + a + r"\s*=\s*" + sg._SQL_VALUE for t, a in L.EMBED_TAGS) + ")"
_EMBED_RAW = "CASE lower(regexp_extract(m, '^<([A-Za-z]+)', 1)) " + " ".join(
    f"WHEN {sg.q(t)} THEN regexp_extract(m, {sg.q(sg.tag_re(t, a))}, 1)" for t, a in L.EMBED_TAGS) + " END"
_X7_SQL = f"""
SELECT page_id, url, CAST(pos AS INTEGER) AS pos, tag, {sg.resolve('base_url', sg.unquote_attr('raw'))} AS target_url, 'E' AS hop
FROM (
  SELECT page_id, url, base_url, pos, lower(regexp_extract(m, '^<([A-Za-z]+)', 1)) AS tag, {_EMBED_RAW} AS raw
  FROM (
    SELECT page_id, url, base_url, unnest(es) AS m, generate_subscripts(es, 1) - 1 AS pos
    FROM (SELECT page_id, url, {sg.resolve('url', sg.base_href('html'))} AS base_url,
                 regexp_extract_all({_EMBED_CLEAN}, {sg.q(_EMBED_RE)}, 0) AS es
          FROM (SELECT page_id, url, {_EMBED_HTML} AS html FROM pages))
  )
)"""


@register("x7_embeds", _X7_SQL)
def x7_embeds(spark, sf_dir):
    return L.extract_embeds(_pages(spark, sf_dir).withColumn("html", F.expr(_EMBED_HTML.replace("''i.png''", "\\'i.png\\'"))))


# -- seeds and responses (S1, S2, S4, T10) ----------------------------------
# Seed files are written from the page URLs into the checkpoint folder and read
# back through the readers: text lines (every third with trailing spaces, a
# blank line after every tenth page) and tab-separated rows (every seventh
# without a URL).
@register("s1_seed_lines", "SELECT url, CAST(NULL AS VARCHAR) AS source_page FROM pages")
def s1_seed_lines(spark, sf_dir):
    from ..session import scratch_path
    from ..sources.seeds import read_seeds
    p = _pages(spark, sf_dir)
    lines = p.select(F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("  \t"))).otherwise(F.col("url"))
                     .alias("value")).unionByName(p.where(F.col("page_id") % 10 == 0).select(F.lit("").alias("value")))
    path = scratch_path(spark, "seeds") + "/seeds.txt"
    lines.write.text(path)
    return read_seeds(spark, path)


@register("s2_seed_csv", """
SELECT url, 'landing-' || CAST(page_id AS VARCHAR) AS source_page FROM pages WHERE page_id % 7 <> 0""")
def s2_seed_csv(spark, sf_dir):
    from ..session import scratch_path
    from ..sources.seeds import read_seeds
    p = _pages(spark, sf_dir)
    rows = p.select(F.concat(F.lit("landing-"), F.col("page_id").cast("string")).alias("source_page"),
                    F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.col("url")).alias("url"))
    path = scratch_path(spark, "seeds") + "/list.csv"
    rows.write.option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    return read_seeds(spark, path)


@register("s3_no_seeds", "SELECT url, CAST(page_id AS VARCHAR) AS source_page FROM pages")
def s3_no_seeds(spark, sf_dir):
    """A job without a seed list starts from the URLs it knows: reading no list adds no rows and fails nothing."""
    from ..sources.seeds import read_seeds
    known = _pages(spark, sf_dir).select("url", F.col("page_id").cast("string").alias("source_page"))
    return known.unionByName(read_seeds(spark, None))


@register("s4_read_responses", """
SELECT page_id, url, CAST(200 AS INTEGER) AS status_code, 'text/html' AS content_type,
       CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages""")
def s4_read_responses(spark, sf_dir):
    from ..sources.seeds import read_responses
    r = read_responses(_pages(spark, sf_dir))
    return r.select("page_id", "url", "status_code", "content_type", F.octet_length("body").cast("bigint").alias("n_bytes"))


@register("t10_tag_seeds", """
SELECT url, coalesce(CASE WHEN page_id % 2 = 1 THEN 'http://seed.example.com/' || CAST(page_id % 11 AS VARCHAR) END, url)
       AS source FROM pages""")
def t10_tag_seeds(spark, sf_dir):
    p = _pages(spark, sf_dir)
    src = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("http://seed.example.com/"), (F.col("page_id") % 11)
                                                     .cast("string")))
    return D.tag_seeds(p.select("url", src.alias("source"))).select("url", "source")


# -- sitemaps (X9) ----------------------------------------------------------
# One sitemap document per page, listing that page's own hrefs (XML-escaped),
# built inside the row; the extractor must give back the resolved URLs, hop M.
@register("x9_sitemap_urls", f"""
SELECT page_id, url, pos, {sg.resolve('url', 'trim(href)')} AS target_url, 'M' AS hop FROM ({LINKS})""")
def x9_sitemap_urls(spark, sf_dir):
    from ..functions.html import link_values, unquote_attr
    p = _pages(spark, sf_dir)
    hrefs = F.transform(link_values("html"), lambda v: unquote_attr(v, False))
    locs = F.transform(hrefs, lambda h: F.concat(F.lit("<url><loc>"), F.replace(h, F.lit("&"), F.lit("&amp;")),
                                                 F.lit("</loc></url>")))
    docs = p.select("page_id", "url", F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(locs, ""),
                                               F.lit("</urlset>")).alias("body"))
    return L.extract_sitemap_urls(docs, "page_id", "url", "body")
