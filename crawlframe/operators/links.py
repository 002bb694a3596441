"""Link jobs over fetched pages: extract (T1), resolve (T2), unique links with
anchor text (T3), counts (T4), content-type gates (T5), on-site filter (T6),
body-size filter (T7), embeds (X7) and sitemap locations (X9).

Pages are processed where they sit: the regex scan of the HTML runs inside the
scan's stage, and only the small (page, position, href) rows move on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import col_of, once
from ..functions.html import (AREA_RE, LINK_SPAN_RE, anchor_text, base_href, embed_re, link_values,
                              strip_inert, unquote_attr)
from ..functions.urls import clean_reference, domain_suffixes, resolve_url, url_host

# Response types parsed as text and as HTML.
HTML_TYPES = ["text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml"]
TEXT_TYPES_EXTRA = ["application/xml", "application/json", "application/x-json",
                    "application/javascript", "application/x-javascript",
                    "application/atom+xml", "application/rdf+xml", "application/rss+xml"]

# File extensions whose links the unique-link extractor ignores.
IGNORED_EXTENSIONS = [
    # archives
    "7z", "7zip", "bz2", "rar", "tar", "tar.gz", "xz", "zip",
    # images
    "mng", "pct", "bmp", "gif", "jpg", "jpeg", "png", "pst", "psp", "tif", "tiff", "ai", "drw",
    "dxf", "eps", "ps", "svg", "cdr", "ico", "webp",
    # audio
    "mp3", "wma", "ogg", "wav", "ra", "aac", "mid", "au", "aiff",
    # video
    "3gp", "asf", "asx", "avi", "mov", "mp4", "mpg", "qt", "rm", "swf", "wmv", "m4a", "m4v", "flv",
    "webm",
    # office suites
    "xls", "xlsx", "ppt", "pptx", "pps", "doc", "docx", "odt", "ods", "odg", "odp",
    # other
    "css", "pdf", "exe", "bin", "rss", "dmg", "iso", "apk", "jar", "sh", "rb", "js", "hta", "bat",
    "cpl", "msi", "msp", "py",
]
# Schemes a followable link may have.
FOLLOW_SCHEMES = ["http", "https", "file", "ftp"]

# Embed tags and the attribute holding the embedded URL.
EMBED_TAGS = [("img", "src"), ("script", "src"), ("link", "href"), ("iframe", "src"),
              ("embed", "src"), ("source", "src"), ("video", "src"), ("audio", "src"),
              ("input", "src")]


def normalise_mimetype(ct) -> "F.Column":
    """T13 variant for gating: first ';'-part, trimmed, lower-cased; '' when absent."""
    return F.lower(F.trim(F.substring_index(F.coalesce(col_of(ct), F.lit("")), ";", 1)))


def where_text(df: DataFrame, ct_col: str = "content_type") -> DataFrame:
    """T5: keep responses parsed as text (text/*, +xml, json, javascript, html)."""
    m = normalise_mimetype(ct_col)
    return df.where(m.startswith("text/") | m.endswith("+xml") | m.isin(HTML_TYPES + TEXT_TYPES_EXTRA))


def where_html(df: DataFrame, ct_col: str = "content_type") -> DataFrame:
    """T5: keep HTML responses only."""
    return df.where(normalise_mimetype(ct_col).isin(HTML_TYPES))


def filter_max_size(df: DataFrame, n: int = 10 * 1024 * 1024, body_col: str = "body") -> DataFrame:
    """Drop responses whose body is over ``n`` bytes (10 MiB by default)."""
    return df.where(F.octet_length(F.col(body_col)) <= F.lit(n))


def extract_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", with_text: bool = False, include_area: bool = False,
                  strip_href: bool = False) -> DataFrame:
    """Every ``<a href>`` of a page in document order, duplicates and any scheme kept.

    The href is the attribute value as an attribute selector returns it:
    quotes removed and references decoded, surrounding whitespace kept
    (``strip_href`` strips it, as the unique-link extractor does).
    Returns (id, url, base_url, pos, href[, link_text]) with ``pos`` 0-based;
    ``base_url`` is the page URL, or its ``<base href>`` resolved against it.
    With ``include_area``, ``<area href>`` counts as well, in document order and
    without text. Only start tags are matched; anchor text is what stands
    between the tag and ``</a>``, '' if the anchor is not closed.
    """
    clean = pages.select(F.col(id_col), F.col(url_col), strip_inert(html_col).alias("_h"))
    clean = clean.select(id_col, url_col, "_h", base_href("_h", stripped=True).alias("_b"))
    base = F.when(F.col("_b") == "", F.col(url_col)).otherwise(resolve_url(F.col(url_col), F.col("_b")))
    if include_area or with_text:
        # one pass over the page: each match is a link's start tag and, of an anchor, what stands before its </a>
        spans = F.regexp_extract_all(F.col("_h"), F.lit(LINK_SPAN_RE), F.lit(0))
        if include_area:  # those inside an anchor's text come after it
            inner = lambda m: F.regexp_extract_all(F.regexp_extract(m, LINK_SPAN_RE, 2), F.lit(AREA_RE), F.lit(0))
            found = F.flatten(F.transform(spans, lambda m: F.concat(F.array(m), inner(m))))
        else:
            found = F.filter(spans, lambda m: ~m.rlike("(?i)^<area"))
    else:
        found = F.transform(link_values("_h", stripped=True), lambda v: F.struct(v.alias("raw")))
    per_page = clean.select(id_col, url_col, once(base).alias("base_url"), found.alias("_ms"))

    def parse(m):
        if not (include_area or with_text):
            return F.struct(unquote_attr(m["raw"], strip_href).alias("href"))
        raw = F.concat(F.regexp_extract(m, LINK_SPAN_RE, 1), F.regexp_extract(m, LINK_SPAN_RE, 3))
        out = [unquote_attr(raw, strip_href).alias("href")]
        if with_text:
            out.append(anchor_text(F.regexp_extract(m, LINK_SPAN_RE, 2)).alias("link_text"))
        return F.struct(*out)

    parsed = F.transform("_ms", parse)
    # posexplode_outer + filter on its output: plain posexplode makes Catalyst
    # infer size(array) > 0 and push it to the scan, running the extraction twice
    df = per_page.select(id_col, url_col, "base_url", F.posexplode_outer(parsed).alias("pos", "_l")) \
        .where(F.col("pos").isNotNull())
    cols = [F.col(id_col), F.col(url_col), "base_url", F.col("pos").cast("int").alias("pos"),
            F.col("_l.href").alias("href")]
    if with_text:
        cols.append(F.col("_l.link_text").alias("link_text"))
    return df.select(*cols)


def resolve_links(links: DataFrame, base_col: str = "base_url", href_col: str = "href") -> DataFrame:
    """``target_url`` = href resolved against the page (its ``<base>`` first), raw.

    Computed once per link behind a generator barrier: later host, key and
    filter expressions read the column instead of re-inlining the resolver.
    """
    cleaned = links.select("*", once(clean_reference(F.col(href_col))).alias("_ref"))
    return cleaned.select(
        "*", once(resolve_url(F.col(base_col), F.col(href_col), cleaned_ref=F.col("_ref"))).alias("target_url")) \
        .drop("_ref")


def count_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """T4: number of ``<a href>`` per page, 0 when none (no explode, no shuffle)."""
    return pages.select(F.col(id_col), F.size(link_values(html_col)).cast("bigint").alias("n_links"))


def _extension(url) -> "F.Column":
    path = F.regexp_extract(col_of(url), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.substring_index(path, "/", -1)
    return F.when(last.contains("."), F.lower(F.substring_index(last, ".", -1))).otherwise(F.lit(""))


def extract_unique_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                         html_col: str = "html", include_area: bool = True) -> DataFrame:
    """Links of a page de-duplicated on the resolved URL, first occurrence wins.

    Followable schemes only, links to ignored file extensions dropped, anchor
    text kept as ``link_text``. The de-duplication is a group-by whose partial
    aggregate runs map-side (all links of a page sit in one task already), so
    only distinct links cross the shuffle.
    """
    links = extract_links(pages, id_col, url_col, html_col, with_text=True, include_area=include_area,
                          strip_href=True)
    links = resolve_links(links).drop("base_url")
    scheme = F.lower(F.regexp_extract("target_url", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    links = links.where(scheme.isin(FOLLOW_SCHEMES) & ~_extension("target_url").isin(IGNORED_EXTENSIONS))
    first = (links.groupBy(id_col, url_col, "target_url")
             .agg(F.min(F.struct("pos", "href", "link_text")).alias("_f")))
    return first.select(id_col, url_col, F.col("_f.pos").alias("pos"), F.col("_f.href").alias("href"),
                        "target_url", F.col("_f.link_text").alias("link_text"))


def minimal_domains(domains: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Allowed domains minus those already covered by an allowed parent domain."""
    d = domains.select(F.lower(F.col(domain_col)).alias("domain")).distinct()
    parents = d.select("domain", F.explode(F.slice(domain_suffixes("domain"), F.lit(2), F.size(domain_suffixes("domain")))).alias("parent"))
    covered = parents.join(d.withColumnRenamed("domain", "parent"), "parent", "left_semi").select("domain")
    return d.join(covered, "domain", "left_anti")


def filter_onsite(links: DataFrame, domains: DataFrame, url_col: str = "target_url",
                  domain_col: str = "domain", seed_col: str | None = None) -> DataFrame:
    """Keep links whose host is an allowed domain or a subdomain of one;
    rows whose ``seed_col`` is true are seeds, which are exempt.

    An equi-join on the host's dot-suffixes (at most one per label), so Spark
    may broadcast a small allow-list (AQE checks its size at run time) or
    sort-merge a large one; with the minimal domain set each link matches at
    most one suffix, so no row is duplicated.
    """
    if seed_col:
        is_seed = F.coalesce(F.col(seed_col), F.lit(False))
        return links.where(is_seed).unionByName(filter_onsite(links.where(~is_seed), domains, url_col, domain_col))
    allowed = minimal_domains(domains, domain_col).withColumnRenamed("domain", "_sfx")
    exploded = links.withColumn("_sfx", F.explode(domain_suffixes(url_host(F.col(url_col)))))
    return exploded.join(allowed, "_sfx", "left_semi").drop("_sfx")


def extract_embeds(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Embedded resources (img, script, link, iframe, ...) as hop ``E``.

    ``pos`` counts all embed tags of a page in document order. Comments and
    style bodies are dropped and script *bodies* emptied, so a
    script's own ``src`` is kept but tags inside script text are not.
    """
    cleaned = F.regexp_replace(
        F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<style\b.*?</style\s*>", ""),
        r"(?is)(<script\b[^>]*>).*?</script\s*>", "$1")
    per_page = pages.select(F.col(id_col), F.col(url_col), cleaned.alias("_c"), base_href(html_col).alias("_b"))
    base = F.when(F.col("_b") == "", F.col(url_col)).otherwise(resolve_url(F.col(url_col), F.col("_b")))
    pattern = embed_re([t for t, a in EMBED_TAGS if a == "src"], [t for t, a in EMBED_TAGS if a == "href"])
    # one pass over the page; its matches are short, and read group by group
    part = lambda m, k: F.regexp_extract(m, pattern, k)
    found = F.transform(F.regexp_extract_all(F.col("_c"), F.lit(pattern), F.lit(0)), lambda m: F.struct(
        F.lower(F.concat(part(m, 1), part(m, 3))).alias("tag"), F.concat(part(m, 2), part(m, 4)).alias("raw")))
    df = per_page.select(id_col, url_col, once(base).alias("base_url"), found.alias("_es")) \
        .select(id_col, url_col, "base_url", F.posexplode_outer("_es").alias("pos", "_e")) \
        .where(F.col("pos").isNotNull())
    found = df.select(F.col(id_col), F.col(url_col), F.col("pos").cast("int").alias("pos"),
                      F.col("_e.tag").alias("tag"), "base_url", unquote_attr(F.col("_e.raw")).alias("_href"))
    return found.select(id_col, url_col, "pos", "tag",
                        once(resolve_url(F.col("base_url"), F.col("_href"))).alias("target_url"),
                        F.lit("E").alias("hop"))


def extract_sitemap_urls(docs: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """``<loc>`` entries of sitemap XML as hop ``M`` requests."""
    locs = F.regexp_extract_all(F.col(body_col), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    df = docs.select(F.col(id_col), F.col(url_col), F.posexplode_outer(locs).alias("pos", "_loc")) \
        .where(F.col("pos").isNotNull())
    return df.select(F.col(id_col), F.col(url_col), F.col("pos").cast("int").alias("pos"),
                     resolve_url(F.col(url_col), F.trim(F.regexp_replace(
                         F.replace(F.col("_loc"), F.lit("&amp;"), F.lit("&")), r"<!\[CDATA\[|\]\]>", "")))
                     .alias("target_url"),
                     F.lit("M").alias("hop"))
