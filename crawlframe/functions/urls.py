"""URL column expressions: split, host, reference resolution, fingerprints.

Everything here returns a ``Column`` built from built-in Spark functions, so it
stays inside whole-stage codegen and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col_of

# RFC 3986 appendix B, with each delimiter kept inside its group so that
# "present but empty" ("//", "?", "#") differs from "absent" ('').
URL_PARTS_RE = r"^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
# scheme://[userinfo@](host | [ipv6])
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
# everything after the authority: path, params, query, fragment
AFTER_AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$"


def _part(url: Column, idx: int) -> Column:
    return F.regexp_extract(url, URL_PARTS_RE, idx)


def url_parts(url) -> dict[str, Column]:
    """scheme (with ':'), authority (with '//'), path, query (with '?'), fragment (with '#').

    An empty query ('?') or fragment ('#') counts as absent, as in the
    standard library's join the crawler used.
    """
    u = col_of(url)
    q, f = _part(u, 4), _part(u, 5)
    return {
        "scheme": _part(u, 1),
        "authority": _part(u, 2),
        "path": _part(u, 3),
        "query": F.when(q == "?", F.lit("")).otherwise(q),
        "fragment": F.when(f == "#", F.lit("")).otherwise(f),
    }


def url_host(url) -> Column:
    """Lower-cased host of an absolute URL, '' when there is none.

    A regex instead of ``parse_url``: that one throws on bad input and returns
    null for legal hosts such as ``under_score.org``.
    """
    return F.lower(F.regexp_extract(col_of(url), HOST_RE, 1))


def url_origin(url) -> Column:
    """scheme://authority of an absolute URL."""
    p = url_parts(url)
    return F.concat(p["scheme"], p["authority"])


def url_after_authority(url) -> Column:
    return F.regexp_extract(col_of(url), AFTER_AUTHORITY_RE, 1)


def remove_dot_segments(path: Column) -> Column:
    """Dot-segment removal as the standard library's join does it: drop '.',
    let '..' pop the previous segment (the root's empty one too, nothing when
    empty), add '/' after a final '.' or '..', and keep a rooted path rooted."""
    segs = F.split(path, "/", -1)
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segs, -1)
    trailing = (F.size(segs) > 1) & last.isin(".", "..")
    joined = F.array_join(F.when(trailing, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.startswith("/") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def squeeze_inner_slashes(path: Column) -> Column:
    """Drop empty segments between the first and the last: '/a//b/' -> '/a/b/'."""
    segs = F.split(path, "/", -1)
    n = F.size(segs)
    inner = F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != "")
    return F.when(n > 2, F.array_join(F.concat(F.slice(segs, 1, 1), inner, F.slice(segs, -1, 1)), "/")) \
        .otherwise(path)


# Schemes whose references resolve relative to a base of the same scheme.
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]


def clean_reference(ref) -> Column:
    """The join's input cleanup: drop tab/CR/LF, strip leading C0 controls and spaces."""
    return F.regexp_replace(F.regexp_replace(col_of(ref), r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def resolve_url(base, ref, cleaned_ref=None) -> Column:
    """Resolve ``ref`` against ``base`` like the standard library's join that
    the crawler used: RFC 3986 §5.2, except that a relative reference merged
    with the base directory loses empty inner segments ('g//h' -> 'g/h'), a
    network-path reference ('//h/p') keeps its path as written, 'http:g' is
    relative to an http base, the scheme comes out lower-cased, an empty
    reference returns the base unchanged (fragment included), and an empty
    query or fragment counts as absent. Raw: no percent-encoding."""
    raw_ref = col_of(ref)
    # the join strips leading C0 controls/spaces and drops tab, CR, LF first
    # (pass ``cleaned_ref`` when it is already computed once per row)
    ref = cleaned_ref if cleaned_ref is not None else clean_reference(raw_ref)
    b = url_parts(base)
    r = url_parts(ref)
    r["authority"] = F.when(r["authority"] == "//", F.lit("")).otherwise(r["authority"])  # '///p' has none
    b["scheme"] = F.lower(b["scheme"])
    # 'http:g' against an http base is relative; any other scheme stands alone
    r_scheme = F.lower(r["scheme"])
    same_scheme = (r_scheme == b["scheme"]) & F.substring_index(r_scheme, ":", 1).isin(RELATIVE_SCHEMES[1:])
    stands_alone = (r_scheme != "") & ~same_scheme
    has = lambda c: c != ""  # noqa: E731 - delimiters are inside the groups
    # merge(): base has authority and empty path -> '/' + ref; else base up to its last '/'
    base_dir = F.regexp_extract(b["path"], r"^(.*/)", 1)
    merged = (
        F.when(has(b["authority"]) & (b["path"] == ""), F.concat(F.lit("/"), r["path"]))
        .otherwise(F.concat(base_dir, r["path"]))
    )
    path_rel = (
        F.when(r["path"] == "", b["path"])
        .when(r["path"].startswith("/"), remove_dot_segments(r["path"]))
        .otherwise(remove_dot_segments(squeeze_inner_slashes(merged)))
    )
    query_rel = F.when((r["path"] == "") & ~has(r["query"]), b["query"]).otherwise(r["query"])
    resolved = (
        F.when(raw_ref == "", col_of(base))
        .when(stands_alone, raw_ref)
        .when(has(r["authority"]),
              F.concat(b["scheme"], r["authority"], r["path"], r["query"], r["fragment"]))
        .otherwise(F.concat(b["scheme"], b["authority"], path_rel, query_rel, r["fragment"]))
    )
    return resolved


def crc32_hex(s) -> Column:
    """8 lower-case hex digits of the unsigned CRC-32 of the UTF-8 bytes."""
    return F.lpad(F.lower(F.hex(F.crc32(col_of(s).cast("binary")))), 8, "0")


def host_crc32(url) -> Column:
    """Unsigned CRC-32 of the lower-cased host, as BIGINT."""
    return F.crc32(url_host(url).cast("binary"))


def url_fingerprint(url) -> Column:
    """host-prefixed request fingerprint, 40 hex chars.

    Contract: 8 hex of crc32(lower(host)) then md5 of everything after the
    authority (path, params, query, fragment). Scheme and port take no part, so
    http and https copies of a page share one fingerprint, and all URLs of a
    host sort next to each other.
    """
    return F.concat(crc32_hex(url_host(url)), F.md5(url_after_authority(url)))


def host_fingerprint(url) -> Column:
    """domain fingerprint (sha1 of the lower-cased host); null when there is no host."""
    h = url_host(url)
    return F.when(h != "", F.sha1(h.cast("binary")))


def host_partition(url, n: int) -> Column:
    """partition of a URL's host among ``n`` (all URLs of a host share one)."""
    return F.pmod(host_crc32(url), F.lit(n)).cast("int")


def domain_suffixes(host) -> Column:
    """All dot-suffixes of a host: a.b.c -> [a.b.c, b.c, c]; at most one per label."""
    labels = F.split(col_of(host), r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, n), "."))


def is_homepage(url) -> Column:
    """T9 homepage test: path exactly '/', judged with fragments not split off.

    ``http://h/?q=1`` and ``http://h/;p=1`` count; ``http://h``, ``http://h/#top``
    and ``http://h//`` do not.
    """
    return col_of(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([;?].*)?$")
