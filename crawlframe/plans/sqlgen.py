"""DuckDB expression builders for the oracle queries.

These mirror the Spark column helpers in ``crawlframe.functions`` as plain SQL
text, so every oracle is one self-contained SELECT over the driver's tables.
DuckDB lacks CRC-32 and base32, so both are spelled out with list lambdas.
"""

from __future__ import annotations

from ..functions import html as H
from ..functions import urls as U
from ..functions.digest import BASE32_ALPHABET


def q(s: str) -> str:
    """SQL string literal (DuckDB does not treat backslashes specially)."""
    return "'" + s.replace("'", "''") + "'"


def part(u: str, idx: int) -> str:
    return f"regexp_extract({u}, {q(U.URL_PARTS_RE)}, {idx})"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(U.HOST_RE)}, 1))"


def after_authority(u: str) -> str:
    return f"regexp_extract({u}, {q(U.AFTER_AUTHORITY_RE)}, 1)"


def crc32(s: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``s`` as BIGINT."""
    return (f"xor(list_reduce(list_transform(range(0, strlen({s})), "
            f"lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT), "
            f"lambda c, b: list_reduce(range(8), lambda c2, k: xor(c2 >> 1, CASE WHEN (c2 & 1) = 1 "
            f"THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT), 4294967295)")


def crc32_hex(s: str) -> str:
    return f"lpad(lower(hex({crc32(s)})), 8, '0')"


def url_fingerprint(u: str) -> str:
    return f"({crc32_hex(host(u))} || md5({after_authority(u)}))"


def host_fingerprint(u: str) -> str:
    h = host(u)
    return f"(CASE WHEN {h} <> '' THEN sha1({h}) END)"


def host_partition(u: str, n: int) -> str:
    return f"CAST({crc32(host(u))} % {n} AS INTEGER)"


def base32_sha1(s: str) -> str:
    """base32(SHA-1(s)); ``s`` is VARCHAR or BLOB."""
    h = f"sha1({s})"
    return (f"array_to_string(list_transform(range(0, 32), lambda i: substr({q(BASE32_ALPHABET)}, "
            f"CAST(((('0x' || substr({h}, CAST((i // 4) * 5 + 1 AS INTEGER), 5))::BIGINT >> "
            f"CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '')")


def remove_dot_segments(p: str) -> str:
    segs = f"string_split({p}, '/')"
    kept = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '.' THEN acc WHEN s = '..' THEN "
            f"(CASE WHEN len(acc) > 0 THEN acc[1:len(acc) - 1] ELSE acc END) "
            f"ELSE list_append(acc, s) END, []::VARCHAR[])")
    last = f"{segs}[-1]"
    joined = (f"(CASE WHEN len({segs}) > 1 AND {last} IN ('.', '..') "
              f"THEN array_to_string(list_append({kept}, ''), '/') ELSE array_to_string({kept}, '/') END)")
    return f"(CASE WHEN starts_with({p}, '/') AND NOT starts_with({joined}, '/') THEN '/' || {joined} ELSE {joined} END)"


def squeeze_inner_slashes(p: str) -> str:
    segs = f"string_split({p}, '/')"
    return (f"(CASE WHEN len({segs}) > 2 THEN array_to_string(list_concat(list_concat([{segs}[1]], "
            f"list_filter({segs}[2:len({segs}) - 1], lambda x: x <> '')), [{segs}[-1]]), '/') ELSE {p} END)")


def resolve(b: str, r: str) -> str:
    nz = lambda x, d: f"nullif({x}, '{d}')"  # noqa: E731 - empty '?' / '#' count as absent
    bs, ba, bp = f"lower({part(b, 1)})", part(b, 2), part(b, 3)
    bq = f"coalesce({nz(part(b, 4), '?')}, '')"
    raw_r = r
    r = f"regexp_replace(regexp_replace({r}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '')"
    rsl, rp = f"lower({part(r, 1)})", part(r, 3)
    rel = ", ".join(q(x) for x in U.RELATIVE_SCHEMES[1:])
    alone = f"({rsl} <> '' AND NOT ({rsl} = {bs} AND split_part({rsl}, ':', 1) IN ({rel})))"
    ra = f"coalesce({nz(part(r, 2), '//')}, '')"
    rq = f"coalesce({nz(part(r, 4), '?')}, '')"
    rf = f"coalesce({nz(part(r, 5), '#')}, '')"
    base_dir = f"regexp_extract({bp}, '^(.*/)', 1)"
    merged = f"(CASE WHEN {ba} <> '' AND {bp} = '' THEN '/' || {rp} ELSE {base_dir} || {rp} END)"
    path_rel = (f"(CASE WHEN {rp} = '' THEN {bp} WHEN starts_with({rp}, '/') THEN {remove_dot_segments(rp)} "
                f"ELSE {remove_dot_segments(squeeze_inner_slashes(merged))} END)")
    query_rel = f"(CASE WHEN {rp} = '' AND {rq} = '' THEN {bq} ELSE {rq} END)"
    return (f"(CASE WHEN {raw_r} = '' THEN {b} WHEN {alone} THEN {raw_r} "
            f"WHEN {ra} <> '' THEN {bs} || {ra} || {rp} || {rq} || {rf} "
            f"ELSE {bs} || {ba} || {path_rel} || {query_rel} || {rf} END)")


def _cp_char(cp: str) -> str:
    return (f"(CASE WHEN {cp} > 0 AND {cp} <= 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) "
            f"THEN chr(CAST({cp} AS INTEGER)) ELSE {q(H.REPLACEMENT_CHAR)} END)")


def unescape(s: str) -> str:
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(H.NAMED_REFERENCES.items())) + "}"
    named = f"coalesce(map_extract_value({names}, substr(t, 2, length(t) - 2)), t)"
    dec = "coalesce(TRY_CAST(substr(t, 3, length(t) - 3) AS BIGINT), 0)"
    hx = "coalesce(TRY_CAST('0x' || right('0000000000000000' || ltrim(substr(t, 4, length(t) - 4), '0'), 16) AS BIGINT), 0)"
    tok = (f"CASE WHEN regexp_matches(t, '^&#[xX]') THEN {_cp_char(hx)} "
           f"WHEN regexp_matches(t, '^&#[0-9]') THEN {_cp_char(dec)} "
           f"WHEN regexp_matches(t, '^&[A-Za-z]') THEN {named} ELSE t END")
    return (f"(CASE WHEN contains({s}, '&') THEN array_to_string(list_transform("
            f"regexp_extract_all({s}, {q(H.ENTITY_TOKEN_RE)}, 0), lambda t: {tok}), '') ELSE {s} END)")


def unquote_attr(raw: str, strip: bool = True) -> str:
    v = unescape(f"(CASE WHEN starts_with({raw}, '\"') OR starts_with({raw}, '''') "
                 f"THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END)")
    return f"regexp_replace({v}, {q(H.HTML_SPACE_RE)}, '', 'g')" if strip else v


def anchor_text(raw: str) -> str:
    return unescape(f"regexp_replace({raw}, '<[^>]*>', '', 'g')")


# The oracles' own tag patterns, for RE2 (no lookahead, no possessive loops).
_SQL_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_SQL_ATTR = r"""(?:\s+[^\s"'>=]+(?:\s*=\s*""" + _SQL_VALUE + r")?)"
_SQL_TEXT = r"""([^<]*(?:<(?:[^aA/]|/[^aA]|[aA][^\s>]|/[aA][^\s>])[^<]*)*)"""


def tag_re(tag: str, attr: str) -> str:
    return r"(?i)<" + tag + _SQL_ATTR + r"*?\s+" + attr + r"\s*=\s*(" + _SQL_VALUE + r")"


A_RE = tag_re("a", "href") + _SQL_ATTR + r"*\s*/?>(?:" + _SQL_TEXT + r"</a\s*>)?"
# An area, or an anchor with its text; areas inside anchor text do not occur in the tables.
ANY_RE = r"(?i)<area" + _SQL_ATTR + r"*\s*/?>|" + A_RE
AREA_RE = tag_re("area", "href")


def strip_inert(html: str) -> str:
    return f"regexp_replace({html}, {q(H.STRIP_RE)}, '', 'g')"


def base_href(html: str) -> str:
    return unquote_attr(f"regexp_extract({strip_inert(html)}, {q(tag_re('base', 'href'))}, 1)")


def is_homepage(u: str) -> str:
    return f"regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+/([;?].*)?$')"


def links_cte(pages: str = "pages", with_text: bool = False, strip_href: bool = False, areas: bool = False) -> str:
    """SQL for T1 (+ text): (page_id, url, base_url, pos, href[, link_text]); ``areas`` keeps area links in page order."""
    raw, inner = f"regexp_extract(m, {q(A_RE)}, 1)", f"regexp_extract(m, {q(A_RE)}, 2)"
    all_re = ANY_RE if areas else A_RE
    if areas:
        is_area = "regexp_matches(m, '(?i)^<area')"
        raw = f"(CASE WHEN {is_area} THEN regexp_extract(m, {q(AREA_RE)}, 1) ELSE {raw} END)"
        inner = f"(CASE WHEN {is_area} THEN '' ELSE {inner} END)"
    text = f", {anchor_text(inner)} AS link_text" if with_text else ""
    matches = f"regexp_extract_all({strip_inert('html')}, {q(all_re)}, 0)"
    if areas:
        matches = f"list_filter({matches}, lambda m: NOT regexp_matches(m, '(?i)^<area') OR regexp_matches(m, {q(AREA_RE)}))"
    return f"""
    SELECT page_id, url, base_url, CAST(pos AS INTEGER) AS pos,
           {unquote_attr(raw, strip_href)} AS href{text}
    FROM (
      SELECT page_id, url, base_url, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos
      FROM (
        SELECT page_id, url, {resolve('url', base_href('html'))} AS base_url, {matches} AS ms
        FROM {pages}
      )
    )"""


def json_string(s: str) -> str:
    """Python-style JSON string literal (ASCII escapes, surrogate pairs); 'null' for NULL."""
    u = "unicode(c)"
    esc = ("CASE c WHEN '\\' THEN '\\\\' WHEN '\"' THEN '\\\"' WHEN chr(10) THEN '\\n' "
           "WHEN chr(13) THEN '\\r' WHEN chr(9) THEN '\\t' WHEN chr(8) THEN '\\b' WHEN chr(12) THEN '\\f' "
           f"ELSE CASE WHEN {u} < 32 OR {u} >= 127 THEN (CASE WHEN {u} > 65535 THEN "
           f"printf('\\u%04x\\u%04x', 55296 + (({u} - 65536) >> 10), 56320 + (({u} - 65536) & 1023)) "
           f"ELSE printf('\\u%04x', {u}) END) ELSE c END END")
    return (f"(CASE WHEN {s} IS NULL THEN 'null' ELSE '\"' || "
            f"array_to_string(list_transform(string_split({s}, ''), lambda c: {esc}), '') || '\"' END)")


def json_number(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'null')"
