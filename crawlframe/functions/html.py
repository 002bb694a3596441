"""HTML link patterns as Spark regular expressions.

Java matches a repeated group by recursion unless the repetition is possessive,
so every loop over a group here is: a page may hold any number of tags and
attributes. RE2 has no possessive loops; the oracles spell their own patterns
(``plans/sqlgen.py``). Patterns go through ``F.lit``, never through SQL text, so
backslashes are not escaped twice.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col_of

# Regions whose markup is not part of the document's links.
STRIP_RE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
_ATTR = r"""(?:\s++[^\s"'>=]++(?:\s*+=\s*+""" + _VALUE + r")?+)"
# Text of an anchor: anything up to the next <a ...> or </a>, other tags allowed.
_TEXT = r"""(?:[^<]++|<(?!/?a[\s>]))*+"""


def _until(attr: str) -> str:
    """Attributes before the first ``attr`` with a value, and that value (one group)."""
    other = r"""(?:\s++(?!""" + attr + r"""\s*+=)[^\s"'>=]++(?:\s*+=\s*+""" + _VALUE + r")?+)*+"
    return other + r"\s++" + attr + r"\s*+=\s*+(" + _VALUE + ")"


def tag_attr_re(tag: str, attr: str) -> str:
    """Start tag ``tag`` with attribute ``attr`` in any position and any quoting; group 1 is the raw value.

    The first attribute of that name wins. ``data-href`` and ``<abbr>`` do not
    match; a ``>`` inside a quoted value does not end the tag.
    """
    return r"(?i)<" + tag + _until(attr)


_END = _ATTR + r"*+\s*+/?>"
# Anchors with an end of the start tag.
LINK_RE = tag_attr_re("a", "href") + _END
# Links of both kinds in document order, an anchor with all up to its </a>, if there is one (group 1: an anchor's raw
# value, 2: its text, 3: an area's raw value). No anchor stands inside an anchor's text, but areas may.
LINK_SPAN_RE = (r"(?i)<(?:a" + _until("href") + _END + r"(?:(" + _TEXT + r")</a\s*+>)?+|area" + _until("href") + _END + ")")
AREA_RE = tag_attr_re("area", "href") + _END
BASE_RE = tag_attr_re("base", "href")


def embed_re(src_tags: list[str], href_tags: list[str]) -> str:
    """Embed tags in document order: groups 1, 2 are tag and raw value of a ``src`` tag, 3, 4 of an ``href`` tag."""
    return (r"(?i)<(?:(" + "|".join(src_tags) + ")" + _until("src") + "|(" + "|".join(href_tags) + ")" + _until("href") + ")")


# Named character references an HTML 4 parser decodes: the HTML 4.01 set, taken
# from the standard library rather than written out here, plus XML's &apos;.
NAMED_REFERENCES = {**{name: chr(cp) for name, cp in name2codepoint.items()}, "apos": "'"}
# One token per named or numeric reference, run of text, or lone '&': every
# token is decoded once, so '&amp;#39;' stays '&#39;'.
ENTITY_TOKEN_RE = r"&[A-Za-z][A-Za-z0-9]{1,31};|&#[0-9]+;|&#[xX][0-9a-fA-F]+;|[^&]+|&"
REPLACEMENT_CHAR = "\ufffd"

HTML_SPACE_RE = r"^[\t\n\f\r ]+|[\t\n\f\r ]+$"
TEXT_SPACE_RE = r"[\t\n\f\r ]+"


def strip_inert(html) -> Column:
    """Remove comments, scripts and styles before looking for links."""
    return F.regexp_replace(col_of(html), STRIP_RE, "")


def _code_point_char(cp: Column) -> Column:
    """The character of a code point; invalid ones (0, surrogates, > U+10FFFF) give U+FFFD."""
    ok = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")).otherwise(F.lit(REPLACEMENT_CHAR))


def unescape(c) -> Column:
    """Decode character references (named, decimal, hex) in one pass; unknown
    names stay as written."""
    names = F.create_map(*[F.lit(x) for kv in sorted(NAMED_REFERENCES.items()) for x in kv])

    def token(t):
        named = F.try_element_at(names, F.substr(t, F.lit(2), F.length(t) - 2))
        # digits without leading zeros; more than 8 are no code point
        dec = F.regexp_extract(t, "^&#0*([0-9]*);", 1)
        hx = F.regexp_extract(t, "^&#[xX]0*([0-9a-fA-F]*);", 1)
        known = lambda digits, value: _code_point_char(
            F.when(F.length(digits) <= 8, F.coalesce(value.try_cast("bigint"), F.lit(0))).otherwise(0))
        return (F.when(t.rlike("^&#[xX]"), known(hx, F.conv(F.substr(hx, F.lit(1), F.lit(8)), 16, 10)))
                .when(t.rlike("^&#[0-9]"), known(dec, dec))
                .when(t.rlike("^&[A-Za-z]"), F.coalesce(named, t))
                .otherwise(t))
    s = col_of(c)
    decoded = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(ENTITY_TOKEN_RE), F.lit(0)), token), "")
    return F.when(s.contains("&"), decoded).otherwise(s)


def unquote_attr(raw, strip: bool = True) -> Column:
    """Attribute value: drop surrounding quotes, decode entities; with ``strip``
    also drop leading/trailing HTML spaces (the link extractor does, a plain
    attribute selector does not)."""
    r = col_of(raw)
    quoted = r.startswith('"') | r.startswith("'")
    v = unescape(F.when(quoted, F.substr(r, F.lit(2), F.length(r) - 2)).otherwise(r))
    return F.regexp_replace(v, HTML_SPACE_RE, "") if strip else v


def anchor_text(raw) -> Column:
    """String value of an anchor: its text with tags dropped and entities
    decoded, whitespace kept as written (an XPath ``string()``)."""
    return unescape(F.regexp_replace(col_of(raw), r"<[^>]*>", ""))


def link_values(html, stripped: bool = False) -> Column:
    """Raw ``href`` values of all anchors of a page, in document order."""
    h = col_of(html) if stripped else strip_inert(html)
    return F.regexp_extract_all(h, F.lit(LINK_RE), F.lit(1))


def base_href(html, stripped: bool = False) -> Column:
    """``<base href>`` of a page, '' when absent."""
    h = col_of(html) if stripped else strip_inert(html)
    return unquote_attr(F.regexp_extract(h, BASE_RE, 1))
