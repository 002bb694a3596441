"""HTML extraction (8) by consensus host paths.

1. Every page is parsed once into containers and text blocks, and its
   containers are scored: text outside links, full value for the nearest
   container, half and a quarter for the next two, doubled for containers that
   declare the main content. From the best container the page goes up to the
   article it is part of, or to what else declares the main content; where
   nothing does, to the smallest container with most of the page's text. It
   votes for the generalised tag-class path of that.
2. Votes are counted per host in Spark; paths with at least ``share`` of a
   host's votes win (so a host has at most 1 / share of them).
3. Every page is extracted again with the winning path of its host that has the
   most votes among those that occur in the page; the page's own best container
   serves where none does.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out wherever they stand, inline ones too; of a header
inside the content, headings stay. An element is one of them by its tag or role,
or if a class or its id is the name of one, alone or with words that say nothing
(``ad-box``, ``site-footer``); a name with any other word in it (``alert-levels``)
is not. Nothing else is dropped.

Defined results: null, empty or unparsable html, and pages without text outside
those parts, give the empty text; a page that ends inside a tag or reference
keeps what came before and the reference as written; a null or hostless url is
a host of its own kind (''); repeated rows give equal results. Other columns
pass through.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.components import _written
from crawlframe.llm.text import bound_batches, plain

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|svg|iframe|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?][^>]*+>"
    r"|</?[a-z][^>]*+\Z", re.S | re.I)
_ATTR = re.compile(r"(class|id|role|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
                   "thead tr ul".split())
_CONTAINER = frozenset("article blockquote body center div main section td".split())
_LEFT_OUT = frozenset("aside button dialog fieldset footer form head input menu nav optgroup option search select".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_PARAGRAPH = _BLOCK - {"body", "html"}
# names of what is left out, by kind: menus, headers, footers, sidebars, notices, adverts, forms, comments
_NAMES = frozenset(
    "menu menus submenu nav navs navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer colophon sidebar sidebars "
    "cookie cookies consent gdpr notice notices alert alerts disclaimer ad ads adsense advert adverts advertisement advertisements "
    "advertising adslot sponsor sponsored banner banners form forms searchform loginform comment comments commentlist respond disqus".split())
# words that may stand beside such a name and change nothing
_NEUTRAL = frozenset(
    "a an the all area bar block bottom box center column container div footer global group header holder inner item items left list main "
    "mobile my new of outer page panel primary right row secondary section site slot sticky sub the title top unit wrap wrapper zone "
    "small large big first last js id class c l r x".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_CONTENT = frozenset("article articlebody content post entry story main text body".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


MOST = 2 / 3


class Page:
    """Containers and text blocks of one page, in page order."""

    def __init__(self, source: str):
        # per element: parent, tag, generalised path, left out, declares content
        self.parent, self.tag, self.path, self.out, self.content = [-1], [""], [""], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._parse(source)

    def _open(self, parent: int, tag: str, attrs: str) -> int:
        out = self.out[parent] or tag in _LEFT_OUT
        content = tag in ("article", "main")
        name = ""
        if attrs:
            found = {}
            for m in _ATTR.finditer(attrs):
                key = m[1].lower()
                before = attrs[: m.start()]
                if before and before[-1] not in " \t\r\n\f\"'/":  # the tail of another name, such as data-id
                    continue
                found.setdefault(key, m[2] or m[3] or m[4] or "")
            classes = found.get("class", "").split()
            name = "".join("." + re.sub(r"\d+", "0", c) for c in sorted(classes)) or ("#" + re.sub(r"\d+", "0", found["id"]) if found.get("id") else "")
            named = [[w.lower() for w in _WORD.findall(n) if not w.isdigit()] for n in (*classes, found.get("id", ""))]
            words = {w for n in named for w in n}
            if tag not in ("html", "body", "article", "main"):
                out = out or found.get("role", "").lower() in _ROLES
                # a header's or list's own name says no more than its tag
                out = out or any(set(n) & _NAMES and set(n) <= _NAMES | _NEUTRAL for n in named if tag not in _HEADING)
            content = content or bool(words & _CONTENT) or found.get("role", "").lower() == "main" or found.get("itemprop") == "articleBody"
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(f"{self.path[parent]}/{tag}{name}" if tag in _BLOCK else self.path[parent])
        self.out.append(out)
        self.content.append(content)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack, links, at = [0], 0, 0
        pieces: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(references.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
                pieces.clear()
            linked = 0

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                if self.tag[stack[-1]] in _BLOCK:
                    flush()
                links -= self.tag[stack[-1]] == "a"
                stack.pop()

        for m in _TAG.finditer(source):
            if m.start() > at:
                piece = source[at:m.start()]
                if not self.out[stack[-1]]:  # also of an inline element
                    pieces.append(piece)
                    if links:
                        linked += len(piece)
            at = m.end()
            tag = m["name"] or m["name2"]
            if not tag:
                continue
            tag = tag.lower()
            if m["close"] or m["close2"]:
                if tag == "p" and not any(self.tag[e] == "p" for e in stack):
                    flush()
                for depth in range(len(stack) - 1, 0, -1):
                    own = self.tag[stack[depth]]
                    if own == tag:
                        close(depth)
                        break
                    if own in _CONTAINER and tag not in _BLOCK:  # a stray inline end does not close a container
                        break
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in _BLOCK:
                flush()
                if tag in _ENDS_PARAGRAPH:
                    ends = {"p"} | ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else _HEADING if tag in _HEADING else set())
                    for depth in range(len(stack) - 1, 0, -1):
                        own = self.tag[stack[depth]]
                        if own in ends:
                            close(depth)
                            break
                        if own in _CONTAINER or own in ("ul", "ol", "dl", "table"):
                            break
            attrs = m["attrs"] or m["attrs2"]
            element = self._open(stack[-1], tag, attrs)
            links += tag == "a"
            stack.append(element)
            if attrs and attrs.endswith("/") and tag not in _BLOCK and tag != "a":
                stack.pop()
        if at < len(source) and not self.out[stack[-1]]:
            pieces.append(source[at:])
        flush()

    def shown(self, element: int) -> bool:
        """Whether text directly in the element is content: left-out parts are not; in headers only headings are."""
        if self.out[element]:
            return False
        heading = False
        while element:
            heading = heading or self.tag[element] in _HEADING
            if self.tag[element] == "header" and not heading:
                return False
            element = self.parent[element]
        return True

    def best_path(self) -> str:
        """Path of the container with the main content ('' if the page has none); the outermost of equals."""
        score: dict[int, float] = {}
        held: dict[int, float] = {}  # text value under each container
        whole = 0.0
        for element, text, linked in self.blocks:
            if not self.shown(element):
                continue
            value = max(0.0, len(text) - linked) * max(0.0, 1 - linked / len(text))
            whole += value
            share, e = 1.0, element
            while e:
                if self.tag[e] in _CONTAINER:
                    held[e] = held.get(e, 0.0) + value
                    if share > 0.2:
                        score[e] = score.get(e, 0.0) + value * share
                        share /= 2
                e = self.parent[e]
        best = max(score, key=lambda e: (score[e] * (2 if self.content[e] else 1), -e), default=0)
        above = [e for e in self._upward(best) if self.tag[e] in _CONTAINER]
        part_of = [e for e in above if self.tag[e] == "article"] or [e for e in above if self.content[e]]
        part_of = part_of or [e for e in above if held.get(e, 0.0) >= MOST * whole]
        return self.path[part_of[0] if part_of else best]

    def _upward(self, element: int) -> Iterator[int]:
        while element:
            yield element
            element = self.parent[element]

    def text_under(self, path: str) -> str | None:
        """Shown blocks of all containers with this path (None if there is no such container)."""
        inside = [False] * len(self.path)
        for e in range(1, len(self.path)):
            inside[e] = inside[self.parent[e]] or (self.path[e] == path and self.tag[e] in _CONTAINER)
        if path and not any(inside):
            return None
        return "\n\n".join(t for e, t, _ in self.blocks if (inside[e] or not path) and self.shown(e))


@F.arrow_udf(T.StringType())
def _vote(pages: pa.Array) -> pa.Array:
    return pa.array([Page(x).best_path() for x in plain(pages).to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array, winners: pa.Array) -> pa.Array:
    out = []
    for source, paths in zip(plain(pages).to_pylist(), winners.to_pylist()):
        page = Page(source)
        text = None
        for path in paths or []:
            text = page.text_under(path)
            if text:
                break
        out.append(text or page.text_under(page.best_path()) or "")
    return pa.array(out, pa.string())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.1) -> DataFrame:
    """(host, paths): each host's winning paths, most votes first (ties: by path), as a written table."""
    # non-deterministic: else the filter on the path would parse every page again
    votes = (pages.select(host_of(F.col(url_col)).alias("host"), _vote.asNondeterministic()(html_col).alias("path")).where("path != ''")
             .groupBy("host", "path").count())
    total = votes.groupBy("host").agg(F.sum("count").alias("total"))
    won = votes.join(total, "host").where(F.col("count") >= F.col("total") * share)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "path")))
    return _written(won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths")), "extract-paths")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.1) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points), in place of columns of these names."""
    bound_batches(pages.sparkSession)
    winners = host_paths(pages, url_col, html_col, share)
    # the input's columns stay inside a struct, so none can clash with a helper
    rows = pages.select(F.struct("*").alias("page"), host_of(F.col(url_col)).alias("host")).join(winners, "host", "left")
    found = rows.select("page", _extract(F.col("page")[html_col], F.col("paths")).alias("text"))
    kept = [F.col("page")[c].alias(c) for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return found.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))
