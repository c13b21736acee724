"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks that isn't link text; each page votes for the generalised
tag-class paths (numbers, attributes and order of classes left out) of its best containers; votes are summed by host in
Spark, and every page is read again with its host's winning path. A page without an element on that path falls back to
its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
take part in neither step: elements with a tag or role of that kind, or with a class or id that is nothing but words of
that kind and of page furniture (`ad-slot`, `related-posts`; `share-price` and `promo-story` have other words and stay).
Paragraphs, headings, quotes and other blocks of text go by the plainest of these words alone. A page that has no text
left is read again by tags and roles only.

Null html is empty; a page without text gets an empty one. Of equal votes the path that sorts first wins. Repeated
pages vote and are read each on their own. A null or odd url has the host that is left of it, at last the empty one.
Memory is linear in the html, however long or deeply nested. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import arrow_map, broadcast_if_small, packed

#: Containers of a page that get a vote.
VOTES = 3
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)/?>|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
#: Blocks whose parent is the container that their text counts for.
_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th tr address".split())
_DROPPED_TAGS = frozenset("head nav footer aside form menu dialog button select option datalist fieldset label canvas audio video object map".split())
_DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer "
    "comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget pagination pager masthead toolbar skip search form".split()
)
#: Words that say nothing about a text, beside one of the dropped ones.
_FURNITURE = frozenset(
    "bar block blocks body bottom box btn button buttons card cards col column container content div feed footer group head header icon icons inner item items left link links list lists "
    "main module outer page panel popular post posts primary rail region right row section sections site slot small sticky tag text title tool tools top unit wide wrap wrapper zone js global desktop mobile".split()
)
#: Of the dropped words those that drop a block of text too, standing alone.
_PLAINEST = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored breadcrumb breadcrumbs comment comments cookie cookies consent newsletter subscribe pagination".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_GOOD_WORDS = frozenset("article content post entry story main body text".split())
_OUTER = frozenset("html body article main".split())


def _named_away(tag: str, names: list[str]) -> bool:
    """Whether one of an element's classes or ids says that it isn't article text."""
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if tag in _BLOCK:
            if len(words) == 1 and words[0] in _PLAINEST:
                return True
        elif not _DROPPED_WORDS.isdisjoint(words) and _DROPPED_WORDS.union(_FURNITURE).issuperset(words):
            return True
    return False


class Page:
    """The blocks of a page, each with its text, its characters outside links, and the element it stands in.

    An element's path is a number: that of its parent's path and its own tag and classes together.
    """

    def __init__(self, html: str):
        self._read(html, True)
        if not self.blocks:
            self._read(html, False)

    def _read(self, html: str, by_name: bool) -> None:
        self.paths: list[int] = []
        self.parents: list[int] = []
        self.homes: list[int] = []  # the container that an element's text counts for: in an article the article itself
        self.anchored: list[bool] = []  # in an article
        self.good: list[bool] = []
        self.blocks: list[tuple[str, int, int]] = []  # text, characters outside links, element
        self.known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, bool]] = []  # tag, element (the last one that isn't dropped), dropped
        opened: dict[str, int] = defaultdict(int)
        text: list[str] = []
        plain = link = 0

        def flush():
            nonlocal plain
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((joined, plain, stack[-1][1] if stack else -1))
                text.clear()
                plain = 0

        def say(piece: str):
            nonlocal plain
            if not stack or not stack[-1][2]:
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if not link:
                    plain += len(piece.strip())

        def close(k: int):
            for name, _, _ in stack[k:]:
                opened[name] -= 1
            del stack[k:]

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if tag is None:
                continue
            tag, closing, rest = tag.lower(), m[2] or m[5], m[4] if m[3] else m[7]
            if tag in _INLINE or tag in _VOID:
                if tag == "a":
                    link = 0 if closing else 1
                elif tag == "hr":
                    flush()
                elif tag in ("br", "img", "wbr") and text and tag != "wbr":
                    text.append(" ")
                continue
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in ("article", "main", "body") and tag in _BLOCK:
                        break
                link = 0
                continue
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
                close(len(stack) - 1)
            parent, dropped = (stack[-1][1], stack[-1][2]) if stack else (-1, False)
            if not dropped:
                words, dropped = self._words(tag, rest, by_name)
                dropped |= tag == "header" and not (opened["article"] or opened["main"])
                if not dropped:
                    parent = self._add(tag, words, parent)
            stack.append((tag, parent, dropped))
            opened[tag] += 1
        if at < len(html):
            say(html[at:])
        flush()

    def _add(self, tag: str, words: set[str], parent: int) -> int:
        e, name = len(self.paths), tag + "".join(f".{w}" for w in sorted(words))
        self.paths.append(self.known.setdefault((self.paths[parent] if parent >= 0 else -1, name), len(self.known)))
        self.parents.append(parent)
        above = self.homes[parent] if parent >= 0 else -1
        stays = tag in _BLOCK or parent >= 0 and self.anchored[parent] and tag != "article"
        self.homes.append(above if stays else e)
        self.anchored.append(tag == "article" or parent >= 0 and self.anchored[parent])
        self.good.append(tag in ("article", "main") or bool(words & _GOOD_WORDS))
        return e

    @staticmethod
    def _words(tag: str, rest: str, by_name: bool) -> tuple[set[str], bool]:
        """The element's generalised classes, and whether it is of no interest by its tag, role, classes or id."""
        dropped = tag in _DROPPED_TAGS
        classes: set[str] = set()
        if rest and "=" in rest or "hidden" in (rest or ""):
            for m in _ATTRIBUTE.finditer(rest):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    if name == "class":
                        classes.update(w for w in (re.sub(r"[^\w-]+|\d+", "", w) for w in value.split()) if w)
                    dropped |= by_name and tag not in _OUTER and _named_away(tag, value.split())
                elif name == "role":
                    dropped |= value in _DROPPED_ROLES
                elif name == "style":
                    dropped |= "display:none" in value.replace(" ", "")
                elif tag not in _OUTER:
                    dropped |= name == "hidden" and m[0] == rest.strip() or value == "true"
        return classes, dropped

    def _path(self, e: int) -> str:
        """The tag-class path of an element, from the outermost one."""
        if not hasattr(self, "names"):
            self.names = {number: (above, name) for (above, name), number in self.known.items()}
        parts, number = [], self.paths[e]
        while number >= 0:
            number, name = self.names[number]
            parts.append(name)
        return ">".join(reversed(parts))

    def _number(self, path: str) -> int:
        """The number of a path, -2 if the page has none such."""
        number = -1
        for name in path.split(">"):
            number = self.known.get((number, name), -2)
            if number == -2:
                break
        return number

    def containers(self) -> list[tuple[str, int]]:
        """(path, score) of the best containers: a block counts in full for its container and by halves further up."""
        scores: dict[int, float] = {}  # by path
        of: dict[int, int] = {}
        for _, plain, e in self.blocks:
            e, share = self.homes[e] if e >= 0 else -1, float(plain)
            while e >= 0 and share >= 1:
                number = self.paths[e]
                of.setdefault(number, e)
                scores[number] = scores.get(number, 0.0) + share * (1.5 if self.good[e] else 1.0)
                e, share = self.parents[e], share / 2
        edge = sorted(scores.values(), reverse=True)[:VOTES][-1:]
        ranked = sorted(((self._path(of[x]), s) for x, s in scores.items() if s >= edge[0]), key=lambda x: (-x[1], x[0]))[:VOTES] if edge else []
        return [(p, round(1000 * s / ranked[0][1])) for p, s in ranked if ranked[0][1] > 0]

    def text(self, path: str | None) -> str:
        """The blocks inside elements on the path, or inside those on the page's own best one."""
        number = self._number(path) if path is not None else -2
        if number < 0:
            own = self.containers()
            path, number = (own[0][0], self._number(own[0][0])) if own else (None, -2)
        wanted = set()
        for e, p in enumerate(self.paths):  # parents come first
            if p == number or self.parents[e] in wanted:
                wanted.add(e)
        return "\n\n".join(t for t, _, e in self.blocks if e in wanted or path is None)


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the url's host in lower case."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    named = F.when(url.rlike(_HOST), F.regexp_extract(url, _HOST, 1)).otherwise(F.split(F.trim(url), "/")[0])
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.lower(named).alias("host"))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): the votes of every page of with_host()."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            out = [(x, p, s) for x, h in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) for p, s in Page(h or "").containers()]
            if out:
                yield packed(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)

    return arrow_map(pages.select("host", "html"), run, "host string, path string, score long")


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): each host's path with the most votes. Votes are pre-aggregated, so a frequent host is no burden."""
    total = votes(pages).groupBy("host", "path").agg(F.sum("score").alias("score"))
    return total.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("w")).select("host", "w.path")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [Page(h or "").text(p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield packed({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    rows = with_host(pages)
    found = broadcast_if_small(winners(rows), 100_000)
    return arrow_map(rows.join(found, "host", "left").select("page_id", "url", "html", "path"), run, "page_id long, url string, text string, n_chars long")
