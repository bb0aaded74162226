"""Main text of web pages by composite text density.

A page becomes a tree; what its tags mark as menu, header, footer, sidebar or code, and what is hidden, is set aside.
Forms, roles and the names of classes and ids (menu, notice, advert, comment ...) are evidence: they are weighed by the text that
is not in links, and a node with most of the page's, or with its article, stays. If nothing else is left, all of them stay.
For every other node the composite text density is the number of
characters per tag, adjusted for links: with C characters, T tags, LC characters and LT tags in links,
and the body's C_b and LC_b,

    C / T * log(base, C / LC * T / LT),  base = ln(C / (C - LC) * LC + LC_b / C_b * C + e)

(zeros count as one). The sum of its children's densities is a node's score, and the subtree with the
largest score is the core of the article (the first of equals). The least density on the path from the body to the core is the threshold.

Around the core, at every level up to the body, the path's siblings are looked at one by one; those that are mainly links never belong. A sibling belongs whose own
density, or sum of densities, reaches the threshold; so do headings, parts of the same kind (a second article or section, or one with the same tag and attributes), what lies between two parts that
belong, and below the body paragraphs, lists and the like. Where a parent holds nothing that was set aside, all it has belongs, its own text too. Names of tags set nothing but
menus and the like aside; which subtree is the article, densities alone decide.

Defined results: a null or empty html, and a page without text, give an empty text of 0 characters; a text without tags
is its own main text; unclosed, crossed and unknown tags are read as browsers read them, as far as blocks go; equal rows
give equal rows; null ids and urls stay null; an empty table gives an empty result. Input columns other than the
named ones are ignored. Pages are read whole, row by row, without a shuffle, in time linear in their length, however deep their
tags are nested.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening tag ends open elements of these names, up to one of the second kind.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
ASIDE_TAGS = frozenset("nav footer aside button select dialog menu svg canvas audio video object map datalist".split())
ASIDE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended comment comments respond disqus breadcrumb breadcrumbs pagination pager widget login search skip copyright".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What a header may belong to; then it holds a title.
_TITLED = frozenset("article post entry story content page section title".split())
_TITLE = re.compile(rf"(?<![a-z])(?:{'|'.join(sorted(_TITLED))})[-_]+header(?![a-z])", re.I)
_KEPT_WHOLE = frozenset("html body main article".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = frozenset("p blockquote pre ul ol dl table figure".split())
_PARTS = frozenset("article main section".split())
_NAME = re.compile(r"[A-Za-z]+")


class _Page:
    """A tree in arrays; node 0 is the body."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.away, self.link = ["body"], [-1], [False], [False]
        self.title = [False]
        self.kind = ["body"]  # tag and attributes
        self.inner = [False]  # an article or main, or inside one
        self.named = [False]  # by form, role or name, to be weighed
        self.runs: list[tuple[int, str | None]] = []  # (node, text) in page order; None ends a block
        self._read(source)
        self._weigh()

    def _open(self, tag: str, attributes: str, up: int) -> int:
        self.tag.append(tag)
        self.parent.append(up)
        self.kind.append(f"{tag} {attributes.strip()}")
        self.away.append(self.away[up] or self._is_aside(tag, attributes, up))
        self.link.append(self.link[up] or tag == "a")
        self.inner.append(self.inner[up] or tag in ("article", "main"))
        self.named.append(self._is_named(tag, attributes))
        self.title.append("eader" in attributes and _TITLE.search(attributes) is not None)
        return len(self.tag) - 1

    def _is_aside(self, tag: str, attributes: str, up: int) -> bool:
        if tag in ASIDE_TAGS:
            return True
        if tag == "header" and not self.inner[up]:
            return True  # an article's own header holds its title
        if not attributes.strip():
            return False
        own = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        if tag == "body" or tag == "html":
            return False
        if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
            return True
        return False

    @staticmethod
    def _is_named(tag: str, attributes: str) -> bool:
        if tag in ("form", "fieldset"):
            return True
        if not attributes.strip():
            return False
        own = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        if own.get("role", "").lower() in ASIDE_ROLES:
            return True
        for name in f"{own.get('class', '')} {own.get('id', '')}".lower().split():
            parts = _NAME.findall(name)
            if not parts or {"has", "with", "no", "without"}.intersection(parts):
                continue
            if parts[-1] == "header" and parts[0] in _TITLED:
                continue
            found = ASIDE_NAMES.intersection((parts[0], parts[-1]))  # inside a compound they say little
            if tag in _KEPT_WHOLE or tag == "header":
                found &= {"comment", "comments"}
            if found:
                return True
        return False

    def _weigh(self) -> None:
        """Set aside the named nodes, but for those that hold most of the text, or the article."""
        if not any(self.named):
            return
        n = len(self.tag)
        plain, inside = [0] * n, self.named[:]
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parent[i]]
        free = 0
        for node, text in self.runs:
            if text and not self.away[node] and not self.link[node]:
                size = sum(map(len, text.split()))
                plain[node] += size
                free += size * (not inside[node])
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
        articles = [i for i in range(n) if self.tag[i] in ("article", "main") and not self.named[i] and not self.away[i] and plain[i]]
        best = max(articles, key=lambda i: (plain[i], -i), default=0)
        above = set()  # the article's ancestors
        up = self.parent[best]
        while up >= 0:
            above.add(up)
            up = self.parent[up]

        def stays(i: int) -> bool:
            if i in above and plain[best] > free:
                return True
            return 2 * plain[i] > plain[0] and (not best or i in above or inside[best])

        away = self.away[:]
        for i in range(1, n):
            away[i] = away[i] or away[self.parent[i]] or (self.named[i] and not stays(i))
        if any(text and not away[node] and text.strip() for node, text in self.runs):
            self.away = away

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        places: dict[str, list[int]] = {}  # of each tag's open elements in the stack, and of all blocks: no step walks the stack
        blocks: list[int] = []

        def last(*tags: str) -> int:
            return max((p[-1] for t in tags if (p := places.get(t))), default=0)

        def push(node: int) -> None:
            places.setdefault(self.tag[node], []).append(len(stack))
            if self.tag[node] in BLOCK:
                blocks.append(len(stack))
            stack.append(node)

        def cut(k: int) -> None:
            for node in stack[k:]:
                places[self.tag[node]].pop()
            while blocks and blocks[-1] >= k:
                blocks.pop()
            del stack[k:]

        while at < n:
            m = _TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at:
                self.runs.append((stack[-1], html.unescape(source[at:end])))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.runs.append((stack[-1], m[0][9:].removesuffix("]]>")))
                continue
            tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag in ("html", "body", "head"):
                continue
            if closing:
                if tag in BLOCK:
                    self.runs.append((stack[-1], None))
                k = last(tag)
                if k and (tag in BLOCK or not blocks or blocks[-1] <= k):
                    cut(k)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = source.find(">", close.end()) + 1 or n if close else n
                continue
            if tag in BLOCK:
                self.runs.append((stack[-1], None))
                k = last("p")
                if k and last("table", "button") < k:
                    cut(k)
            if tag in ENDS:
                names, stops = ENDS[tag]
                while (k := last(*names)) > last(*stops):
                    cut(k)
                    if tag not in ("tr", "tbody"):
                        break
            if tag in VOID:
                if tag == "br":
                    self.runs.append((stack[-1], " "))
                else:
                    self._open(tag, attributes, stack[-1])
                continue
            node = self._open(tag, attributes, stack[-1])
            if not attributes.rstrip().endswith("/") or tag in BLOCK or tag == "a":
                push(node)

    def _around(self, path: list[int], threshold: float, chars: list[int], link_chars: list[int], ctd: list[float], score: list[float], own: list[int]) -> tuple[set[int], set[int]]:
        """(subtrees of the article, nodes whose own text belongs to it): the core and what belongs to it around its path to the body."""
        on_path, kids, holds = set(path), {i: [] for i in path}, set()
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            if up in on_path:
                if self.away[i]:
                    holds.add(up)
                elif chars[i] and i not in on_path:
                    kids[up].append(i)
        core = below = path[0]
        kept, spoken = {core}, set()
        for up in path[1:]:
            page = up == 0 or up in holds  # it also has, or may have, what is no article
            prose = [i for i in kids[up] if 2 * link_chars[i] <= chars[i]]
            strong = {
                i
                for i in prose
                if not page
                or max(ctd[i], score[i]) >= threshold
                or self.kind[i] == self.kind[below]
                or (self.tag[i] in _PARTS and self.tag[i] == self.tag[below])
                or (self.tag[i] in _PROSE and (up > 0 or self.tag[core] in _PROSE))
            }
            first, last = min(strong | {below}), max(strong | {below})
            kept |= strong
            kept.update(i for i in prose if first < i < last or self.tag[i] in _HEADS or self.title[i])
            if own[up] and (not page or own[up] >= threshold):
                spoken.add(up)
                kept.update(i for i in kids[up] if self.tag[i] not in BLOCK)
            below = up
        return kept, spoken

    def main_text(self) -> str:
        n = len(self.tag)
        chars, tags, link_chars, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.runs:
            if text and not self.away[node]:
                size = sum(map(len, text.split()))
                chars[node] += size
                own[node] += size
                if self.link[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):  # children come after their parents
            if self.away[i]:
                continue
            up = self.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        if not chars[0]:
            return ""
        share = link_chars[0] / chars[0]

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            return c / max(t, 1) * max(0.0, math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(math.log(base), 1e-9) if base > 1.0001 else math.log(max(c / max(lc, 1), 1.0)) + 1)

        ctd = [0.0 if self.away[i] else density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)]
        score = [0.0] * n
        for i in range(1, n):
            score[self.parent[i]] += ctd[i]
        core = max(range(n), key=lambda i: (score[i], -i)) if n > 1 and max(score) > 0 else 0
        path = [core]
        while path[-1] > 0:
            path.append(self.parent[path[-1]])
        threshold = min(ctd[i] for i in path)
        kept, spoken = self._around(path, threshold, chars, link_chars, ctd, score, own)
        inside = [False] * n
        for i in range(n):
            inside[i] = not self.away[i] and (i in kept or (i > 0 and inside[self.parent[i]]))
        blocks, block = [], []
        for node, text in [*self.runs, (0, None)]:
            if text is None:
                if joined := " ".join("".join(block).split()):
                    blocks.append(joined)
                block = []
            elif inside[node] or node in spoken:
                block.append(text)
        return "\n\n".join(blocks)


def main_text(source: str | None) -> str:
    """The main text of one page."""
    return _Page(source).main_text() if source else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``, one row per row of ``pages``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": [main_text(h) for h in rows["html"]]})

    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInPandas(run, f"page_id {kind}, url string, text string")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
