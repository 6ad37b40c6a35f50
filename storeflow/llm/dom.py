"""A small document tree of a web page, and features of its nodes.

The tree keeps elements that can hold a block of their own (block-level
ones, and inline ones with a class, id or role); plain inline elements
belong to the element around them.  Node numbers follow the page, so a
parent's number is below its children's.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head title script style noscript template".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt "
    "u var wbr img".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split())
# An element closes an open one of these, up to the nearest limit.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
LIMITS = frozenset("ul ol dl table select body html div article section main aside nav header footer form".split())

TAGS = ("html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li table tr td nav header footer aside form "
        "figure figcaption blockquote pre dl button").split()
# Words in class, id and role that speak for or against main text, by theme.
THEMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs",
    "head": "header masthead topbar banner logo",
    "foot": "footer foot copyright legal bottom",
    "side": "sidebar aside side rail widget related recommended more",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion",
    "note": "cookie cookies consent notice alert popup modal newsletter subscribe gdpr",
    "talk": "comment comments reply replies disqus discussion respond",
    "form": "form search login signup contact",
    "share": "share social tweet facebook follow tags tag meta byline",
    "main": "article content main post entry story text body prose",
}
WORD_THEME = {w: i for i, words in enumerate(THEMES.values()) for w in words.split()}
_WORD = re.compile(r"[a-z]+")
_END = re.compile(r"[.!?,;:]")


class Page(HTMLParser):
    """Tree of one page: ``tag, parent, words`` per node and the text in
    page order as ``segments`` of (block number, node, text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.words = ["#page"], [-1], [()]
        self.segments: list[tuple[int, int, str]] = []
        self.link_chars: dict[int, int] = {}
        self.open: list[tuple[str, int]] = [("#page", 0)]  # element, its node
        # Where elements of a name, and limits, stand among the open ones.
        self.at: dict[str, list[int]] = {}
        self.limits = [0]
        self.block = self.hidden = self.in_link = 0
        self.feed(html)
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""  # a comment that is not closed goes on to the end
        self.close()

    def _pop_to(self, k: int) -> None:
        for name, _ in self.open[k:]:
            self.at[name].pop()
            if name in LIMITS:
                self.limits.pop()
            self.hidden -= name in HIDDEN
            self.in_link -= name == "a"
            self.block += name not in INLINE
        del self.open[k:]

    def _close_open(self, names: tuple) -> None:
        k = max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)
        if k >= self.limits[-1]:
            self._pop_to(k)

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close_open(("p",))
        if tag in CLOSED_BY:
            self._close_open(CLOSED_BY[tag])
            if tag in ("tr", "tbody"):  # the row of the closed cell too
                self._close_open(CLOSED_BY[tag])
        marks = ()
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop"):
                marks += tuple(_WORD.findall(value.lower()))
        node = self.open[-1][1]
        if tag not in INLINE or marks:
            self.tag.append(tag)
            self.parent.append(node)
            self.words.append(marks)
            node = len(self.tag) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in LIMITS:
            self.limits.append(len(self.open))
        self.open.append((tag, node))
        self.hidden += tag in HIDDEN
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.at.get(tag):
            self._pop_to(self.at[tag][-1])

    def handle_data(self, data):
        if self.hidden:
            return
        node = self.open[-1][1]
        self.segments.append((self.block, node, data))
        if self.in_link:
            self.link_chars[node] = self.link_chars.get(node, 0) + len(data)

    def bare_share(self) -> float:
        """The share of the text that lies outside of all elements."""
        sizes = [(node, len(text.strip())) for _, node, text in self.segments]
        return sum(n for node, n in sizes if node == 0) / max(1, sum(n for _, n in sizes))

    def text(self, chosen) -> str:
        """Text of the chosen nodes: blocks in page order joined by one
        space, white space inside a block turned into one space."""
        blocks: dict[int, list[str]] = {}
        for block, node, text in self.segments:
            if chosen[node]:
                blocks.setdefault(block, []).append(text)
        shown = (" ".join("".join(parts).split()) for parts in blocks.values())
        return " ".join(b for b in shown if b)


def _log(x) -> float:
    return math.log1p(x)


FEATURES = (
    [f"tag={t}" for t in TAGS] + [f"theme={t}" for t in THEMES] + [f"above={t}" for t in THEMES]
    + ["parent", "depth", "place", "own", "text", "share", "nodes", "density", "links", "ends", "mean_run",
       "sibling", "siblings", "alike", "before", "after", "before_links", "after_links", "paragraphs"])


def node_features(page: Page) -> np.ndarray:
    """One row per node, columns ``FEATURES``."""
    n = len(page.tag)
    own, ends, runs = np.zeros(n), np.zeros(n), np.zeros(n)
    for _, node, text in page.segments:
        size = len(text.strip())
        if size:
            own[node] += size
            ends[node] += len(_END.findall(text))
            runs[node] += 1
    links = np.zeros(n)
    for node, k in page.link_chars.items():
        links[node] += k
    text, below, paragraphs = own.copy(), np.ones(n), np.zeros(n)
    children: list[list[int]] = [[] for _ in range(n)]
    place = [0] * n  # among the siblings
    depth, first = np.zeros(n), np.zeros(n)
    seen = 0.0
    for i in range(n):
        p = page.parent[i]
        if p >= 0:
            place[i] = len(children[p])
            children[p].append(i)
            depth[i] = depth[p] + 1
    for i in range(n):
        first[i] = seen
        seen += own[i]
    all_ends, all_runs = ends.copy(), runs.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        for a in (text, below, links, all_ends, all_runs):
            a[p] += a[i]
        paragraphs[p] += page.tag[i] == "p"
    total = max(1.0, text[0])
    rate = links / np.maximum(text, 1)
    out = np.zeros((n, len(FEATURES)))
    tag_at = {t: k for k, t in enumerate(TAGS)}
    base, above = len(TAGS), len(TAGS) + len(THEMES)
    rest = above + len(THEMES)
    for i in range(n):
        row, tag, p = out[i], page.tag[i], page.parent[i]
        if tag in tag_at:
            row[tag_at[tag]] = 1
        for w in page.words[i]:
            if w in WORD_THEME:
                row[base + WORD_THEME[w]] = 1
        if p >= 0:
            row[above:rest] = np.maximum(out[p, above:rest], out[p, base:above])
            same = children[p]
        else:
            same = [i]
        k = place[i]
        before = same[k - 1] if k else -1
        after = same[k + 1] if k + 1 < len(same) else -1
        row[rest:] = (
            tag_at.get(page.tag[p], -1) if p >= 0 else -1, depth[i], first[i] / total, _log(own[i]), _log(text[i]),
            text[i] / total, _log(below[i]), text[i] / below[i] / 100, rate[i], 100 * all_ends[i] / max(text[i], 1),
            _log(text[i] / max(all_runs[i], 1)), min(k, 20), min(len(same), 40), 0,
            _log(text[before]) if before >= 0 else -1, _log(text[after]) if after >= 0 else -1,
            rate[before] if before >= 0 else -1, rate[after] if after >= 0 else -1, _log(paragraphs[i]))
    alike = rest + FEATURES[rest:].index("alike")
    for group in children:
        if group:
            tags: dict[str, int] = {}
            for i in group:
                tags[page.tag[i]] = tags.get(page.tag[i], 0) + 1
            for i in group:
                out[i, alike] = tags[page.tag[i]] / len(group)
    return out
