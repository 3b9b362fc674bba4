"""Main text of web pages: gradient-boosted trees over features of DOM nodes and one consistent choice per page.

Every block element is a node. Trees give its log-odds of holding main text from tag, attribute tokens, density of text, links and tags in its subtree,
depth, siblings and ancestors. The decoding keeps the set of nodes with the largest total in which the parent of each kept node is kept, so
no node speaks against its ancestors.

The trees are fitted on a bounded sample of pages: nodes below article or main against those below nav, aside, footer, form and the like, and
pages put together anew from the sample's own paragraphs, with other containers and with blocks of every unwanted sort.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import boosting

SAMPLE_PAGES = 300
"""Pages the trees are fitted on, chosen by a hash of the page."""
REBUILT = 3
"""Pages put together anew for each page of the sample."""
SLICE_PAGES = 500

# fixed values: element names by their part in HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_DROPPED = frozenset("head button select option optgroup datalist label fieldset legend output progress meter input textarea canvas svg math object audio video map dialog menu".split()) | _RAW
_IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_CLOSE_STOPS = frozenset("ul ol dl table body html div section article".split())
_TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "li", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "body"]
_AGAINST = ["ad ads advert adverts advertisement sponsor sponsored promo promotion banner", "nav navigation menu menus breadcrumb breadcrumbs pagination pager toc",
            "sidebar side aside widget rail", "comment comments reply replies discussion disqus respond feedback",
            "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup", "footer foot copyright legal colophon",
            "header masthead topbar top logo branding", "share sharing social follow like", "related recommended more popular trending", "form search login"]
_FOR = "article content contents post entry story main body text page prose copy"
_GROUP = {w: i for i, words in enumerate(_AGAINST) for w in words.split()}
_GOOD = frozenset(_FOR.split())

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+)?+|["'])*+)>|<[!?][^>]*+>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-keep)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END_OF_RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in _RAW}


class Page:
    """Block nodes of a page in page order, and its blocks of text with the node each belongs to."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes, self.keep = ["body"], [-1], [()], [None]
        self.links, self.tags, self.direct, self.points, self.texts = [0], [0], [0], [0], [[]]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements with the node each is in
        node, dropped, linked, heads, at, held = 0, 0, 0, 0, 0, []

        def close_block() -> None:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                self.blocks.append((node, text))
                self.direct[node] += len(text)
                self.points[node] += sum(map(text.count, ".,;!?"))

        def end_head() -> None:
            """The end tag of the head may be missing: what does not belong there ends it."""
            while heads:
                pop()

        def add(text: str) -> None:
            if heads and text and not text.isspace():
                end_head()
            if text and not dropped:
                held.append(text)
                if linked:
                    self.links[node] += len(text)

        def pop() -> None:
            nonlocal node, dropped, linked, heads
            name, inside = stack.pop()
            if name in _BLOCK:
                close_block()
                node = inside
            dropped -= name in _DROPPED
            linked -= name == "a"
            heads -= name == "head"

        size = len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            if not found:
                add(source[at:])
                break
            add(source[at:found.start()])
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                if any(n == name for n, _ in stack):
                    while stack and stack[-1][0] != name:
                        pop()
                    pop()
                elif name == "p":
                    close_block()
                continue
            if heads and name not in _IN_HEAD:
                end_head()
            if name == "br":
                add(" ")
            if name in _BLOCK:
                below = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCK), -1)
                if below >= 0 and stack[below][0] == "p":
                    while len(stack) > below:
                        pop()
                closes = _CLOSES.get(name, ())
                if closes:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in closes:
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][0] in _CLOSE_STOPS:
                            break
                close_block()
            if name in _VOID or (found[3] or "").endswith("/") and name not in _BLOCK and name not in _RAW:
                self.tags[node] += 1
                continue
            if name in _RAW:
                end = _END_OF_RAW[name].search(source, at)
                at = end.end() if end else size
                continue
            if name in ("html",) or (name == "body" and node == 0):
                continue
            self.tags[node] += 1
            stack.append((name, node))
            dropped += name in _DROPPED
            linked += name == "a"
            heads += name == "head"
            if name in _BLOCK:
                node = self._add(name, node, found[3] or "")
        close_block()
        while stack:
            pop()

    def _add(self, name: str, parent: int, attributes: str) -> int:
        words, keep = [], None
        if "=" in attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                if key.lower() == "data-keep":
                    keep = int((a or b or c) == "1")
                else:
                    words += [w.lower() for w in _ATTRIBUTE_WORD.findall(a or b or c)]
        self.tag.append(name)
        self.parent.append(parent)
        self.attributes.append(tuple(words))
        self.keep.append(keep)
        for column in (self.links, self.tags, self.direct, self.points):
            column.append(0)
        return len(self.tag) - 1

    def features(self) -> np.ndarray:
        """One row of numbers per node."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.array([self.direct, self.links, self.tags, self.points, [t == "p" for t in self.tag], [1] * n], float)
        total = own.copy()
        for i in range(n - 1, 0, -1):
            total[:, parent[i]] += total[:, i]
        depth, index, children = np.zeros(n), np.zeros(n), np.zeros(n)
        tag = np.zeros((n, len(_TAGS)))
        group = np.zeros((n, len(_AGAINST) + 1))
        place = {t: i for i, t in enumerate(_TAGS)}
        for i, (t, words) in enumerate(zip(self.tag, self.attributes, strict=True)):
            if t in place:
                tag[i, place[t]] = 1
            for w in words:
                if w in _GROUP:
                    group[i, _GROUP[w]] = 1
                elif w in _GOOD:
                    group[i, -1] = 1
            if i:
                depth[i] = depth[parent[i]] + 1
                index[i] = children[parent[i]]
                children[parent[i]] += 1
        named = np.array([t in ("nav", "header", "footer", "aside", "form") for t in self.tag], float)
        against, inside, good = np.maximum(group[:, :-1].max(1), named), np.zeros(n), np.zeros(n)
        holder = np.maximum(group[:, -1], np.array([t in ("article", "main") for t in self.tag]))
        for i in range(1, n):
            inside[i] = max(inside[parent[i]], against[parent[i]])
            good[i] = max(good[parent[i]], holder[parent[i]])
        above = np.maximum(parent, 0)
        text, whole = total[0], max(1.0, total[0, 0])
        numbers = np.stack([depth, index, children, children[above], index / np.maximum(1, children[above]), np.log1p(text), np.log1p(own[0]),
                            total[1] / np.maximum(1, text), total[2] / (1 + text) * 100, total[3] / (1 + text) * 100, np.log1p(total[4]), np.log1p(total[5]),
                            text / whole, text / np.maximum(1, text[above]), against, inside, good, holder], 1)
        return np.concatenate((numbers, tag, group, tag[above]), 1)

    def weak_labels(self) -> np.ndarray:
        """1: holds main text, 0: doesn't, -1: unknown; consistent from child to ancestor."""
        n = len(self.tag)
        label = np.full(n, -1)
        state = [None] * n
        for i in range(1, n):
            words = set(self.attributes[i])
            above = state[self.parent[i]]
            if self.keep[i] is not None:
                state[i] = self.keep[i]
            elif above == 0 or self.tag[i] in ("nav", "aside", "footer", "form") or any(w in _GROUP for w in words):
                state[i] = 0
            elif self.tag[i] in ("article", "main"):
                state[i] = 1
            else:
                state[i] = above
            if state[i] is not None:
                label[i] = state[i]
        for i in range(n - 1, 0, -1):
            if label[i] == 1:
                label[self.parent[i]] = 1
        return label

    def chosen(self, margin: np.ndarray) -> list[bool]:
        """The nodes kept: the best total of log-odds among sets that hold the parent of each member. The body is always in."""
        gain = margin.astype(float).copy()
        for i in range(len(gain) - 1, 0, -1):
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        kept = [True] * len(gain)
        for i in range(1, len(gain)):
            kept[i] = kept[self.parent[i]] and bool(gain[i] > 0)
        return kept

    def text(self, kept: list[bool]) -> str:
        return "\n".join(text for node, text in self.blocks if kept[node])


_CONTAINERS = ["<article{0}>", "<main{0}>", '<div class="content"{0}>', '<div class="post-body entry"{0}>', "<section{0}>", "<div{0}>", '<div id="story"{0}>',
               '<article class="post"{0}>', '<main role="main"><div{0}>']
_SORTS = ["<nav{0}>", '<div class="menu"{0}>', '<ul class="nav"{0}>', '<header class="site-header"{0}>', "<header{0}>", "<aside{0}>", '<div class="sidebar"{0}>',
          '<div class="ad"{0}>', '<div class="promo banner"{0}>', '<section class="comments"{0}>', '<div id="comments"{0}>', '<div class="cookie-notice"{0}>',
          '<div class="newsletter"{0}>', "<form{0}>", '<div class="share social"{0}>', '<div class="related"{0}>', "<footer{0}>", '<div class="footer"{0}>', '<div role="alert" class="notice"{0}>']


def rebuilt(paragraphs: list[str], others: list[str], rng: random.Random) -> str:
    """A page of ``paragraphs`` in some container among blocks of unwanted sorts with texts of ``others``; nodes say what they are."""
    def unwanted() -> str:
        start = rng.choice(_SORTS).format(' data-keep="0"')
        name = start[1:].split(" ")[0].split(">")[0]
        texts = [rng.choice(others) for _ in range(rng.randint(1, 4))]
        kind = rng.randint(0, 3)
        inner = "".join(f'<li><a href="/">{t[:40]}</a></li>' if kind == 0 else f"<p>{t}</p>" if kind == 1 else f'<div class="item"><p>{t}</p></div>' if kind == 2 else t
                        for t in texts)
        if kind == 0 and name not in ("ul", "nav"):
            inner = f"<ul>{inner}</ul>"
        return f"{start}{inner}</{name}>"

    start = rng.choice(_CONTAINERS).format(' data-keep="1"')
    names = re.findall(r"<([a-z]+)", start)
    parts = [f"<h1>{paragraphs[0][:80]}</h1>"] if paragraphs and rng.random() < 0.8 else []
    for i, p in enumerate(paragraphs):
        parts.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>"]).format(p))
        if i and rng.random() < 0.15:
            parts.append(unwanted())
    main = start + "".join(parts) + (unwanted() if rng.random() < 0.3 else "") + "".join(f"</{n}>" for n in reversed(names))
    around = [unwanted() for _ in range(rng.randint(2, 6))]
    at = rng.randint(0, len(around))
    body = "".join(around[:at]) + main + "".join(around[at:])
    return f'<html><body>{f"<div class=wrap>{body}</div>" if rng.random() < 0.5 else body}</body></html>'


def fit_pages(sources: list[str], seed: int = 3) -> boosting.Trees:
    """Trees fitted to the weakly labelled nodes of some pages and of pages rebuilt from their paragraphs."""
    rng = random.Random(seed)
    pages = [Page(s) for s in sources]
    texts = [[entities.escape(t) for _, t in p.blocks if len(t) > 30][:40] for p in pages]
    pool = [t for own in texts for t in own] or ["text"]
    for own in texts:
        for _ in range(REBUILT):
            pages.append(Page(rebuilt(own[: rng.randint(1, 40)] or ["text"], pool, rng)))
    rows, labels = [], []
    for page in pages:
        label = page.weak_labels()
        known = label >= 0
        rows.append(page.features()[known])
        labels.append(label[known])
    return boosting.fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def main_text(pages: DataFrame, trees: boosting.Trees, html_col: str = "html") -> DataFrame:
    """``pages`` with the main text as the column ``text`` (one of that name is replaced); blocks are joined by a line break.

    A null or empty page has an empty text, as has one without main text. Character references are decoded, white space within a block is one
    space. Every row gives one row.
    """
    model = pages.sparkSession.sparkContext.broadcast((trees.start, trees.features, trees.thresholds, trees.values))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = boosting.Trees(*model.value)
        for sources in batches:
            out: list[str] = []
            for start in range(0, len(sources), SLICE_PAGES):
                parsed = [Page(s or "") for s in sources.iloc[start:start + SLICE_PAGES]]
                rows = [p.features() for p in parsed]
                margins = held.margin(np.concatenate(rows))
                cuts = np.cumsum([0] + [len(r) for r in rows])
                out += [p.text(p.chosen(margins[a:b])) for p, a, b in zip(parsed, cuts[:-1], cuts[1:], strict=True)]
            yield pd.Series(out, dtype=object)

    return pages.withColumn("text", run(F.col(html_col).cast("string")))


def sample(pages: DataFrame, html_col: str = "html") -> list[str]:
    """The bounded sample of pages for :func:`fit_pages`: a share by hash that is expected to hold twice as many, then the first of these.

    The share is of different pages, so it does not depend on how often pages are repeated. Only about that many pages leave the tasks,
    however many tasks there are.
    """
    key = F.xxhash64("html")
    held = pages.select(F.col(html_col).alias("html")).filter("html IS NOT NULL")
    share = min(1.0, 2 * SAMPLE_PAGES / max(1, held.select(key).distinct().count()))
    few = held.filter(F.pmod(key, F.lit(1 << 40)) <= int(share * (1 << 40))).distinct().orderBy(key, "html").limit(SAMPLE_PAGES)
    return [r.html for r in few.collect()]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """:func:`main_text` with trees fitted on a sample of the same pages. An empty table stays empty."""
    sources = sample(pages, html_col)
    return main_text(pages, fit_pages(sources or ["<p>text</p>"]), html_col)
