"""Main text of web pages: flat text blocks, judged by a decision tree over their own and their neighbours' size and links.

A page is cut at its block elements. Each block has nine numbers: words and link density (the share of its words inside links) of itself,
of the block before and of the block behind; whether it stands in an article; whether it stands in what elements, classes and roles name
as furniture (menus, footers, forms, adverts, comments); whether it is a heading. A tree learned from LABELLED, a small table of
pages with marked blocks, says which ones are main text.

A page is one row, and is worked on alone: no shuffle, no state. Results in special cases: a null or empty html, or one without main
text, gives an empty text; very long pages are read whole; an unclosed comment, script or style runs to the end of the page, an unclosed
paragraph to the next block; unknown character references stay as they are; an empty table gives none. Further columns of the table are
kept (or dropped, see ``extract``).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks as cut
from .text import fresh

#: A comment; an element whose content is no text; a tag (name, attributes); a declaration.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|svg|math|canvas|audio|video|head|textarea)(?=[\s/>])(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")

_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset("aside button dialog fieldset footer form label legend menu nav option select title".split())
#: Parts of class names, ids and roles.
_FURNITURE = frozenset(
    "ad ads adsense advert advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments contentinfo cookie cookies consent copyright disclaimer disqus "
    "feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion recommended related "
    "replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
_COMMENTS = frozenset("comment comments disqus replies reply".split())
_CONTENT = frozenset("article story entry main post".split())

FEATURES = ["words", "density", "words_before", "density_before", "words_behind", "density_behind", "in_article", "in_furniture", "heading"]


def _context(tag: str, attrs: str, parent: tuple[bool, bool, bool]) -> tuple[bool, bool, bool]:
    """(in an article, in furniture, in comments) inside an element."""
    article, furniture, comments = parent
    names = {p for m in _NAMES.finditer(attrs) for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())} if "=" in attrs else ()
    if comments or _COMMENTS.intersection(names):
        return article, True, True
    if _FURNITURE.intersection(names) or tag in _FURNITURE_TAGS or (tag == "header" and not article):
        return article, True, False
    if tag in ("article", "main"):  # what was left open before it ends here
        return True, False, False
    return article or bool(_CONTENT.intersection(names)), furniture, False


def text_blocks(page: str) -> list[tuple[str, tuple[int, int, int, int, int]]]:
    """The page's blocks of text, in order: (text, (words, words in links, in an article, in furniture, heading))."""
    found: list[tuple[str, tuple[int, int, int, int, int]]] = []
    stack: list[tuple[str, tuple[bool, bool, bool]]] = []
    pieces: list[str] = []
    linked: list[str] = []
    links, heading = 0, 0
    state = (False, False, False)

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                inside = len("".join(linked).split())
                words = text.count(" ") + 1
                found.append((text, (words, min(inside, words), state[0], state[1], heading > 0)))
            linked.clear()

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if tag == "a":
            links = 0 if m["end"] else 1
            linked.append(" ")
        elif tag[0] == "h" and tag[1:].isdigit():
            heading = 0 if m["end"] else 1
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and tag in _BLOCK:  # what is still open inside ends with it
                state = stack[depth][1]
                del stack[depth:]
                links = 0
        elif tag in _BLOCK or "=" in m["attrs"]:
            if tag == "p":
                links = 0
                if stack and stack[-1][0] == "p":
                    state = stack.pop()[1]
            if tag in _BLOCK:
                stack.append((tag, state))
                state = _context(tag, m["attrs"], state)
    add(page[at:])
    flush()
    return found


def features(found: list[tuple[str, tuple[int, int, int, int, int]]]) -> np.ndarray:
    """A row of FEATURES for each block; blocks before the first and behind the last have no words."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([x for _, x in found], float)
    words, density = own[:, 0], own[:, 1] / own[:, 0]
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    behind = lambda x: np.concatenate([x[1:], [0.0]])
    return np.column_stack([words, density, before(words), before(density), behind(words), behind(density), own[:, 2:]])


@dataclass
class Tree:
    """A binary tree in arrays: node i asks whether x[feature[i]] <= threshold[i] and goes to low[i] or high[i]; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of main blocks in each row's leaf."""
        at = np.zeros(len(x), int)
        while len(x) and (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            down = np.where(x[np.arange(len(x)), f] <= self.threshold[at], self.low[at], self.high[at])
            at = np.where(inner, down, at)
        return self.value[at]


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """A classification tree by Gini impurity; leaves hold ``least`` rows or more. Ties go to the first feature and the smallest threshold."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        me, share = len(nodes), float(y[rows].mean()) if len(rows) else 0.0
        nodes.append([-1, 0.0, 0, 0, share])
        best = (share * (1 - share) * len(rows) - 1e-9, None, None)
        if left and 0 < share < 1:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order))
                ok = (v[1:] > v[:-1]) & (n >= least) & (len(order) - n >= least)
                if ok.any():
                    a, b = ones[:-1], ones[-1] - ones[:-1]
                    cost = np.where(ok, a * (1 - a / n) + b * (1 - b / (len(order) - n)), np.inf)
                    k = int(np.argmin(cost))
                    if cost[k] < best[0]:
                        best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is not None:
            under = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2], nodes[me][3] = grow(rows[under], left - 1), grow(rows[~under], left - 1)
        return me

    grow(np.arange(len(y)), depth)
    f, t, low, high, value = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(t), np.array(low), np.array(high), np.array(value))


MARK = "¶"
_MENU = "<nav><ul><li><a href=/>@1</a></li><li><a href=/a>@1</a></li><li><a href=/b>@2</a></li></ul></nav>"
#: The labelled table: pages whose main blocks begin with MARK; @n stands for n words.
LABELLED = [
    f"<head><title>@7</title></head><body>{_MENU}<div class=ad>@9</div><article><h1>¶@6</h1><p>¶@40</p><p>¶@1</p><p>¶@1</p><p>¶@90</p><p>¶@2</p></article><footer>@9</footer>",
    f"<body>{_MENU}<div class=ad>@3</div><article><h1>¶@12</h1><p>¶@3</p></article><footer>@4 <a href=/>@2</a></footer>",
    f"<body>{_MENU}<article><h1>¶@1</h1><p><b>¶@9<br><p>¶@20</p><p>¶@1</p></article><footer>@12</footer>",
    f"<body>{_MENU}<main><h1>¶@5</h1><p>¶@60 <a href=x>@2</a> @9</p><h2>¶@3</h2><p>¶@33</p><ul><li>¶@4</li><li>¶@3</li></ul><aside>@20</aside><p>¶@5</p></main><footer><p>@15</p></footer>",
    "<body><header><a href=/>@2</a><p>@6</p></header><div id=content><h1>¶@7</h1><p>¶@55</p><p>¶@70</p><p>¶@48</p></div><div class=sidebar><h3>@2</h3><p>@14</p><a href=x>@4</a></div><div class=footer>@8</div>",
    "<body><div class=menu><a href=/>@1</a> <a href=a>@1</a> <a href=b>@1</a></div><div><h1>¶@8</h1><div>¶@80</div><div>¶@45</div><div>¶@120</div></div><div class=footer>@10</div>",
    "<body><div><a href=/>@1</a> | <a href=a>@2</a> | <a href=b>@1</a></div><h2>¶@6</h2><p>¶@50</p><p>¶@38</p><p>¶@61</p><div>@3 <a href=c>@5</a></div>",
    "<body><table><tr><td><a href=/>@2</a></td><td><a href=b>@1</a></td></tr></table><p>¶@35</p><p>¶@44</p><p>¶@29</p><div><a href=x>@6</a></div><div><a href=x>@7</a></div>",
    "<body><div class=cookie-notice><p>@25</p><button>@1</button></div><article><h1>¶@4</h1><p>¶@77</p><p>¶@8</p><div class=promo><p>@18</p></div><p>¶@52</p></article><section id=comments><h3>@2</h3><article><p>@30</p></article><article><p>@55</p></article></section>",
    "<body><article><header><h1>¶@9</h1></header><p>¶@66</p><blockquote>¶@12</blockquote><p>¶@4</p><div class=share><a href=f>@1</a></div><form><p>@11</p></form></article><div class=comments><p>@42</p><p>@3</p></div>",
    "<body><div class=post><h1>¶@6</h1><p>¶@2</p><p>¶@57</p><p>¶@6</p></div><div class=related><a href=x>@5</a><a href=y>@6</a></div><div id=comment-1><p>@48</p></div>",
    "<body><div class=banner>@16</div><div class=story><p>¶@31</p><p>¶@1</p><p>¶@26</p></div><aside class=newsletter><p>@22</p></aside><footer><ul><li><a href=x>@1</a></li><li><a href=y>@2</a></li></ul><p>@30</p></footer>",
    "<body><form><p>@40</p><p>@22</p></form><nav><p>@35</p></nav><div class=advert><p>@60</p></div>",
]


def labelled_blocks(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main) of pages marked as LABELLED is."""
    x, y = [], []
    for page in pages:
        found = text_blocks(re.sub(r"@(\d+)", lambda m: " ".join(["word"] * int(m[1])), page))
        x.append(features(found))
        y += [text.startswith(MARK) for text, _ in found]
    return np.concatenate(x), np.array(y, float)


def train(pages: list[str] = LABELLED) -> Tree:
    return fit_tree(*labelled_blocks(pages))


def main_text(page: str, tree: Tree) -> str:
    """The main blocks of a page, joined by an empty line."""
    found = text_blocks(page)
    return "\n\n".join(text for (text, _), p in zip(found, tree.predict(features(found)), strict=True) if p > 0.5)


def extract(pages: DataFrame, tree: Tree, column: str = "html", out: str = "text", keep_html: bool = False) -> DataFrame:
    """pages with the main text of ``column`` in ``out``; the html itself is dropped unless it is kept. A column that has the name
    ``out`` already gives way to a name with an underscore behind it."""
    out = fresh(pages, out)
    kept = [c for c in pages.columns if keep_html or c != column]
    asked = pages.select(*kept, F.col(column).alias(fresh(pages, "_html")))

    def run(batches):
        for batch in batches:
            for b in cut(batch, batch.num_columns - 1):
                texts = [main_text(x, tree) for x in pc.fill_null(b.column(b.num_columns - 1), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*kept, out])

    schema = pages.select(*kept).withColumn(out, F.lit("")).schema
    return asked.mapInArrow(run, schema)
