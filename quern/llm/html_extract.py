"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with two labels, article or not. A node's potential is a linear function
of its tag, the words of its class, id and role, its text, links and share of the page; an edge's
potential is a table over the labels of parent and child, by the kind of edge. The tree has no cycles,
so one sum-product pass up and one down give exact marginals; text is kept where its block's marginal
says article. The potentials are trained on labelled pages by the exact gradient of their likelihood,
worked out by the same two passes.

Labelled pages are drawn by ``labelled_pages``: layouts with and without semantic tags, with menus,
headers, footers, sidebars, notices, adverts, forms and comments around and inside the article, and with
the markup errors that real pages have. Other labelled pages can be given to ``TreeModel.fit``.

All pages of a batch are one forest, passed level by level with numpy. Inline elements belong to their
block. Scripts, styles, the head and form controls never count; all other text is the model's to judge.
Character references are
decoded, white space inside a block becomes one space, and blocks are joined in page order by one space.

Defined cases: a null or empty page gives an empty text; so does a page without article. Other columns
pass through.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import pieces, with_columns
from quern.llm.html_tree import Page, parse

# Tags and words of class, id and role that say what a block is for.
_TAGS = [("article",), ("main",), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog"), ("p", "blockquote", "pre"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl"), ("div",), ("section",), ("table", "tbody", "tr", "td", "th"), ("figure", "figcaption"), ("body", "html", "#page"), ("noscript",)]
_WORDS = [
    "article post entry content story main body text hentry articlebody prose",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header masthead topbar top banner logo branding",
    "footer bottom copyright colophon legal",
    "sidebar side rail widget aside complementary secondary",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense dfp",
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall banner",
    "comment comments reply replies disqus respond discussion",
    "share social related recommended more newsletter subscribe signup login search form tags",
]
#: Words that say nothing beside those; any other word says that the block is about something of its own.
_PLAIN_WORDS = frozenset("list body slot box bar block wrap wrapper container inner outer item items area unit site page section row col column left right link links title text top bottom id x new main component module group panel".split())
_WORD_OF = {w: k for k, words in enumerate(_WORDS) for w in words.split()}
_TAG_OF = {t: k for k, tags in enumerate(_TAGS) for t in tags}
_SPLIT = re.compile(r"[^a-z0-9]+")
_STRUCTURE = frozenset("div section article main nav header footer aside form fieldset table ul ol dl figure details dialog menu".split())
N_FEATURES = len(_TAGS) + len(_WORDS) + 10


class Forest:
    """Pages as arrays: parents, levels, features and kinds of edges."""

    def __init__(self, pages: list[Page]):
        parents, depths, kinds, rows = [], [], [], []
        self.starts = []
        for page in pages:
            start = len(parents)
            self.starts.append(start)
            blocks = page.blocks
            total, linked = [b.chars for b in blocks], [b.linked for b in blocks]
            for k in range(len(blocks) - 1, 0, -1):
                total[blocks[k].parent] += total[k]
                linked[blocks[k].parent] += linked[k]
            whole = max(1, total[0])
            for k, b in enumerate(blocks):
                x = [0.0] * N_FEATURES
                if (t := _TAG_OF.get(b.tag)) is not None:
                    x[t] = 1.0
                at = len(_TAGS)
                own = False
                for w in _SPLIT.split(b.names) if b.names else ():
                    if (c := _WORD_OF.get(w)) is not None:
                        x[at + c] = 1.0
                    elif w and not w.isdigit() and w not in _PLAIN_WORDS:
                        own = True
                at += len(_WORDS)
                x[at + 9] = float(own)
                density = min(1.0, linked[k] / total[k]) if total[k] else 0.0
                x[at : at + 9] = [1.0, min(1.0, b.chars / 200), float(0 < b.chars < 25), density, float(density > 0.6), total[k] / whole, float(total[k] > 0.6 * whole), float(k > 0 and blocks[b.parent].tag in ("body", "html", "#page")), float(total[k] == 0)]
                rows.append(x)
                parents.append(start + b.parent if k else -1)
                depths.append(b.depth)
                kinds.append(0 if k == 0 or blocks[b.parent].tag in ("body", "html", "#page") else 1 if b.tag in _STRUCTURE else 2)
        self.parent, self.kind = np.array(parents, np.int64), np.array(kinds, np.int64)
        self.x = np.array(rows, np.float64).reshape(-1, N_FEATURES)
        depth = np.array(depths, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))[1:] if len(depth) else []


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


class TreeModel:
    """Potentials of nodes (weights) and edges (tables of parent's by child's label)."""

    def __init__(self):
        self.weights, self.edges = np.zeros(N_FEATURES), np.zeros((3, 2, 2))

    def _pass(self, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beliefs, what came up from below with the node's own, and the messages to the parents."""
        own = np.zeros((len(f.parent), 2))
        own[:, 1] = f.x @ self.weights
        up = np.zeros_like(own)
        for level in reversed(f.levels):
            up[level] = _lse(self.edges[f.kind[level]] + own[level][:, None, :], 2)
            np.add.at(own, f.parent[level], up[level])
        belief = own.copy()
        for level in f.levels:
            rest = belief[f.parent[level]] - up[level]
            belief[level] = own[level] + _lse(self.edges[f.kind[level]] + rest[:, :, None], 1)
        return belief, own, up

    def marginals(self, f: Forest) -> np.ndarray:
        """Of each node: the probability of being article."""
        belief, _, _ = self._pass(f)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))

    def fit(self, pages: list[tuple[Page, list[int]]], steps: int = 250, rate: float = 0.1, l2: float = 0.3) -> TreeModel:
        """Maximum likelihood with a ridge, by Adam; ``pages`` with a label for each block."""
        f = Forest([p for p, _ in pages])
        y = np.array([v for _, labels in pages for v in labels])
        child = np.flatnonzero(f.parent >= 0)
        p, kind = f.parent[child], f.kind[child]
        n = len(pages)
        seen = np.zeros((3, 2, 2))
        np.add.at(seen, (kind, y[p], y[child]), 1)
        m1 = [np.zeros_like(self.weights), np.zeros_like(self.edges)]
        m2 = [np.zeros_like(self.weights), np.zeros_like(self.edges)]
        for t in range(1, steps + 1):
            belief, own, up = self._pass(f)
            prob = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
            pair = self.edges[kind] + (belief[p] - up[child])[:, :, None] + own[child][:, None, :]
            pair = np.exp(pair - pair.max((1, 2), keepdims=True))
            pair /= pair.sum((1, 2), keepdims=True)
            expected = np.zeros((3, 2, 2))
            np.add.at(expected, kind, pair)
            slopes = [(f.x.T @ (y - prob) - l2 * self.weights) / n, (seen - expected - l2 * self.edges) / n]
            for k, (value, g) in enumerate(zip((self.weights, self.edges), slopes, strict=True)):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                value += rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def texts(self, htmls: list[str | None]) -> list[str]:
        """The main text of each page."""
        pages = [parse(h or "") for h in htmls]
        f = Forest(pages)
        keep = self.marginals(f) > 0.5
        out = []
        for page, start in zip(pages, f.starts, strict=True):
            out.append(" ".join(t for b, t in page.runs if keep[start + b]))
        return out


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, set[str], str]]:
    """Pages with their truth: html, the words that mark article blocks' text, and the text itself.

    Words are invented; every text run outside the article bears a mark of its own, so labels can be read
    off the parsed tree.
    """
    rng = random.Random(seed)
    pick = rng.choice
    out = []
    for _ in range(n):
        truth: list[str] = []

        def words(k: int, mark: str) -> str:
            run = ["".join(pick(("re", "tion", "an", "the", "ou", "is", "ver", "lo", "mi", "ça", "über", "%%%", "A")) for _ in range(rng.randint(1, 4))) for _ in range(k)]
            run.insert(rng.randrange(k + 1), mark)
            return " ".join(run).capitalize().replace(mark.capitalize(), mark) + pick((".", ".", "", "!"))

        def good(low: int = 1, high: int = 60) -> str:
            text = words(rng.randint(low, pick((3, high))) if low == 1 else rng.randint(low, high), "qgoodq")
            truth.append(" ".join(text.split()))
            return text.replace("ça", pick(("ça", "&ccedil;a")))

        def bad(low: int = 1, high: int = 14) -> str:
            return words(rng.randint(low, high), "qbadq")

        def box(tag: str, names: tuple, inner: str) -> str:
            kind = pick(("class", "id", "class"))
            return f'<{tag} {kind}="{pick(names)}">{inner}</{tag}>'

        def links(k: int) -> str:
            items = "".join(f'<li><a href="/x">{bad(0, 2)}</a></li>' for _ in range(k))
            return f"<ul>{items}</ul>"

        def maybe(p: float, make) -> str:
            return make() if rng.random() < p else ""

        semantic = rng.random() < 0.65
        nav = lambda: (f"<nav>{links(rng.randint(2, 8))}</nav>" if rng.random() < 0.6 else box("div", ("menu", "main-nav", "navbar", "nav", "breadcrumb"), links(rng.randint(2, 8))))
        advert = lambda: box(pick(("div", "div", "aside", "section")), ("ad", "ads", "advert", "ad-slot", "sponsored", "promo"), pick((bad(2, 12), f"<p>{bad(3, 20)}</p>")))
        notice = lambda: box("div", ("cookie-notice", "consent", "cookie-banner", "notice", "popup"), f"<p>{bad(4, 25)}</p>" + maybe(0.5, lambda: "<button>OK</button>"))
        header = lambda: f"<header>{maybe(0.6, lambda: f'<h2>{bad(1, 4)}</h2>')}{maybe(0.7, nav)}{maybe(0.4, lambda: f'<p>{bad(2, 9)}</p>')}</header>" if semantic else box("div", ("header", "masthead", "topbar"), f"<div>{bad(1, 5)}</div>" + maybe(0.5, nav))
        footer = lambda: (f"<footer>{pick((bad(2, 12), f'<p>{bad(2, 15)}</p>'))}{maybe(0.3, lambda: links(3))}</footer>" if semantic or rng.random() < 0.5 else box("div", ("footer", "site-footer", "copyright"), f"<p>{bad(2, 14)}</p>"))
        side = lambda: (f"<aside>{maybe(0.5, lambda: f'<h3>{bad(1, 3)}</h3>')}{pick((links(4), f'<p>{bad(3, 25)}</p>'))}</aside>" if rng.random() < 0.5 else box("div", ("sidebar", "side", "widget", "related"), f"<h3>{bad(1, 3)}</h3>" + pick((links(4), f"<p>{bad(3, 25)}</p>"))))
        comments = lambda: box(pick(("section", "div")), ("comments", "comment-list", "disqus"), f"<h3>{bad(1, 2)}</h3>" + "".join(box("div", ("comment", "reply", "comment-body"), f"<p>{bad(3, 40)}</p>") for _ in range(rng.randint(1, 4))))
        form = lambda: f"<form>{bad(1, 4)}<label>{bad(1, 3)}</label><input name=q>{maybe(0.5, lambda: f'<p>{bad(2, 8)}</p>')}<button>Go</button></form>"

        def paragraph() -> str:
            turn = rng.random()
            if turn < 0.12:
                return f"<p><b>{good(1, 20)}<br>"
            if turn < 0.2:
                return f"<p>{good(4, 40)} "
            if turn < 0.27:
                return "<ul>" + "".join(f"<li>{good(1, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
            if turn < 0.32:
                return f"<h2>{good(1, 6)}</h2>"
            if turn < 0.36:
                return f"<blockquote><p>{good(3, 40)}</p></blockquote>"
            if turn < 0.39:
                return f"<table><tr><td>{good(1, 4)}</td><td>{good(1, 4)}</td></tr></table>"
            if turn < 0.42:
                return f'<p><a href="/y">{good(1, 8)}</a></p>'
            if turn < 0.44:
                return f"<noscript>{good(1, 20)}</noscript>"
            return f"<p>{good()}</p>"

        def aside() -> str:
            """A part of the article whose name has a word of other parts beside one of its own."""
            name = pick(tuple(_WORD_OF)) + "-" + pick(("work", "note", "effects", "price", "factor", "hoc", "history", "data", "results", "method", "summary", "story2", "zone", "quote"))
            return f'<{(tag := pick(("div", "div", "section", "section", "figure")))} class="{name}">' + "".join(f"<p>{good(2, 40)}</p>" for _ in range(rng.randint(1, 3))) + f"</{tag}>"

        body = maybe(0.9, lambda: f"<h1>{good(1, 12)}</h1>")
        for _ in range(rng.randint(1, 12)):
            body += paragraph()
            body += maybe(0.03, advert) + maybe(0.01, form) + maybe(0.06, aside)
        tail = maybe(0.12, lambda: box("div", ("share", "social", "tags", "related"), links(3)))
        if semantic:
            article = pick((f"<article>{body}{tail}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<article class="post"><div class="entry-content">{body}</div>{tail}</article>'))
        else:
            article = pick((box("div", ("content", "article", "post", "entry", "story", "article-body", "main", "text"), body + tail), f'<div class="main"><div class="post">{body}</div></div>', f"<div>{body}</div>", f'<section class="content">{body}</section>'))
        before = maybe(0.1, lambda: f"<noscript>{bad(2, 10)}</noscript>") + maybe(0.5, header) + maybe(0.6, nav) + maybe(0.25, notice) + maybe(0.4, advert)
        after = maybe(0.35, side) + maybe(0.3, comments) + maybe(0.25, form) + maybe(0.2, advert) + maybe(0.8, footer) + maybe(0.1, notice)
        inner = before + article + after if rng.random() < 0.7 else before + f'<div class="{pick(("wrapper", "container", "page", "row"))}">{article}{maybe(0.5, side)}</div>' + after
        head = f"<!DOCTYPE html><html><head><title>{bad()}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        end = pick(("</body></html>", "</body></html>", ""))
        out.append((f"{head}<body>{inner}{end}", {"qgoodq"}, " ".join(truth)))
    return out


def labels_of(page: Page, marks: set[str]) -> list[int]:
    """A block is article if its own text bears a mark, or most of the text below it does and it isn't the page itself."""
    good, total = [0] * len(page.blocks), [0] * len(page.blocks)
    own = [0] * len(page.blocks)
    for block, text in page.runs:
        total[block] += len(text)
        if any(m in text for m in marks):
            good[block] += len(text)
            own[block] = 1
    for k in range(len(page.blocks) - 1, 0, -1):
        parent = page.blocks[k].parent
        good[parent] += good[k]
        total[parent] += total[k]
    outer = ("body", "html", "#page")
    return [int(own[k] or (b.tag not in outer and total[k] > 0 and good[k] > 0.8 * total[k])) for k, b in enumerate(page.blocks)]


_MODEL: list[TreeModel] = []


def default_model() -> TreeModel:
    """The model of the drawn pages, trained once in a process."""
    if not _MODEL:
        pages = [(parse(html), marks) for html, marks, _ in labelled_pages()]
        _MODEL.append(TreeModel().fit([(p, labels_of(p, marks)) for p, marks in pages]))
    return _MODEL[0]


def extract(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with the main text in place of the html: text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch, html_col, 2 << 20):
                made = shared.value.texts(part.column(html_col).to_pylist())
                yield part, {html_col: [None] * len(made), "text": made, "n_chars": [len(t) for t in made]}

    return with_columns(pages, [(html_col, "string"), ("text", "string"), ("n_chars", "long")], run).drop(html_col)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
