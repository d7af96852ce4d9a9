"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary node (content or not) with a potential from its tag, names, text and links, and one from
each parent-child edge. Sum-product messages up and down the tree give exact marginals; the weights are trained on
labelled pages by following the gradient of the conditional likelihood, which needs only those marginals.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm.common import batches

#: Fixed values of HTML: elements without content, elements inside a line, elements whose text is never shown as text,
#: elements whose content is not markup, and those that a new block ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup "
    "time tt u var math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
HIDDEN = frozenset("head script style title noscript template svg annotation annotation-xml select button iframe object textarea canvas audio video datalist option".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre section summary table ul".split()
)
#: Elements that a head may hold, whether open or not: any other one ends it. Elements that "/>" closes, as all inside them.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
#: Elements that an element of the same group ends, up to the container that holds the group.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Groups of elements that share weights.
GROUPS = {
    "root": "root html body", "main": "article main", "div": "div section center td th tr tbody thead table details", "p": "p pre blockquote dd dt address",
    "head": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form fieldset legend", "figure": "figure figcaption",
}
_GROUP = {tag: group for group, tags in GROUPS.items() for tag in tags.split()}
#: Parts of class, id, role and label names that tell what a block is.
NAMES = {
    "content": "article post entry content story body text main prose", "menu": "nav menu breadcrumb breadcrumbs pagination pager toc tabs toolbar",
    "comment": "comment comments commentlist reply replies discussion disqus respond feedback review reviews reader readers",
    "side": "sidebar aside side widget related recommended recommendations trending popular more teaser complementary",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe signup paywall warning privacy",
    "foot": "footer foot copyright legal colophon contentinfo imprint", "top": "header masthead topbar top logo branding site",
    "meta": "share social byline author meta tags tag date credits sharing follow", "search": "search login form contact",
}
_NAME = {word: kind for kind, words in NAMES.items() for word in words.split()}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = frozenset(("class", "id", "role", "aria-label", "itemprop"))
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Page:
    """Block elements in page order, parents first; node 0 is the page. ``chunks`` are (node, text, breaks before it)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["root"])
    attributes: list[str] = field(default_factory=lambda: [""])
    size: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    chunks: list[tuple[int, str, bool]] = field(default_factory=list)


class _Open:
    """The open elements, outermost first, and where those of each name and kind are: no question walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("root", 0)]  # name, and the block node that the element writes to
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.hidden = self.anchors = self.foreign = 0

    def push(self, name: str, node: int) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.hidden += name in HIDDEN
        self.anchors += name == "a"
        self.foreign += name in FOREIGN
        self.stack.append((name, node))

    def last(self, name: str) -> int:
        """Place of the innermost element of a name; 0 if there is none."""
        places = self.at.get(name)
        return places[-1] if places else 0

    def outermost(self, name: str, behind: int) -> int | None:
        """Place of the outermost element of a name that is inside the one at ``behind``."""
        places = self.at.get(name, [])
        k = bisect_right(places, behind)
        return places[k] if k < len(places) else None

    def close(self, k: int) -> bool:
        """Closes the element at k and all inside it; whether one of them is a block."""
        block = False
        while len(self.stack) > k:
            name, _ = self.stack.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()
                block = True
            self.hidden -= name in HIDDEN
            self.anchors -= name == "a"
            self.foreign -= name in FOREIGN
        return block


def parse(html: str) -> Page:
    """The block tree of a page. Markup that is not closed, or closed twice, is mended as browsers do."""
    page = Page()
    tree = _Open()
    stack = tree.stack
    breaks = True
    at, end = 0, len(html)
    while at < end:
        match = _TOKEN.match(html, at)
        at = match.end()
        name = match.group(2) or match.group(5)
        if name is None:
            text = match.group()
            if text.startswith("<!") or text.startswith("<?") or text.startswith("</"):
                continue
            if len(stack) > 1 and stack[-1][0] == "head" and text.strip():
                tree.close(len(stack) - 1)
            if tree.hidden:
                continue
            if "&" in text:
                text = unescape(text)
            node = stack[-1][1]
            page.chunks.append((node, text, breaks))
            breaks = False
            n = len(text) - text.count(" ")
            page.size[node] += n
            if tree.anchors:
                page.linked[node] += n
            continue
        name = name.lower()
        if match.group(1) or match.group(4):
            k = tree.last(name)
            if name in ("br", "p") and not k:
                breaks = True
            # A line element does not close the blocks around it.
            elif k and not (name in INLINE and tree.blocks[-1] > k):
                breaks = tree.close(k) or breaks
            continue
        attributes = match.group(3) or match.group(6) or ""
        if len(stack) > 1 and stack[-1][0] == "head" and name not in IN_HEAD:
            tree.close(len(stack) - 1)
            breaks = True
        if attributes.endswith("/") and (name in FOREIGN or tree.foreign):
            breaks = breaks or name not in INLINE and name not in FOREIGN
            continue
        close = None
        if name in ENDS_P:
            close = tree.last("p") or None
        elif name in SIBLINGS:
            same, stops = SIBLINGS[name]
            behind = max((tree.last(t) for t in stops), default=0)
            close = min((k for k in (tree.outermost(t, behind) for t in same) if k is not None), default=None)
        if close is not None and all(tree.last(t) <= close for t in ("table", "article", "section", "div")):
            tree.close(close)
            breaks = True
        if name in VOID:
            breaks = breaks or name in ("br", "hr", "img")
            continue
        if name in RAW:
            # Everything up to the end tag is not markup, and none of it is main text.
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(html, at)
            at = closing.end()
            breaks = True
            continue
        if name in INLINE:
            tree.push(name, stack[-1][1])
            continue
        breaks = True
        hidden = tree.hidden or name in HIDDEN
        if not hidden:
            page.parent.append(stack[-1][1])
            page.tag.append(name)
            page.attributes.append(attributes)
            page.size.append(0)
            page.linked.append(0)
        tree.push(name, len(page.tag) - 1 if not hidden else stack[-1][1])
    return page


@functools.lru_cache(maxsize=20_000)
def _named(attributes: str) -> tuple[str, ...]:
    """Features of an element's names; pages repeat them, so they are kept."""
    found = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in _NAMED:
            found |= {f"name:{_NAME[w]}" for w in _SPLIT.split(value) if w in _NAME}
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            found.add("hidden")
    return tuple(sorted(found))


def features(page: Page) -> list[list[str]]:
    out = []
    for tag, attributes, size, linked in zip(page.tag, page.attributes, page.size, page.linked):
        group = _GROUP.get(tag, "div")
        row = [f"tag:{group}", f"size:{min(len(bin(size)) - 2, 10) if size else 0}", "all"]
        if size:
            row.append(f"links:{4 * linked // size}")
        if attributes:
            row += _named(attributes)
        out.append(row)
    return out


@dataclass
class TreeModel:
    """``weights`` by feature: log-odds of content. ``edges`` by group of the child: log potentials of (parent, child) =
    (0, 0), (0, 1), (1, 0), (1, 1)."""

    weights: dict[str, float]
    edges: dict[str, list[float]]

    def unary(self, page: Page) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in features(page)]

    def messages(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """For each node: log-odds from itself and below, log-odds of the parent without it, and its marginal log-odds."""
        own = self.unary(page)
        n = len(own)
        tables = [self.edges[_GROUP.get(t, "div")] for t in page.tag]
        up = [0.0] * n
        for c in range(n - 1, 0, -1):  # children before parents
            a00, a01, a10, a11 = tables[c]
            s = own[c]
            up[c] = _pair(a10, a11 + s) - _pair(a00, a01 + s)
            own[page.parent[c]] += up[c]
        marginal, above = own[:], [0.0] * n
        for c in range(1, n):
            t = marginal[page.parent[c]] - up[c]
            a00, a01, a10, a11 = tables[c]
            above[c] = t
            marginal[c] = own[c] + _pair(a01, t + a11) - _pair(a00, t + a10)
        return own, above, marginal

    def text(self, html: str) -> str:
        page = parse(html)
        marginal = self.messages(page)[2]
        parts: list[str] = []
        open_block = False
        for node, text, breaks in page.chunks:
            if marginal[node] <= 0:
                open_block = False
                continue
            parts.append(text if open_block and not breaks else f" {text}")
            open_block = True
        return " ".join("".join(parts).split())


def _pair(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + log(1.0 + exp(b - a)) if a - b < 40 else a


def _odds(z: float) -> float:
    return 1.0 / (1.0 + exp(-z)) if z > -40 else 0.0


def train(pages: list[tuple[Page, list[int]]], rounds: int = 25, rate: float = 0.3, decay: float = 1e-3) -> TreeModel:
    """Gradient ascent on the conditional log-likelihood of the labels, page by page; per-weight steps shrink as they add up."""
    model = TreeModel({}, {g: [0.0] * 4 for g in GROUPS})
    seen: dict = {}

    def step(table, key, slot, gradient):
        gradient -= decay * table[key]
        seen[slot, key] = total = seen.get((slot, key), 1e-3) + gradient * gradient
        table[key] += rate * gradient / total**0.5

    for _ in range(rounds):
        for page, labels in pages:
            own, above, marginal = model.messages(page)
            rows = features(page)
            gradients: dict[str, float] = {}
            for row, y, z in zip(rows, labels, marginal):
                d = y - _odds(z)
                for f in row:
                    gradients[f] = gradients.get(f, 0.0) + d
            edges: dict[str, list[float]] = {}
            for c in range(1, len(labels)):
                group = _GROUP.get(page.tag[c], "div")
                a, t, s = model.edges[group], above[c], own[c]
                e = [a[0], a[1] + s, a[2] + t, a[3] + t + s]
                top = max(e)
                p = [exp(v - top) for v in e]
                total = sum(p)
                g = edges.setdefault(group, [0.0] * 4)
                g[2 * labels[page.parent[c]] + labels[c]] += 1.0
                for k in range(4):
                    g[k] -= p[k] / total
            for f, d in gradients.items():
                model.weights.setdefault(f, 0.0)
                step(model.weights, f, "node", d)
            for group, g in edges.items():
                for k in range(4):
                    step(model.edges[group], k, group, g[k])
    return model


def labelled_pages(n: int, seed: int = 3) -> list[str]:
    """Pages made by rule from the layouts that sites use; elements of the article have the attribute data-y."""
    rng = np.random.default_rng(seed)
    syllables = ("an", "er", "tion", "the", "ble", "ing", "re", "ou", "ver", "sch", "ment", "que", "lich", "do", "ra", "keit")
    pick = lambda *options: options[int(rng.integers(len(options)))]
    maybe = lambda share, make: make() if rng.random() < share else ""
    words = lambda a, b: " ".join("".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(a, b + 1))))
    link = lambda: f'<a href="/x">{words(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 8)))) + "</ul>"
    prose = lambda: f"<p>{words(5, 60)}.</p>"
    block = lambda names, make, tags=("div", "section"): (lambda t: f'<{t} {pick("class", "id")}="{pick(*names)}">{make()}</{t}>')(pick(*tags))
    ad = lambda: block(("ad", "ads", "advert", "ad-box", "sponsored", "promo"), lambda: pick(words(2, 25) + ".", prose(), link()), ("div", "aside"))
    comment = lambda: block(("comment", "comment-body", "reply"), lambda: maybe(0.5, lambda: f"<h4>{words(1, 2)}</h4>") + prose(), ("div", "li", "article"))
    comments = lambda: block(("comments", "comment-list", "discussion", "reader-comments", "disqus"), lambda: maybe(0.6, lambda: f"<h2>{words(1, 2)}</h2>") + "".join(comment() if rng.random() < 0.6 else prose() for _ in range(int(rng.integers(1, 5)))), ("section", "div", "ol", "aside"))
    form = lambda: f'<form{pick("", " class=newsletter", " id=search")}>{maybe(0.7, prose)}<label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button></form>'
    notice = lambda: block(("cookie-notice", "consent", "alert", "notice", "popup", "newsletter"), lambda: pick(prose(), words(6, 30) + ".") + maybe(0.5, lambda: f"<button>{words(1, 1)}</button>"), ("div", "aside", "section"))
    side = lambda: pick(f"<aside>{maybe(0.7, lambda: f'<h3>{words(1, 3)}</h3>')}{pick(prose(), links())}{maybe(0.4, prose)}</aside>", block(("sidebar", "widget", "related", "recommended", "trending"), lambda: maybe(0.7, lambda: f"<h3>{words(1, 3)}</h3>") + pick(prose(), links()) + maybe(0.4, prose)))
    menu = lambda: pick(f"<nav>{links()}</nav>", f"<nav>{link()} | {link()} {link()}</nav>", block(("menu", "navbar", "breadcrumbs", "top-nav"), links))
    top = lambda: pick(f"<header>{maybe(0.6, lambda: f'<h1>{words(1, 3)}</h1>')}{maybe(0.7, lambda: f'<p>{words(2, 20)}</p>')}{maybe(0.6, menu)}</header>", block(("header", "masthead", "topbar"), lambda: words(1, 4) + maybe(0.5, menu)))
    foot = lambda: pick(f"<footer>{pick('&copy; ', '')}{words(2, 30)} {maybe(0.4, links)}{maybe(0.4, prose)}</footer>", block(("footer", "copyright", "legal"), lambda: pick(prose(), words(3, 20), links())))

    def piece() -> str:
        inner = pick(words(1, 90) + ".", f"{words(3, 30)} <b>{words(1, 4)}</b> {words(1, 20)} {link()}.", f"<b>{words(2, 30)}<br>", words(1, 3) + ".")
        return pick(
            f"<p data-y>{inner}</p>", f"<p data-y>{inner}</p>", f"<p data-y>{inner}</p>", f"<p data-y>{inner}", f"<h2 data-y>{words(1, 6)}</h2>",
            f"<blockquote data-y>{words(5, 30)}</blockquote>", f"<pre data-y>{words(2, 20)}</pre>", "<ul data-y>" + "".join(f"<li data-y>{words(1, 20)}</li>" for _ in range(3)) + "</ul>",
            f"<div data-y>{words(3, 40)}</div>", f"<div data-y><p data-y>{words(3, 40)}</p></div>", f"<section data-y><h2 data-y>{words(1, 5)}</h2><p data-y>{words(3, 60)}</p></section>",
            f"<table data-y><tr data-y><td data-y>{words(1, 5)}</td><td data-y>{words(1, 5)}</td></tr></table>", f"<figure data-y><figcaption data-y>{words(2, 12)}</figcaption></figure>",
        )

    def article() -> str:
        body = f"<h1 data-y>{words(2, 12)}</h1>" if rng.random() < 0.8 else ""
        body += maybe(0.2, lambda: block(("byline", "meta", "share", "author-date"), lambda: words(1, 6)))
        for _ in range(int(rng.integers(1, 14))):
            body += piece() + maybe(0.06, ad) + maybe(0.03, form) + maybe(0.04, side) + maybe(0.02, notice)
        body += maybe(0.15, comments) + maybe(0.1, lambda: block(("share", "social", "tags"), links)) + maybe(0.06, foot)
        tag, names = pick(("article", ""), ("article", ""), ("article", pick(' class="post"', ' class="story"', ' class="article"')), ("main", ""), ("div", f' class="{pick("post", "entry-content", "article-body", "story", "content", "post-text")}"'), ("section", ' id="content"'))
        return f"<{tag}{names} data-y>{body}</{tag}>"

    out = []
    for i in range(n):
        if i % 16 == 0:  # pages of text alone
            out.append(pick(f"<body data-y>{words(5, 80)}</body>", f"<html data-y><body data-y>{''.join(f'<p data-y>{words(4, 60)}</p>' for _ in range(4))}</body></html>"))
            continue
        page = maybe(0.3, notice) + maybe(0.7, top) + maybe(0.8, menu) + maybe(0.4, ad) + maybe(0.2, side)
        middle = article() + maybe(0.35, comments) + maybe(0.4, side) + maybe(0.2, form) + maybe(0.2, ad) + maybe(0.2, notice)
        page += pick(middle, middle, f"<main>{middle}</main>", f'<div class="wrapper">{middle}</div>', f'<div id="page">{middle}</div>') + maybe(0.8, foot) + maybe(0.1, notice)
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>")
    return out


def read_labels(html: str) -> tuple[Page, list[int]]:
    """A labelled page: its tree, and 1 for each block that has the attribute data-y."""
    page = parse(html)
    labels = [int("data-y" in a) for a in page.attributes]
    page.attributes = [a.replace("data-y", "") for a in page.attributes]
    return page, labels


@functools.cache
def trained(pages: int = 320) -> TreeModel:
    """Trained on ``pages`` made labelled pages."""
    return train([read_labels(h) for h in labelled_pages(pages)])


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None
) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    Whole pages are read. Text of a block whose marginal probability of content is over one half is kept, in page order;
    character references are decoded, white space becomes one space, blocks are joined by one space. A null or empty
    html, or one without content, has an empty text. Rows that repeat an id, and rows without one, are read like others;
    other columns are ignored; an empty table gives an empty result.
    """
    model = model or trained()
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n", pa.int64())])

    def rows(it):
        for batch in it:
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html"))):
                text = model.text(html).encode("utf-8", "replace").decode("utf-8") if html else ""
                yield i, url, text, len(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(schema, rows(it), 500)

    source = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )
    return source.mapInArrow(run, "id bigint, url string, text string, n bigint").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.col("n").alias("n_chars")
    )
