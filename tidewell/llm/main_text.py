"""Main text of web pages by boosted trees over DOM nodes.

Each element gets features of its subtree (text, link and tag density), its
attribute tokens, its depth and its siblings. What a token (a class, an id, or
a part of one) says is learned too: the log odds that an element which has it
holds main text, in hashed buckets; of those around an element only the nearest
with a known token counts. Gradient-boosted trees, trained here on generated
pages with known main text, give the chance that the element is part of the
article. Decoding is hierarchical: along each path elements are
outside, then main, then excluded, in that order only, and the best labelling
of the whole tree is found by dynamic programming, so no main text lies below
an excluded element.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._shared import read_table

# HTML element classes and attribute words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style noscript template title iframe svg object canvas select option textarea button audio video".split())
FOREIGN = frozenset("svg math".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside body div footer form header html main nav section table td th ul ol".split())
TAG_GROUPS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li",), ("ul", "ol", "dl", "menu"), ("a",), ("article",), ("main",), ("div", "section"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label", "input"), ("table", "tr", "td", "th", "tbody"), ("blockquote", "pre", "figure", "figcaption"), ("html", "body")]
TAG_OF = {t: k for k, group in enumerate(TAG_GROUPS) for t in group}
LANDMARKS = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 5}
N_LANDMARKS = 6
NOISE = frozenset("nav header footer aside".split())
N_FEATURES = len(TAG_GROUPS) + N_LANDMARKS + 22
Odds = dict[int, float]  # by token bucket; those never seen say nothing
LIFTS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
TURN_COST = 2.0  # of leaving the outside, and of excluding part of the main text
_TOKEN = re.compile(r"[a-z]+")
_STOPS = re.compile("[.,。，、؟،।]")


def token_buckets(names: list[str]) -> frozenset[int]:
    """Buckets of whole names and of the words in them."""
    return frozenset(_bucket(t) for n in names for t in (n, *_TOKEN.findall(n)))


@functools.lru_cache(1 << 16)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset[int] = frozenset()  # buckets of attribute tokens
    landmark: int = 0  # nearest element around it, or itself, of ``LANDMARKS``; 0: none
    main: bool = False  # of generated pages
    own: int = 0
    children: list[int] = field(default_factory=list)


class Dom(HTMLParser):
    """Elements in page order, and the page's text with block breaks."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0)]
        self.open = [0]
        self.runs: list[tuple[int, str]] = []  # (node, text), or (-1, "") for a break
        self.feed(html)
        self.close()

    def _close(self, k: int) -> None:
        for node in self.open[k:]:
            if self.nodes[node].tag not in INLINE:
                self.runs.append((-1, ""))
        del self.open[k:]

    def _close_last(self, tags: frozenset[str] | set[str], scope: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[k]].tag
            if tag in tags:
                self._close(k)
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close_last({"p"}, SCOPE)
        if tag in CLOSES:
            self._close_last(CLOSES[tag], SCOPE - CLOSES[tag])
        names = [n for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop") for n in v.lower().split()]
        at, parent = len(self.nodes), self.open[-1]
        landmark = at if tag in LANDMARKS else self.nodes[parent].landmark
        self.nodes.append(Node(tag, parent, self.nodes[parent].depth + 1, token_buckets(names), landmark, any(k == "data-main" for k, _ in attrs)))
        self.nodes[parent].children.append(at)
        if tag not in INLINE:
            self.runs.append((-1, ""))
        elif tag == "br":
            self.runs.append((parent, " "))
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(self.nodes[k].tag in FOREIGN for k in self.open):
            self._close(len(self.open) - 1)  # elsewhere the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[k]].tag == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        self.runs.append((node, data))
        self.nodes[node].own += len(data.strip())


def node_features(dom: Dom, odds: Odds) -> np.ndarray:
    """A row of numbers for each element; ``odds`` by token bucket."""
    nodes = dom.nodes
    n = len(nodes)
    own = np.array([0 if x.tag in UNSEEN else x.own for x in nodes], float)
    text, link, tags, paras, stops = own.copy(), np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    for node, run in dom.runs:
        if node >= 0 and nodes[node].tag not in UNSEEN:
            stops[node] += len(_STOPS.findall(run))
    for k in range(n - 1, 0, -1):
        x = nodes[k]
        if x.tag == "a":
            link[k] = text[k]
        elif x.tag == "p":
            paras[k] += text[k] > 0
        p = x.parent
        text[p] += text[k]
        link[p] += link[k]
        tags[p] += tags[k]
        paras[p] += paras[k]
        stops[p] += stops[k]
    out = np.zeros((n, N_FEATURES), np.float32)
    total = max(text[0], 1.0)
    t = len(TAG_GROUPS)
    places = {c: i for x in nodes for i, c in enumerate(x.children)}
    alike = [Counter(nodes[c].tag for c in x.children) for x in nodes]
    said = [[o for b in x.tokens if (o := odds.get(b))] for x in nodes]
    named = [0] * n  # nearest element around with known tokens, 0: none
    for k in range(1, n):
        p = nodes[k].parent
        named[k] = p if said[p] else named[p]
    for k, x in enumerate(nodes):
        row = out[k]
        if (g := TAG_OF.get(x.tag)) is not None:
            row[g] = 1
        p = nodes[x.parent] if x.parent >= 0 else x
        if p.landmark:
            row[t + LANDMARKS[nodes[p.landmark].tag]] = 1
        size = len(p.children) or 1
        place = places.get(k, 0)
        near = said[named[k]]
        row[t + N_LANDMARKS :] = (
            x.depth, np.log1p(text[k]), text[k] / total, link[k] / max(text[k], 1.0), text[k] / tags[k], own[k] / max(text[k], 1.0),
            paras[k], stops[k] / max(text[k], 1.0), len(x.children), size, place / size, alike[max(x.parent, 0)][x.tag] / size,
            x.tag in UNSEEN, text[max(x.parent, 0)] / total,
            min(said[k], default=0), max(said[k], default=0), sum(said[k]), min(near, default=0), max(near, default=0), sum(near),
            text[named[k]] / total, text[p.landmark] / total,
        )
    return out


def token_odds(doms: list[_Labelled], smooth: float = 4.0) -> Odds:
    """Log odds, against all elements with tokens, that an element with a
    token of the bucket holds main text."""
    ones: Counter[int] = Counter()
    seen: Counter[int] = Counter()
    held, n = 0, 0
    for dom in doms:
        holds = dom.labels.copy()
        for k in range(len(dom.nodes) - 1, 0, -1):
            holds[dom.nodes[k].parent] |= holds[k]
        for x, y in zip(dom.nodes, holds.tolist(), strict=True):
            if x.tokens:
                held, n = held + y, n + 1
                seen.update(x.tokens)
                if y:
                    ones.update(x.tokens)
    share = (held + 1) / (n + 2)
    return {b: float(np.log((ones[b] + smooth * share) / (c - ones[b] + smooth * (1 - share))) - np.log(share / (1 - share))) for b, c in seen.items()}


class BoostedTrees:
    """Logistic gradient boosting with small trees over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 4.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], 1)
        cells = binned + np.arange(x.shape[1]) * self.bins
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cells, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _sums(self, cells: np.ndarray, at: np.ndarray, wide: int, weight: np.ndarray) -> np.ndarray:
        """Sums of ``weight`` by node of the level, feature and bin, added up
        over the bins."""
        f = cells.shape[1]
        flat = np.bincount((at[:, None] * (f * self.bins) + cells).ravel(), np.repeat(weight, f), wide * f * self.bins)
        return np.cumsum(flat.reshape(wide, f, self.bins), axis=2)

    def _grow(self, binned: np.ndarray, cells: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tree as arrays, node k above 2k + 1 and 2k + 2. A node that no cut
        improves passes all rows to the left, its value to both."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.zeros(size, int), np.full(size, np.inf), np.zeros(size)
        allowed = np.array([[k < len(e) for k in range(self.bins)] for e in edges])
        at = np.zeros(len(grad), int)
        for level in range(self.depth + 1):
            first, wide = 2**level - 1, 2**level
            g, h = np.bincount(at, grad, wide), np.bincount(at, hess, wide)
            value[first : first + wide] = self.rate * g / (h + 1)
            if level == self.depth:
                break
            gl, hl = self._sums(cells, at, wide, grad), self._sums(cells, at, wide, hess)
            g, h = g[:, None, None], h[:, None, None]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[~(allowed[None] & (hl >= self.least) & (h - hl >= self.least))] = 0
            flat = gain.reshape(wide, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(wide), best] > 1e-6
            f, b = best // self.bins, best % self.bins
            feature[first : first + wide] = np.where(good, f, 0)
            cut[first : first + wide] = [edges[i][j] if ok else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            right = good[at] & (binned[np.arange(len(at)), f[at]] > b[at])
            at = 2 * at + right
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def decode_states(dom: Dom, margin: np.ndarray) -> np.ndarray:
    """For each element: 0 outside, 1 main, 2 excluded; the likeliest
    labelling in which states never fall along a path."""
    nodes = dom.nodes
    main = -np.logaddexp(0, -margin)
    other = -np.logaddexp(0, margin)
    best = np.stack([other, main, other], 1)
    unseen = np.array([x.tag in UNSEEN for x in nodes])
    best[unseen, :2] = -1e6
    choice = np.zeros((len(nodes), 3), int)
    rows = best.tolist()
    for k in range(len(nodes) - 1, 0, -1):
        a, m, x = rows[k]
        parent = rows[nodes[k].parent]
        under_a = max((a, 0), (m - TURN_COST, -1), (x, -2))
        choice[k, 0] = -under_a[1]
        choice[k, 1] = 1 if m >= x - TURN_COST else 2
        choice[k, 2] = 2
        parent[0] += under_a[0]
        parent[1] += max(m, x - TURN_COST)
        parent[2] += x
    states = np.zeros(len(nodes), int)
    states[0] = nodes[0].own > 0 and rows[0][1] - TURN_COST > rows[0][0]  # text may stand outside all elements
    for k in range(1, len(nodes)):
        states[k] = choice[k, states[nodes[k].parent]]
    return states


def joined_text(dom: Dom, states: np.ndarray) -> str:
    """Blocks of main text in page order, white space made single."""
    blocks: list[str] = []
    part: list[str] = []
    for node, run in [*dom.runs, (-1, "")]:
        if node < 0:
            if part and (block := " ".join("".join(part).split())):
                blocks.append(block)
            part = []
        elif states[node] == 1:
            part.append(run)
    return "\n".join(blocks)


def unmarked(dom: Dom, odds: Odds) -> np.ndarray:
    """The elements whose text may be an article's where none is found: all
    but links, unseen ones, noise by their tag or by the tokens nearest to
    them, and what lies in any of these."""
    fine = np.ones(len(dom.nodes), bool)
    for k, x in enumerate(dom.nodes[1:], 1):
        said = [o for b in x.tokens if (o := odds.get(b))]
        fine[k] = fine[x.parent] and x.tag not in UNSEEN and x.tag != "a" and x.tag not in NOISE and not (said and max(said) < 0)
    return fine


def main_text(dom: Dom, margin: np.ndarray, odds: Odds) -> str:
    """The text of the likeliest labelling. If it has none, though some text
    stands in elements that nothing marks as other than an article, these are
    held for likelier, step by step."""
    text = joined_text(dom, decode_states(dom, margin))
    if text:
        return text
    fine = unmarked(dom, odds)
    if not any(node >= 0 and fine[node] and run.strip() for node, run in dom.runs):
        return text
    for more in LIFTS:
        if text := joined_text(dom, decode_states(dom, np.where(fine, margin + more, margin))):
            break
    return text


def generated_page(rng: random.Random) -> str:
    """A page by rule, its article marked ``data-main``; what the article must
    not contain is marked ``data-not``."""

    eastern = rng.random() < 0.08

    def words(a: int, b: int) -> str:
        if eastern:  # a script without spaces
            made = "".join(chr(rng.randrange(0x4E00, 0x5E00)) + ("，" if rng.random() < 0.08 else "") for _ in range(2 * rng.randint(a, b)))
            return made + rng.choice(["", "。"])
        made = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b))]
        for k in range(rng.randint(3, 9), len(made), rng.randint(6, 14)):
            made[k] += rng.choice(".,.,;")
        return " ".join(made).capitalize() + rng.choice(["", ".", "."])

    def attr(*names: str) -> str:
        name = rng.choice(names)
        return "" if rng.random() < 0.15 else f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "-1", " box", "-wrap"])}"'

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 4)}</a></li>' for k in range(rng.randint(a, b))) + "</ul>"

    def para() -> str:
        kind, body = rng.random(), words(2, 90)
        if kind < 0.03:
            return f"<p>{body} {rng.choice(['<svg/>', '<svg><path d=1></path></svg>', '<img src=i>'])} {words(2, 40)}</p>"
        if kind < 0.12:
            return f"<p><b>{words(2, 12)}<br>"
        if kind < 0.2:
            return f"<p>{body} <a href='/x'>{words(1, 4)}</a> {words(2, 20)}</p>"
        if kind < 0.26:
            return f"<h{rng.randint(2, 4)}>{words(2, 8)}</h2>"
        if kind < 0.31:
            return "<ul>" + "".join(f"<li>{words(3, 16)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.35:
            return f"<blockquote><p>{body}</p></blockquote>"
        if kind < 0.38:
            return f"<figure><img src='a'><figcaption>{words(3, 10)}</figcaption></figure>"
        if kind < 0.41:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.45:
            return f"<div><p>{body}</p></div>"
        return f"<p>{body}</p>"

    def noise(kind: str) -> str:
        if kind == "nav":
            return rng.choice([f"<nav data-not>{links(3, 9)}</nav>", f"<nav data-not>{words(2, 90)}</nav>", f"<div data-not{attr('menu', 'navbar', 'navigation', 'breadcrumb')}>{links(3, 8)}</div>", f"<ul data-not{attr('menu', 'nav')}><li><a href='/'>{words(1, 2)}</a><li><a href='/b'>{words(1, 3)}</a></ul>"])
        if kind == "header":
            return rng.choice([f"<header data-not><h1><a href='/'>{words(1, 3)}</a></h1><p>{words(2, 9)}</p></header>", f"<div data-not{attr('header', 'masthead', 'banner')}><p>{words(1, 8)}</p></div>"])
        if kind == "footer":
            return rng.choice([f"<footer data-not>&copy; {words(1, 4)} &middot; {words(2, 12)}</footer>", f"<footer data-not>{words(20, 120)}</footer>", f"<footer data-not><p>{words(4, 40)}</p>{links(2, 5)}</footer>", f"<div data-not{attr('footer', 'copyright')}><p>{words(3, 20)}</p></div>"])
        if kind == "side":
            inner = rng.choice([links(3, 7), f"<h3>{words(1, 3)}</h3><p>{words(5, 40)}</p>"])
            return rng.choice([f"<aside data-not>{inner}</aside>", f"<div data-not{attr('sidebar', 'widget', 'related', 'rail')}>{inner}</div>"])
        if kind == "ad":
            return rng.choice([f"<div data-not class='{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'promo'])}'>{words(3, 30)}</div>", f"<section data-not{attr('ad', 'promo', 'advertisement')}><p>{words(3, 40)}</p></section>"])
        if kind == "notice":
            return f"<div data-not{attr('cookie', 'cookie-notice', 'notice', 'consent', 'popup', 'alert')}><p>{words(5, 40)}</p><button>{words(1, 2)}</button></div>"
        if kind == "form":
            return f"<form data-not{attr('search', 'newsletter', 'login', 'subscribe')}><label>{words(1, 4)}</label><input name=q><p>{words(2, 14)}</p><button>{words(1, 2)}</button></form>"
        if kind == "comments":
            each = "".join(f"<div class='comment'><b>{words(1, 2)}</b><p>{words(3, 50)}</p></div>" for _ in range(rng.randint(1, 8)))
            return rng.choice([f"<section data-not{attr('comments', 'discussion', 'responses')}><h3>{words(1, 3)}</h3>{each}</section>", f"<div data-not class='comments'>{each}</div>", f"<ol data-not class='comment-list'>{''.join(f'<li><p>{words(3, 50)}</p></li>' for _ in range(3))}</ol>"])
        return f"<div data-not{attr('share', 'social', 'tags')}><a href='/s'>{words(1, 1)}</a> <a href='/t'>{words(1, 1)}</a></div>"

    inside = "".join(para() + (noise(rng.choice(["ad", "share", "form", "side", "notice"])) if rng.random() < 0.05 else "") for _ in range(rng.randint(0, 16)))
    head = f"<h1>{words(2, 10)}</h1>" if rng.random() < 0.85 else ""
    if rng.random() < 0.2:
        head = f"<header>{head}</header>" if rng.random() < 0.3 else f"<div>{head}</div>"
    if rng.random() < 0.12:
        inside += noise("comments")
    if rng.random() < 0.25:
        return _plain_page(rng, head + inside, noise, words)
    tag = rng.choice(["article"] * 5 + ["main", "div", "div", "section"])
    mark = "" if tag in ("article", "main") and rng.random() < 0.6 else attr("content", "article", "post", "entry", "story", "main")
    if tag in ("div", "section") and not mark:
        mark = " class='content'"
    article = f"<{tag} data-main{mark}>{head}{inside}</{tag}>"
    before = [noise(k) for k in ("nav", "header", "ad", "notice", "form") if rng.random() < 0.5]
    after = [noise(k) for k in ("side", "comments", "form", "ad", "share", "nav") if rng.random() < 0.35] + [noise("footer")] * (rng.random() < 0.85)
    rng.shuffle(before)
    body = "".join(before) + (f"<main>{article}</main>" if rng.random() < 0.1 and tag == "article" else article) + "".join(after)
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>{_wrapped(rng, body)}</html>"


# Names of elements round a whole page, some of words that name noise elsewhere.
WRAPPERS = "wrapper container page site wrap outer inner layout row main-wrapper site-content site-container content-wrapper has-sidebar with-sidebar right-sidebar sidebar-layout no-nav fixed-header header-fixed sticky-footer home contact single blog post-template".split()


def _wrapped(rng: random.Random, body: str, mark: str = "") -> str:
    """The body element of a page, with elements round all of it."""
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
        names = " ".join(rng.sample(WRAPPERS, rng.choice([1, 1, 2])))
        body = f"<div {rng.choice(['class', 'class', 'id'])}='{names}'>{body}</div>"
    if rng.random() < 0.06:
        body = f"<form id={rng.choice(['aspnetForm', 'form1'])} method=post>{body}</form>"
    name = f" class='{' '.join(rng.sample(WRAPPERS, rng.choice([1, 2, 3])))}'" if rng.random() < 0.4 else ""
    return f"<body{mark}{name}>{body}</body>"


def _plain_page(rng: random.Random, article: str, noise: Callable[[str], str], words: Callable[[int, int], str]) -> str:
    """A page whose article stands in no telling element: in the body itself,
    in nameless nested ``div`` elements, or in a cell of a layout table."""
    first = "".join(noise(k) for k in ("nav", "header", "notice") if rng.random() < 0.3)
    last = "".join(noise(k) for k in ("side", "comments", "footer") if rng.random() < 0.35)
    article = article or f"<p>{words(5, 90)}</p>"
    kind = rng.randrange(5)
    if kind == 4:  # no article at all
        return f"<html>{_wrapped(rng, noise('nav') + first + last + noise('footer'))}</html>"
    if kind == 0:
        name = f" class='{rng.choice(WRAPPERS)}'" if rng.random() < 0.4 else ""
        return f"<html><head><title>{words(1, 5)}</title></head><body data-main{name}>{first}{article}{last}</body></html>"
    if kind == 1:
        depth = rng.randint(1, 4)
        name = f" class='{rng.choice(WRAPPERS)}'" if rng.random() < 0.4 else ""
        return f"<html>{_wrapped(rng, first + '<div>' * depth + f'<div data-main{name}>{article}</div>' + '</div>' * depth + last)}</html>"
    if kind == 2:
        left = f"<td data-not width=120>{''.join(f'<a href=/{k}>{words(1, 2)}</a><br>' for k in range(rng.randint(3, 8)))}</td>"
        return f"<html><body>{first}<table border=0><tr>{left}<td data-main>{article}</td></tr></table>{last}</body></html>"
    text = "<br><br>".join(words(20, 80) for _ in range(rng.randint(1, 5)))
    return f"<html><body data-main>{text}</body></html>" if rng.random() < 0.7 else f"{text}"


class _Labelled(Dom):
    """A DOM of a generated page, with the label of each element."""

    def __init__(self, html: str) -> None:
        self.excluded: set[int] = set()
        super().__init__(html)
        self.labels = np.zeros(len(self.nodes), int)
        self.labels[0] = len(self.nodes) == 1 or all(x.tag == "br" for x in self.nodes[1:])
        for k, x in enumerate(self.nodes[1:], 1):
            self.labels[k] = (x.main or self.labels[x.parent]) and k not in self.excluded and x.tag not in UNSEEN

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if any(k == "data-not" for k, _ in attrs):
            self.excluded.add(len(self.nodes))
        super().handle_starttag(tag, attrs)


@dataclass
class Model:
    """Trees over elements and the log odds of attribute tokens."""

    trees: BoostedTrees
    odds: Odds


@functools.lru_cache
def train(pages: int = 1000, seed: int = 11) -> Model:
    """Model of ``pages`` generated pages (the bound on what is learned)."""
    rng = random.Random(seed)
    doms = [_Labelled(generated_page(rng)) for _ in range(pages)]
    odds = token_odds(doms)
    return Model(BoostedTrees().fit(np.concatenate([node_features(d, odds) for d in doms]), np.concatenate([d.labels for d in doms]).astype(float)), odds)


def extract(htmls: list[str | None], model: Model) -> list[str]:
    """Main texts; null and empty pages have an empty one."""
    doms = [Dom(h or "") for h in htmls]
    rows = [node_features(d, model.odds) for d in doms]
    margin = model.trees.margin(np.concatenate(rows)) if rows else np.zeros(0)
    ends = np.cumsum([len(r) for r in rows])
    return [main_text(d, margin[e - len(d.nodes) : e], model.odds) for d, e in zip(doms, ends, strict=True)]


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, in rows as many as there
    are, repeated ones too; ids and urls may be null and pass through; null and
    empty pages have an empty text; other columns are not read. The model (some
    kB) goes with the task."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                piece = batch.slice(start, 128)
                texts = extract(piece.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all of ``pages``; for odd rows see ``extract_pages``."""
    return extract_pages(read_table(spark, sf_dir, "pages"))
