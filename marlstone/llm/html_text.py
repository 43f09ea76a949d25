"""HTML extraction by a tree-structured graphical model.

A page becomes a tree of block elements with text blocks as leaves. Every node
has a hidden state, content or boilerplate; its features (tag, words of class,
id and role, amount and kind of text) give a unary potential, parent and child
states a pairwise one. Both are fitted by counting on labelled pages. One
upward and one downward sweep of sum-product messages, level by level over all
pages of a batch at once, give every node's exact marginal; text blocks whose
marginal favours content are the main text, in page order.

Scripts, styles, form controls and the like hold no text to begin with. A head
needs no skip: what may stand in it is silent by itself, and anything else ends it.
Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one space.

Defined cases: null or empty html gives an empty text; markup without end, tags
left open or closed twice and stray end tags are read as browsers do, roughly:
an end tag without its start is passed over, a missing one ends with its
parent, and a tag whose quote is left open with its first >; elements nested
more than DEPTH deep are siblings; text outside any element belongs to the
page's root; scripts and the like don't part a word; elements that are hidden
by their own attributes are boilerplate; repeated rows are each extracted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of the page.
SILENT = frozenset("script style title noscript template iframe object svg canvas select option button textarea audio video datalist".split())
#: Of those, the ones in which markup isn't read.
RAW = frozenset("script style title textarea iframe noscript".split())
#: Of those, the ones that can't hold another of their kind; a second start tag goes on with the skip.
FLAT = frozenset("select option button".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end blocks.
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol p pre section summary table caption colgroup tbody td tfoot th thead tr ul search".split()
)
#: Of those, lines and paragraphs.
LINES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption summary legend label address".split())
#: Which open elements a start tag ends.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Start tags that end a parent even with a silent element left open in it.
ITEMS = frozenset(CLOSES) - {"p"}
#: A tag ends at the first > outside a quoted value, or with the page. Every part is possessive: a page is read in linear time.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:class|id|role|itemprop|aria-label|y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_LABEL = re.compile(r"\by=([01])")
_WORD = re.compile(r"[a-z]+")
#: Elements nested deeper than this are children of the last one above, as in browsers.
DEPTH = 512


def _close(html: str, name: str, at: int) -> int:
    """Past the end tag of an element in which markup isn't read."""
    end = _ENDS[name].search(html, at)
    return end.end() if end else len(html)


_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}


class Page:
    """The tree of one page: parents, feature lists, and the text of leaves (None for elements)."""

    __slots__ = ("parent", "features", "texts", "labels", "shares", "lines")

    def __init__(self, html: str, labelled: bool = False):
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [[]]
        self.texts: list[str | None] = [None]
        self.labels: list[int] = [0]
        self.shares: dict[int, float] = {}  # of texts: how much is linked
        self.lines: set[int] = set()  # elements that are a line or paragraph of what is around them
        stack: list[tuple[str, int]] = [("root", 0)]
        buffer: list[str] = []
        linked = 0
        in_link = 0
        silent: str | None = None
        inner: dict[str, int] = {}  # open elements within the silent one
        deeper = 0  # open elements below DEPTH

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(unescape("".join(buffer)).split())
                if text:
                    self._leaf(text, stack[-1][1], min(1.0, linked / len(text)))
                buffer.clear()
            linked = 0

        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if silent is None:
                piece = html[at : m.start() if m else n]
                if piece:
                    buffer.append(piece)
                    if in_link:
                        linked += len(piece)
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            if not m[4] and (end := html.find(">", m.start())) >= 0:
                at = end + 1  # a quote left open: the tag ends as if there were none
            name = name.lower()
            if silent is not None:
                if name in RAW and not m[1] and not m[3].endswith("/"):
                    at = _close(html, name, at)
                elif m[1]:
                    if inner.get(name):
                        inner[name] -= 1
                    elif name == silent:
                        silent = None
                    elif any(name == x for x, _ in stack[1:]):
                        silent = None  # the end of a parent is the end of an element left open
                elif name in ITEMS and stack[-1][0] in CLOSES[name] and not any(inner.get(x) for x in BLOCK):
                    silent = None  # and so is the start tag that ends the parent
                elif name not in VOID and not m[3].endswith("/") and not (name == silent and name in FLAT):
                    inner[name] = inner.get(name, 0) + 1
                if silent is not None or name in SILENT:
                    continue
            if m[1]:
                if name == "a":
                    in_link = 0
                elif name in BLOCK:
                    flush()
                    if deeper:
                        deeper -= 1
                        continue
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            del stack[k:]
                            break
                continue
            if name in RAW:
                at = _close(html, name, at)  # inside a word it doesn't part it
            elif name in SILENT:
                if not m[3].endswith("/"):
                    silent, inner = name, {}
            elif name == "a":
                in_link = 1
            elif name == "br":
                buffer.append(" ")
            elif name in BLOCK:
                flush()
                ends = CLOSES.get(name, {"p"})
                while len(stack) > 1 and stack[-1][0] in ends:
                    stack.pop()
                marks = [next(filter(None, x), "") for x in _MARKS.findall(m[3])] if m[3] else []
                self.parent.append(stack[-1][1])
                own = ([] if name in ("html", "body", "div") else ["tag=" + name]) + ["mark=" + w for w in dict.fromkeys(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(marks)).lower()))]
                if m[3] and _UNSEEN.search(m[3]):
                    own.append("unseen")
                self.features.append(own)
                self.texts.append(None)
                y = self.labels[stack[-1][1]]
                if labelled and (found := _LABEL.search(m[3])):
                    y = int(found[1])
                self.labels.append(y)
                if name in LINES:
                    self.lines.add(len(self.parent) - 1)
                if name not in VOID:
                    if len(stack) < DEPTH:
                        stack.append((name, len(self.parent) - 1))
                    else:
                        deeper += 1
        flush()
        self._sum_up()

    def _sum_up(self) -> None:
        """Features of texts from the element around their own: how much of it is linked, and how many long texts it holds."""
        n = len(self.parent)
        size, linked, prose = [0] * n, [0.0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            text = self.texts[k]
            if text is not None:
                size[k], linked[k] = len(text), len(text) * self.shares[k]
                prose[k] = int(self.features[k][0] == "text=20" and self.shares[k] < 0.2)
            up = self.parent[k]
            size[up] += size[k]
            linked[up] += linked[k]
            prose[up] += prose[k]
        for k in self.shares:
            around = self.parent[k]
            if around in self.lines:
                around = self.parent[around]
            share = linked[around] / size[around]
            self.features[k] += ["prose=" + str(min(prose[around], 4)), "links=" + ("0" if share < 0.2 else "1" if share < 0.6 else "2")]

    def _leaf(self, text: str, parent: int, linked: float) -> None:
        n = text.count(" ") + 1
        size = "1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20"
        self.parent.append(parent)
        self.features.append(["text=" + size, "linked=" + ("0" if linked < 0.2 else "1" if linked < 0.7 else "2")])
        self.texts.append(text)
        self.labels.append(self.labels[parent])
        self.shares[len(self.parent) - 1] = linked


def _forest(trees: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents (a root is its own), levels, and each tree's first node."""
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    base = np.cumsum(sizes) - sizes
    parent = np.fromiter((p for t in trees for p in t.parent), np.int64, int(sizes.sum())) + np.repeat(base, sizes)
    level: list[int] = []
    for t in trees:
        own = [0] * len(t.parent)
        for k in range(1, len(own)):
            own[k] = own[t.parent[k]] + 1
        level += own
    parent[base] = base
    return parent, np.array(level, np.int64), base


#: Labelled pages that are put together for training.
PAGES = 960


class Model:
    """Log potentials: of features (content minus boilerplate), and of (parent state, child state).

    Fitted to labelled pages by gradient steps on the exact log likelihood:
    observed minus expected counts, the expectations from the same messages.
    """

    STEPS, RATE, PULL = 200, 0.5, 0.002
    #: To begin with, boilerplate holds no content: that is how pages are labelled.
    APART = -8.0
    #: Features of text alone are held back: where a text stands says more.
    TEXT_PULL = 0.01

    def __init__(self, pages: list[str]):
        trees = [Page(h, labelled=True) for h in pages]
        for t in trees:  # what holds content is content itself; boilerplate may stand in it
            for k in range(len(t.parent) - 1, 0, -1):
                t.labels[t.parent[k]] |= t.labels[k]
        parent, level, _ = _forest(trees)
        y = np.fromiter((v for t in trees for v in t.labels), np.float64, len(parent))
        number: dict[str, int] = {}
        node, feature = [], []
        for k, own in enumerate(f for t in trees for f in t.features):
            for f in own:
                node.append(k)
                feature.append(number.setdefault(f, len(number)))
        node, feature = np.array(node), np.array(feature)
        seen = np.maximum(1, np.bincount(feature, minlength=len(number)))
        w = np.zeros(len(number))
        self.edge = np.array([[0.0, self.APART], [0.0, 0.0]])
        child = np.flatnonzero(level > 0)
        observed = np.zeros((2, 2))
        np.add.at(observed, (y[parent[child]].astype(int), y[child].astype(int)), 1)
        pull = np.array([self.TEXT_PULL if f.startswith(("text=", "linked=", "prose=", "links=")) else self.PULL for f in number])
        pace_w, pace_e = np.full(len(number), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(self.STEPS):
            odds, pairs = self.marginals(parent, level, np.bincount(node, w[feature], len(parent)), pairs=True)
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            g = np.bincount(feature, (y - p)[node], len(number)) / seen - pull * w
            e = (observed - pairs) / max(1, len(child)) - self.PULL * self.edge
            pace_w += g * g
            pace_e += e * e
            w += self.RATE * g / np.sqrt(pace_w)
            self.edge += self.RATE * e / np.sqrt(pace_e)
        self.weight = {f: float(w[k]) for f, k in number.items()}

    def marginals(self, parent: np.ndarray, level: np.ndarray, unary: np.ndarray, pairs: bool = False):
        """Log odds of content for every node of a forest: sum-product up, then down, a level at a time.

        With pairs also the expected number of (parent state, child state) pairs.
        """
        belief = np.zeros((len(parent), 2))
        belief[:, 1] = unary
        up = np.zeros_like(belief)
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(level.max() + 2 if len(level) else 1))
        tiers = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for nodes in reversed(tiers[1:]):
            up[nodes] = np.logaddexp(self.edge[:, 0] + belief[nodes, :1], self.edge[:, 1] + belief[nodes, 1:])
            np.add.at(belief, parent[nodes], up[nodes])
        expected = np.zeros((2, 2))
        for nodes in tiers[1:]:
            rest = belief[parent[nodes]] - up[nodes]  # the parent without this child
            if pairs:
                joint = rest[:, :, None] + self.edge + belief[nodes][:, None, :]
                joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            down = np.logaddexp(rest[:, :1] + self.edge[0], rest[:, 1:] + self.edge[1])
            belief[nodes] += down
        odds = belief[:, 1] - belief[:, 0]
        return (odds, expected) if pairs else odds

    def extract(self, pages: list[str]) -> list[str]:
        trees = [Page(h) for h in pages]
        if not trees:
            return []
        parent, level, base = _forest(trees)
        get = self.weight.get
        unary = np.fromiter((sum([get(f, 0.0) for f in own]) for t in trees for own in t.features), np.float64, len(parent))
        good = self.marginals(parent, level, unary) > 0
        return [" ".join([x for k, x in enumerate(t.texts) if x is not None and good[b + k]]) for t, b in zip(trees, base.tolist(), strict=True)]


def labelled_pages() -> list[str]:
    """Labelled pages: y=1 marks content and y=0 boilerplate, for an element and what it holds.

    Layouts are combined from parts, so that tags and class words appear in
    many settings; the words themselves play no role.
    """
    long = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. " * 2
    short, title = "Ut enim ad minim veniam.", "Duis aute irure dolor"
    links = lambda tag: "".join(f"<{tag}><a href='/{k}'>link {k}</a></{tag}>" for k in range(5))
    content = [
        f"<h1>{title}</h1><p>{long}</p><p>{short}</p><p>{long}</p>",
        f"<h1>{title}</h1><h2>{title}</h2><p>{long}</p><ul><li>{short}</li><li>{long}</li></ul><p>One.</p>",
        f"<header><h1>{title}</h1></header><p>{long}</p><blockquote><p>{short}</p></blockquote><pre>{short}</pre><p>{long}</p>",
        f"<h2>{title}</h2><div><p>{short}</p><p>{long}</p></div><table><tr><th>One</th><td>{short}</td></tr></table><p>{long}</p>",
        f"<section><h2>{title}</h2><p>{long}</p></section><figure><figcaption>{short}</figcaption></figure><ol><li>{long}</li></ol>",
        f"<p>{short}</p>", f"<h1>{title}</h1><p>{title}</p>", f"<div>{long}</div><div>{short}</div>",
        f"<h1>{title}</h1>" + f"<p>{title}</p>" * 60, f"<p>{long.strip(' .')}</p>" * 40 + "<p>One</p>" * 20 + "<p>One.</p>" * 80, f"<h1>{title}</h1><p>{title} and more of it, {title}</p>" * 30,
        f"<h1>{title}</h1>" + f"<p>{long}</p>" * 5, f"<p>{long}</p>" * 4 + f"<h2>{title}</h2><p>{short}</p>" + f"<p>{long}</p>" * 3, f"<h1>{title}</h1><p>{short} <a href='/x'>link</a> {long}</p><p>{long}</p><p>{short}</p><p>{long}</p>", f"{long}<br><br>{long}<br><br>{long}",
    ]
    hosts = ["<article y=1>{}</article>", "<main y=1>{}</main>", '<div class="content" y=1>{}</div>', '<div id="main-content" y=1>{}</div>', '<div class="post entry" y=1>{}</div>', '<main y=1><article class="post">{}</article></main>', '<section class="article body" y=1>{}</section>', '<div class="article-body story text" y=1>{}</div>']
    # structure and text alone have to do here
    plain = ["<div y=1>{}</div>", "<div y=1><div>{}</div></div>", '<div class="{0}" y=1>{{}}</div>', "<section y=1>{}</section>", '<div id="{0}" y=1><div class="{0}">{{}}</div></div>', "<table y=1><tr><td>{}</td></tr></table>"]
    strange = ["zq", "kwu", "vvx", "ozt", "jyq", "wrrk"]
    tops = [
        f"<nav><ul>{links('li')}</ul></nav>", f'<header><div class="logo">Site</div><nav>{links("p")}</nav></header>', f'<div class="menu"><ul class="menu-list">{links("li")}</ul></div>',
        f'<div class="header" id="top"><p>{short}</p></div>', f'<div class="nav navbar navigation">{links("div")}</div>', f'<div class="breadcrumb breadcrumbs">{links("span")}</div>',
        f'<div class="cookie-notice cookie consent"><p>{long}</p></div>', f'<div class="notice banner alert popup modal" role="dialog"><p>{short}</p></div>',
    ]
    tails = [
        f"<footer><p>{short}</p>{links('p')}</footer>", f'<aside class="sidebar"><h3>{title}</h3><p>{long}</p><ul>{links("li")}</ul></aside>', f'<div class="sidebar widget"><p>{long}</p></div>', f'<div id="footer" class="footer"><p>{long}</p></div>',
        f'<div class="ad">{short}</div>', f'<div class="ads advert advertisement sponsor sponsored promo"><p>{long}</p></div>', f'<form><label>{title}</label><p>{short}</p></form>', f'<div class="newsletter subscribe signup"><form><p>{short}</p></form></div>',
        f'<div class="share social">{links("li")}</div>', f"<footer>{'<p>One.</p>' * 12}</footer>", f'<section class="related recommended"><h2>{title}</h2><ul>{links("li")}</ul></section>', f'<div class="copyright legal">{short}</div>',
    ]
    more = [
        f'<div id="disqus_thread" class="disqus"><p>{long}</p></div>', f'<section class="discussion"><div class="remark"><p>{long}</p></div></section>', f'<div class="pagination pager"><span>1</span> <a href="/2">2</a> <a href="/3">3</a></div>', f'<div role="contentinfo"><p>{short}</p></div>',
        f'<div role="complementary"><p>{long}</p></div>', f'<div role="navigation">{links("p")}</div>', f'<div role="banner"><p>{title}</p></div>', f'<div class="feedback reviews review"><p>{long}</p></div>', f'<div role="search" class="search searchbox"><p>{title}</p></div>', f'<div class="gdpr privacy overlay">{long}</div>',
        f'<div class="author bio about"><p>{short}</p></div>', f'<div class="trending popular latest more"><h3>{title}</h3>{links("div")}</div>', f'<div class="tags tag categories">{links("span")}</div>', f'<div class="toolbar tools print">{links("span")}</div>', f'<p hidden>{long}</p>', f'<div style="display:none"><p>{long}</p></div>',
        f'<div class="foot bottom">{long}</div>', f'<div class="subnav topbar sidenav toc">{links("li")}</div>', f'<div class="paywall login register"><p>{short}</p></div>', f"<div>{links('li')}</div>", f"<ul>{links('li')}</ul>", f"<table><tr><td>{links('p')}</td></tr></table>", f"<p>{links('span')}</p>",
    ]
    tails += more
    inner = [
        f'<section class="comments" y=0><h3>{title}</h3><div class="comment"><p>{long}</p></div><div class="comment reply"><p>{short}</p></div></section>', f'<div id="comments" class="comment-list responses" y=0><ol><li class="comment"><p>{long}</p></li></ol></div>',
        f'<aside y=0><p>{long}</p></aside>', f'<div class="ad" y=0>{long}</div>', f'<form y=0><label>{title}</label><p>{long}</p></form>', f'<footer y=0><p>{short}</p></footer>', f'<nav y=0>{links("li")}</nav>', f'<div class="share social" y=0>{links("li")}</div>', "", "", "", "",
    ]
    # any of the surroundings may also stand inside the content
    inner += [re.sub(r"^<(\w+)", r"<\1 y=0", part) for part in tops + tails]
    # of several class words now and then only one
    def one(part: str, k: int) -> str:
        return re.sub(r'class="([^"]*)"', lambda m: f'class="{m[1].split()[k % len(m[1].split())]}"', part)

    inner += ["<form y=0><p>" + long + "</p></form>", "<form y=0>" + short + "</form>", "<aside y=0>" + long + "</aside>"]
    for tag in ("section", "div", "aside", "ol"):
        for mark in ("class=comments", "id=comments", "class=comment", "class=replies"):
            inner += [f"<{tag} {mark} y=0><h3>{title}</h3><p>{long}</p></{tag}>", f"<{tag} {mark} y=0><p>{short}</p><p>{long}</p></{tag}>"]
    surroundings = inner[:]
    for k in range(4):
        inner += [one(part, k) for part in surroundings if part.count(" ") and 'class="' in part]
    out = []
    pick = random.Random(7)
    for k in range(PAGES):
        body = pick.choice(content)
        host = pick.choice(hosts) if k % 2 else pick.choice(plain).replace("{0}", pick.choice(strange)).replace("{{}}", "{}")
        if k % 3:
            page = pick.choice([*tops, "", ""]) + host.format(body + pick.choice(["", "", pick.choice(inner)])) + pick.choice([*tails, ""]) + pick.choice([*tails, ""])
        else:
            page = host.format(body + pick.choice(inner) + pick.choice(["", pick.choice(inner) + pick.choice(content)]))
        page = one(page, pick.randrange(6)) if k % 3 == 2 else page
        out.append(f"<html><body>{'<div>' * (k % 4)}{page}{'</div>' * (k % 4)}</body></html>" if k % 5 else page)
    return out


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = model.value.extract([h or "" for h in part.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "url")], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


@lru_cache(maxsize=1)
def fitted() -> Model:
    """The model of the built-in labelled pages, fitted once for a process."""
    return Model(labelled_pages())


def main_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """page_id, url and text of every page; the model is fitted on the driver from a fixed number of labelled pages."""
    model = Model(labelled) if labelled else fitted()
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(partial(_extract, model=shared), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
