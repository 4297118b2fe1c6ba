"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of elements. Each has a hidden label, content or not; the model has a potential for its
features given the label, and one for its label given its parent's. A sum-product pass from the leaves up and from
the root down, over all pages of a batch at once and depth by depth, gives every element's exact marginal. The text
of elements whose marginal is at least ``threshold`` is the page's content, one line for each block.

Potentials are counts with add-one smoothing over labelled pages: HTML whose content elements carry the attribute
``data-content``. ``LABELLED`` holds a small set in several layouts, written for this; ``extract`` takes any other, from a table too.

Defined cases: a null page gives null text and no elements; an empty page, or one without elements, gives "" ; text
outside any element belongs to an implied root; scripts, styles and comments are never content; unclosed and
stray tags are repaired by the usual rules; a page takes time in proportion to its length, whatever its tags; rows are handled one by one, so repeated pages or null ids change
nothing; other columns aren't read; an empty table gives none. Whole pages are read, whatever their size.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, only

NAME = re.compile(r"<(/?)([a-z][\w:-]*)", re.I)
#: Elements whose text isn't the page's. An unclosed script or style runs to the end, the others are then read as usual.
HIDDEN = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
CLOSES_ITSELF = frozenset("li dt dd tr td th option p".split())
TAGS = {t: i + 1 for i, t in enumerate("html head title body header nav aside footer main article section div p h1 h2 h3 ul ol li a span b i em strong table tr td form button label blockquote pre code figure figcaption dl dt dd small time".split())}
GOOD = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
BAD = re.compile(r"\bad\b|\bads\b|advert|banner|comment|cookie|foot|head|menu|nav|promo|related|share|side|social|sponsor|subscribe|widget", re.I)


@dataclass
class Tree:
    """Elements in document order; ``pieces`` are (element, text) in document order, "" for a line break."""

    parent: list[int]
    tags: list[str]
    hints: list[str]
    pieces: list[tuple[int, str]]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): ``open``, ``close`` and ``text``; one pass, in time that is linear in the page's length."""
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = NAME.match(page, lt)
        if m is None and page[lt + 1 : lt + 2] not in ("!", "?"):
            yield "text", "<", ""
            at = lt + 1
            continue
        gt = page.find(">", m.end() if m else lt + 2)
        if gt < 0:  # no later tag ends either
            yield "text", page[lt:], ""
            return
        at = gt + 1
        if m is None:
            continue
        name, more = m[2].lower(), page[m.end() : gt]
        if m[1]:
            yield "close", name, ""
            continue
        if name in HIDDEN and name not in unclosed:
            if more.endswith("/") and name == "svg":
                continue
            end = HIDDEN[name].search(page, at)
            if end or name in ("script", "style"):
                at = end.end() if end else size
                continue
            unclosed.add(name)
        yield "open", name, more


def parse(page: str) -> Tree:
    parent, tags, hints, pieces = [-1], [""], [""], []
    stack = [0]
    # for each open element, where on the stack a paragraph is that the next block would close, or 0; and how many are open by tag
    closable, count = [0], Counter()

    def pop_to(depth: int) -> None:
        for i in stack[depth:]:
            count[tags[i]] -= 1
        del stack[depth:], closable[depth:]

    for kind, tag, more in tokens(page):
        if kind == "text":
            if not tag.isspace():
                pieces.append((stack[-1], entities.unescape(tag)))
        elif kind == "open":
            if tag == "br":
                pieces.append((stack[-1], ""))
            if tag in VOID:
                continue
            if tag in CLOSES_ITSELF and tags[stack[-1]] == tag:
                pop_to(len(stack) - 1)
            elif tag in BLOCK and closable[-1]:
                pop_to(closable[-1])
            parent.append(stack[-1])
            if not more.endswith("/"):
                closable.append(len(stack) if tag == "p" else 0 if tag in BLOCK else closable[-1])
                stack.append(len(tags))
                count[tag] += 1
            tags.append(tag)
            hints.append(more)
        elif count[tag]:
            depth = len(stack) - 1
            while tags[stack[depth]] != tag:
                depth -= 1
            pop_to(depth)
    return Tree(parent, tags, hints, pieces)


FEATURES = (len(TAGS) + 1, 6, 6, 4, 4, 3)


def features(tree: Tree) -> np.ndarray:
    """Discrete features by element: tag, words of its own, words below, share of link words, pieces, hint in its attributes."""
    n = len(tree.parent)
    own, linked, count = np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = np.zeros(n, bool)
    for i in range(1, n):
        in_link[i] = tree.tags[i] == "a" or in_link[tree.parent[i]]
    for i, text in tree.pieces:
        words = text.count(" ") + 1 if text else 0
        own[i] += words
        linked[i] += words * in_link[i]
        count[i] += bool(text)
    below, below_linked = own.copy(), linked.copy()
    for i in range(n - 1, 0, -1):
        below[tree.parent[i]] += below[i]
        below_linked[tree.parent[i]] += below_linked[i]
    hint = [0 if not h or (g := bool(GOOD.search(h))) == (b := bool(BAD.search(h))) else 1 if g and not b else 2 for h in tree.hints]
    density = below_linked / np.maximum(below, 1)
    return np.stack(
        [[TAGS.get(t, 0) for t in tree.tags], np.digitize(own, [1, 4, 10, 25, 60]), np.digitize(below, [1, 6, 20, 60, 200]), np.digitize(density, [0.01, 0.3, 0.7]), np.minimum(count, 3), hint], 1
    ).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Logarithms: ``unary[f][value, label]``, ``edge[parent's label, label]``, ``root[label]``."""

    unary: tuple[np.ndarray, ...]
    edge: np.ndarray
    root: np.ndarray


LABELLED = (
    '<html><head><title>How to bake bread in a pot at home, step by step and without a machine</title></head><body><header><a href=/>Kitchen</a> <a href=/login>Log in</a></header><div id="content" data-content><h2 data-content>How to bake bread</h2><p data-content>Mix the flour, water, yeast and salt until no dry flour is left, and leave the dough to rest for an hour under a damp cloth.</p><p data-content><b data-content>Fold the dough four times during the first rise, then shape it, let it rest again, and heat the oven as hot as it goes with a heavy pot inside.</b><br>Bake it covered for half an hour.</p><ul data-content><li data-content>Use strong flour, or the loaf stays flat.</li><li data-content>Weigh everything, the water too.</li></ul></div><aside class="related"><h3>See also</h3><a href=/1>Ten quick soups</a><a href=/2>Rye for beginners</a></aside><div class="footer">Contact <a href=/m>us</a></div></body></html>',
    '<html><head><title>Walking the old salt road, part two</title></head><body class="single"><div id="wrapper"><header class="site-header"><a href=/>Salt and Stone</a><nav class="site-nav"><a href=/archive>Archive</a><a href=/maps>Maps</a><a href=/contact>Contact</a></nav></header><main data-content><article class="post" data-content><header data-content><h1 data-content>Walking the old salt road, part two</h1></header><div class="entry-content" data-content><p data-content>From the pass the road drops in wide bends to the first village, where the carts once changed horses and the drivers slept in the hay above the stables.</p><p data-content>We found the well that the old maps show. It is <em data-content>dry now</em>, and a fig tree grows out of it.<p data-content>Rain came in the afternoon.</div></article></main><aside class="widget-area"><h3>Recent posts</h3><ul><li><a href=/1>Packing light</a></li><li><a href=/2>Part one</a></li></ul></aside><footer class="site-footer"><p>Powered by patience. All photographs by the author unless a caption says otherwise.</p></footer></div></body></html>',
    '<html><head><title>Council agrees on the new bridge where the ferry used to land | The Daily Page</title></head><body><div class="menu"><a href=1>News</a><a href=2>Sport</a><a href=3>Weather</a></div><div class="story" data-content><h1 data-content>Council agrees on the new bridge</h1><div data-content>After two years of talks the council has agreed to build the bridge where the old ferry used to land, at a cost that is lower than first thought.</div><div data-content>Work starts in spring. Until then the ferry runs every hour, and the road on the east bank stays closed to heavy traffic.</div></div><div class="sidebar"><p>Subscribe to our letter and never miss a thing.</p><form><label>Mail</label><button>Send</button></form></div><div class="comments"><p>Great news!</p><p>About time.</p></div></body></html>',
    '<html><head><title>How to choose a kettle | Home and Hearth</title></head><body><div class="topbar"><span>Free delivery this week on all orders</span><a href=/sale>Shop now</a></div><ul class="breadcrumbs"><li><a href=/>Home</a></li><li><a href=/g>Guides</a></li></ul><section class="article-body" data-content><h1 data-content>How to choose a kettle</h1><p data-content><strong data-content>Weigh it when it is full.</strong> A litre of water weighs a kilogram, and a heavy kettle is soon left standing at the back of the cupboard.<br>Look at the spout next.</p><p data-content>A short spout pours fast, a long one pours where you want it to.</p></section><div class="banner">Sign up today and save on your first order.</div><nav class="pager"><a href=/p>Previous</a><a href=/n>Next</a></nav><footer>Prices include tax. Pictures may differ from the goods that are sent.</footer></body></html>',
    '<html><head><title>Install and use the tool - Handbook</title></head><body><main data-content><section data-content><h2 data-content>Install</h2><p data-content>Download the archive for your system and unpack it where you keep your programs, then add that folder to the search path.</p><pre data-content>tar xf tool.tar && ./tool --help</pre></section><section data-content><h2 data-content>Use</h2><p data-content>Give the tool a folder. It reads every file in it and prints one line for each that has changed since the last time it ran.</p></section></main><footer><ul><li><a href=/t>Terms</a></li><li><a href=/p>Privacy</a></li></ul></footer></body></html>',
    '<html><head><title>A short history of the town library</title></head><body><table><tr><td><a href=1>Index</a></td><td data-content><p data-content>The library opened in 1911 in two rooms above the bank, with eight hundred books that had been given by the people of the town.</p><blockquote data-content>It was cold, but there was nowhere else to read, wrote one of the first members in a letter.</blockquote></td></tr></table><small>Printed from the web.</small></body></html>',
    '<html><head><title>Minutes of the spring meeting</title></head><body><nav id="toc"><ol><li><a href="#a">Opening</a></li><li><a href="#b">Accounts</a></li></ol></nav><article data-content><h1 data-content>Minutes of the spring meeting</h1><h2 data-content>Opening</h2><p data-content>The chair opened the meeting at seven and thanked the members who had come in spite of the snow.</p><h2 data-content>Accounts</h2><p data-content>The treasurer read the accounts for the year, which were approved without a vote against.</p><table data-content><tr data-content><td data-content>Income</td><td data-content>two thousand and ten</td></tr></table></article><footer><a href=/imprint>Imprint</a> <a href=/top>Back to top</a> The society is a registered charity.</footer></body></html>',
)


def fit(pages: tuple[str, ...] = LABELLED) -> Model:
    """Counts over pages whose content elements have ``data-content``."""
    unary = [np.ones((size, 2)) for size in FEATURES]
    edge, root = np.ones((2, 2)), np.ones(2)
    for page in pages:
        tree = parse(page)
        label = np.array(["data-content" in h for h in tree.hints], int)
        tree.hints = [h.replace("data-content", "") for h in tree.hints]
        x = features(tree)
        for f, table in enumerate(unary):
            np.add.at(table, (x[:, f], label), 1)
        np.add.at(edge, (label[tree.parent[1:]], label[1:]), 1)
        root[label[0]] += 1
    return Model(tuple(np.log(t / t.sum(0)) for t in unary), np.log(edge / edge.sum(1, keepdims=True)), np.log(root / root.sum()))


def marginals(parent: np.ndarray, depth: np.ndarray, unary: np.ndarray, model: Model) -> np.ndarray:
    """P(content) of every node of a forest; a root has parent -1, ``unary`` are log potentials by label."""
    up = unary.copy()
    sent = np.zeros_like(unary)
    order = np.argsort(depth, kind="stable")
    layers = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))
    for rows in reversed(layers[1:]):
        sent[rows] = np.logaddexp(up[rows, :1] + model.edge[:, 0], up[rows, 1:] + model.edge[:, 1])
        np.add.at(up, parent[rows], sent[rows])
    down = np.zeros_like(unary)
    down[layers[0]] = model.root
    for rows in layers[1:]:
        rest = up[parent[rows]] + down[parent[rows]] - sent[rows]
        down[rows] = np.logaddexp(rest[:, :1] + model.edge[0], rest[:, 1:] + model.edge[1])
    both = up + down
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def _text(tree: Tree, content: np.ndarray) -> str:
    lines: list[list[str]] = [[]]
    block: dict[int, int] = {}

    def block_of(i: int) -> int:
        path = []
        while i > 0 and i not in block and tree.tags[i] not in BLOCK:
            path.append(i)
            i = tree.parent[i]
        own = block.get(i, i)
        for j in path:
            block[j] = own
        return own

    last = None
    for i, text in tree.pieces:
        if not content[i]:
            continue
        here = block_of(i)
        if here != last or not text:
            lines.append([])
        last = here
        lines[-1].append(text)
    return "\n".join(x for x in (" ".join("".join(line).split()) for line in lines) if x)


def extract_pages(pages: list[str | None], model: Model, threshold: float) -> list[tuple[str | None, int, int, float | None]]:
    """(text, elements, content elements, mean marginal of those) of each page; the batch shares the message passes."""
    trees = [None if p is None else parse(p) for p in pages]
    parent, depth, unary, first = [], [], [], [0]
    for tree in trees:
        if tree is not None:
            own = np.array(tree.parent)
            d = np.zeros(len(own), np.int64)
            for i in range(1, len(own)):
                d[i] = d[own[i]] + 1
            x = features(tree)
            parent.append(np.where(own < 0, -1, own + first[-1]))
            depth.append(d)
            unary.append(sum(t[x[:, f]] for f, t in enumerate(model.unary)))
            first.append(first[-1] + len(own))
        else:
            first.append(first[-1])
    p = marginals(np.concatenate(parent), np.concatenate(depth), np.concatenate(unary), model) if parent else np.zeros(0)
    out: list[tuple] = []
    for k, tree in enumerate(trees):
        if tree is None:
            out.append((None, 0, 0, None))
            continue
        own = p[first[k] : first[k + 1]]
        chosen = own >= threshold
        out.append((_text(tree, chosen), len(own) - 1, int(chosen.sum()), round(float(own[chosen].mean()), 6) if chosen.any() else None))
    return out


def extract(pages: DataFrame, threshold: float = 0.5, labelled: tuple[str, ...] | DataFrame = LABELLED, most_labelled: int = 5000) -> DataFrame:
    """(page_id, url, text, elements, content_elements, confidence) of every page.

    ``labelled`` are pages with ``data-content``, or a table with such in its column ``html``, of which the ``most_labelled`` with the
    smallest hashes are read: the model's few hundred counts need no more.
    """
    if isinstance(labelled, DataFrame):
        own = only(labelled, "html").where("html IS NOT NULL")
        labelled = tuple(r["html"] for r in own.orderBy(F.xxhash64("html"), "html").limit(most_labelled).toLocalIterator())
    model = fit(labelled)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                got = list(zip(*extract_pages(c.column("html").to_pylist(), model, threshold), strict=True))
                made = [pa.array(v, t) for v, t in zip(got, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column("page_id"), c.column("url"), *made], ["page_id", "url", "text", "elements", "content_elements", "confidence"])

    rows = only(pages, "page_id", "url", "html").selectExpr("cast(page_id AS long) page_id", "cast(url AS string) url", "cast(html AS string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, elements int, content_elements int, confidence double")
