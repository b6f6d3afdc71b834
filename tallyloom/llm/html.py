"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is content or boilerplate.  A node's own potential comes
from its tag, its class and id names, the length and link share of its text, and its place on the page; a potential on
every edge couples parent and child.  Sum-product messages go up and down the tree once and give each node's
marginal exactly.  The weights are fitted on labelled pages by gradient ascent on the likelihood, whose gradient
needs the same messages.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.labelled_pages import labelled_pages

BLOCKS = frozenset(
    "html head body title article main section div nav header footer aside menu dialog form fieldset legend label select option button textarea h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd "
    "blockquote pre table caption thead tbody tfoot tr td th figure figcaption address details summary hr center iframe object video audio canvas svg noscript template".split()
)
HIDDEN = frozenset(("script", "style", "head", "title", "noscript", "template", "iframe", "object", "svg", "canvas"))  # never text of a page
VOID = frozenset(("hr",))
ENDS_P = BLOCKS - {"label", "button", "select", "option", "iframe", "object", "video", "audio", "canvas", "svg", "noscript", "template"}
#: Elements that the next of their kind ends, by kind, unless an element in ``SCOPES`` stands between.
KIND = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
NONE = (-1,) * 6
SCOPES = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "body"}
#: Elements skipped with all they hold; without an end tag the first four take the rest of the page, the others nothing.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "iframe", "noscript", "template", "svg")}
SWALLOWS = ("script", "style", "textarea", "iframe")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")  # quotes count directly behind an equals sign only
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Blocks that make up running text; they repeat without being a list of anything.
PLAIN = frozenset("p li h1 h2 h3 h4 h5 h6 tr td th dt dd blockquote pre thead tbody tfoot figure figcaption caption hr option".split())
CORE = 0.6  # the core of a page is reached by going down while one child holds this share of the unlinked text
LABEL = re.compile(r"data-y=['\"]?([01])")
PARTS = re.compile(r"[a-z]+")
STEPS, RATE, DECAY = 150, 0.5, 1e-3


@dataclass
class Page:
    parent: list[int]
    depth: list[int]
    tag: list[str]
    attributes: list[str]
    chars: list[int]  # of a node's own text
    linked: list[int]  # of them inside links
    segments: list[tuple[int, str]]  # node, text; in page order


def self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is not the end of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    start = len(attributes) - 1
    while start and attributes[start - 1] not in " \t\r\n\f\"'":
        start -= 1
    return "=" not in attributes[start:] and not attributes[:start].rstrip().endswith("=")


def parse(source: str | None) -> Page:
    """Block tree of a page, in one pass whose time is proportional to the page's length.

    Inline tags vanish, ``br`` is white space, end tags without a start are ignored, and unclosed elements end with their
    parent or, like ``p`` and ``li``, with the next of their kind.  A tag whose end is missing because of a quote ends at
    the first ``>``, and so do all later ones; without any ``>`` it is text.
    """
    page = Page([-1], [0], ["#page"], [""], [0], [0], [])
    stack, near, pieces, in_link = [0], [NONE], [], 0
    opened: dict[str, int] = {}
    source = source or ""

    def text(low: int, high: int) -> None:
        if low < high:
            raw = source[low:high]
            raw = references.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            n = len(raw) - raw.count(" ")
            page.chars[stack[-1]] += n
            page.linked[stack[-1]] += n * (in_link > 0)

    def flush() -> None:
        if pieces:
            segment = " ".join("".join(pieces).split())
            if segment:
                page.segments.append((stack[-1], segment))
            pieces.clear()

    def close(depth: int) -> None:
        nonlocal in_link
        flush()
        for i in stack[depth:]:
            opened[page.tag[i]] -= 1
        del stack[depth:], near[depth:]
        in_link = 0

    last, size = source.rfind(">"), len(source)
    at = shown = 0  # where to look for the next tag, and what text is not taken yet
    blunt, endless = False, set()
    while (low := source.find("<", at)) >= 0 and low < last:
        m = TAG.match(source, low)
        if m is None:
            if source.startswith("<!--", low):
                high = source.find("-->", low + 4)
                high = size if high < 0 else high + 3
            elif source[low + 1] in "!?":
                high = source.find(">", low) + 1
            else:  # a bare sign
                at = low + 1
                continue
            text(shown, low)
            at = shown = high
            continue
        high = size if blunt else ATTRIBUTES.match(source, m.end()).end()
        if high >= size:
            blunt = True
            high = source.find(">", m.end())
        text(shown, low)
        at = shown = high + 1
        tag, attributes, ends = m[2].lower(), source[m.end() : high], bool(m[1])
        if tag in RAW and not ends:
            if tag == "svg" and self_closed(attributes):
                continue
            stop = None if tag in endless else RAW[tag].search(source, at)
            if stop is not None:
                high = source.find(">", stop.end())
                at = shown = size if high < 0 else high + 1
            else:
                endless.add(tag)
                if tag in SWALLOWS:
                    at = shown = size
            continue
        if tag not in BLOCKS:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = 0 if ends else 1
            continue
        if ends:
            if opened.get(tag):
                i = len(stack) - 1
                while page.tag[stack[i]] != tag:
                    i -= 1
                close(i)
            continue
        flush()
        if tag in ENDS_P and near[-1][0] >= 0:
            close(near[-1][0])
        kind = KIND.get(tag, 0)
        if kind == 3:  # a row ends the row before it, or a cell without a row
            before = near[-1][3] if near[-1][3] >= 0 else near[-1][4]
        else:
            before = near[-1][kind] if kind else -1
        if before >= 0:
            close(before)
        page.parent.append(stack[-1])
        page.depth.append(len(stack))
        page.tag.append(tag)
        page.attributes.append(attributes)
        page.chars.append(0)
        page.linked.append(0)
        if tag not in VOID:
            around = NONE if tag in SCOPES else near[-1]
            near.append((*around[: KIND[tag]], len(stack), *around[KIND[tag] + 1 :]) if tag in KIND else around)
            stack.append(len(page.parent) - 1)
            opened[tag] = opened.get(tag, 0) + 1
    text(shown, size)
    flush()
    return page


def names(page: Page, i: int) -> list[str]:
    """What a node shows: its tag, its parent's, and the parts of its class, id and role names."""
    out = [page.tag[i], "in " + page.tag[page.parent[i]] if page.parent[i] >= 0 else "top"]
    if page.attributes[i]:
        for m in NAMES.finditer(page.attributes[i]):
            out += ["." + part for part in PARTS.findall((m[1] or m[2] or m[3] or "").lower())]
    return out


def amounts(page: Page) -> np.ndarray:
    """Numbers of every node that do not depend on names.

    Of its own text: length, link share, what kind of length.  Of all text below it: share of the page, link share, length
    per block, where on the page it begins and ends.  Of its place: inside, above, before or behind the core of the page and the
    ``article`` or ``main`` elements, and whether its siblings, or its children, repeat one shape.
    """
    n = len(page.parent)
    own, linked = np.array(page.chars, float), np.array(page.linked, float)
    below, below_linked, blocks, size = own.tolist(), linked.tolist(), [1.0] * n, [1] * n
    shape: list[set[str]] = [set() for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        below[p] += below[i]
        below_linked[p] += below_linked[i]
        blocks[p] += blocks[i]
        size[p] += size[i]
        shape[p].add(page.tag[i])
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        kids[page.parent[i]].append(i)
    plain = [b - l for b, l in zip(below, below_linked)]
    core = 0
    while True:
        best = max((k for k in kids[core] if page.tag[k] not in PLAIN), key=lambda k: plain[k], default=None)
        if best is None or plain[best] < CORE * plain[core] or not plain[best]:
            break
        core = best
    mains = [i for i in range(n) if page.tag[i] in ("article", "main")]
    repeats, holds = np.zeros(n), np.zeros(n)
    for p in range(n):
        seen: dict[tuple, list[int]] = {}
        for k in kids[p]:
            if page.tag[k] not in PLAIN:
                seen.setdefault((page.tag[k], frozenset(shape[k])), []).append(k)
        for alike in seen.values():
            if len(alike) > 1:
                repeats[alike] = 1
                holds[p] = 1

    def place(roots: list[int]) -> list[np.ndarray]:
        """Inside, above, and behind any of some nodes; zeros without any."""
        inside, above, behind = np.zeros(n), np.zeros(n), np.zeros(n)
        for r in roots:
            if inside[r]:
                continue
            inside[r : r + size[r]] = 1
            behind[r + size[r] :] = 1
            while (r := page.parent[r]) >= 0 and not above[r]:
                above[r] = 1
        return [inside, above * (1 - inside), behind * (1 - inside)]

    total = max(below[0], 1.0)
    below, below_linked, blocks = np.array(below), np.array(below_linked), np.array(blocks)
    begins = (np.cumsum(own) - own) / total
    share = below / total
    there = np.full(n, float(bool(mains)))
    in_core, in_main = place([core]), place(mains[:50])
    return np.stack(
        [
            np.ones(n), np.log1p(own) / 4, linked / np.maximum(own, 1), (own > 80) * 1.0, (own == 0) * 1.0,
            share, below_linked / np.maximum(below, 1), (below_linked > 0.5 * below) * 1.0, np.log1p(below) / 6, np.log1p(below / blocks) / 5, begins, begins + share,
            *in_core, *in_main, there * (1 - in_main[0]) * (1 - in_main[1]), repeats, holds, repeats * in_core[2], repeats * in_core[0],
        ],
        axis=1,
    )


def sum_product(parent: np.ndarray, depth: np.ndarray, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all nodes of a forest and of all edges (parent state, child state), from log potentials.

    Messages run level by level: up from the deepest nodes, then down from the roots.
    """
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    levels = np.split(order, cuts)
    up, message = own.copy(), np.zeros_like(own)
    for level in reversed(levels[1:]):
        message[level] = np.logaddexp(up[level, :1] + edge[:, 0], up[level, 1:] + edge[:, 1])
        np.add.at(up, parent[level], message[level])
    down = np.zeros_like(own)
    pair = np.zeros((len(own), 2, 2))
    for level in levels[1:]:
        above = up[parent[level]] + down[parent[level]] - message[level]
        joint = above[:, :, None] + edge[None]
        down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint = joint + up[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        pair[level] = np.exp(joint) / np.exp(joint).sum(axis=(1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    numbers: np.ndarray
    edge: np.ndarray


def forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents (numbered over all pages), depths, and first node of each page."""
    starts = np.cumsum([0, *(len(p.parent) for p in pages)])
    parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, starts)])
    return parent, np.concatenate([p.depth for p in pages]), starts


def train(sources: list[str]) -> Model:
    """Fit on pages whose elements carry ``data-y``; what has none takes its parent's label."""
    pages = [parse(s) for s in sources]
    parent, depth, _ = forest(pages)
    y = []
    for p in pages:
        own: list[int] = []
        for i, a in enumerate(p.attributes):
            m = LABEL.search(a)
            own.append(int(m[1]) if m else (own[p.parent[i]] if i else 0))
        y += own
    y = np.array(y)
    shown = [names(p, i) for p in pages for i in range(len(p.parent))]
    number = {w: k for k, w in enumerate(sorted({w for s in shown for w in s}))}
    row = np.repeat(np.arange(len(shown)), [len(s) for s in shown])
    col = np.array([number[w] for s in shown for w in s])
    x = np.concatenate([amounts(p) for p in pages])
    words, numbers, edge = np.zeros(len(number)), np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = [np.full(len(number), 1e-6), np.full(x.shape[1], 1e-6), np.full((2, 2), 1e-6)]
    kids = np.flatnonzero(depth > 0)
    truth = np.zeros((2, 2))
    np.add.at(truth, (y[parent[kids]], y[kids]), 1)
    for _ in range(STEPS):
        own = np.zeros((len(y), 2))
        own[:, 1] = np.bincount(row, words[col], len(y)) + x @ numbers
        p, pair = sum_product(parent, depth, own, edge)
        miss = y - p
        grads = [np.bincount(col, miss[row], len(number)) - DECAY * len(y) * 0.1 * words, x.T @ miss, truth - pair[kids].sum(axis=0)]
        for value, g, s in zip((words, numbers, edge), grads, seen):
            s += g * g
            value += RATE * g / np.sqrt(s)
    return Model({w: float(words[k]) for w, k in number.items()}, numbers, edge)


def extract(model: Model, sources: list[str | None]) -> list[str]:
    """Texts of pages: the segments of nodes that are content more likely than not, one per line."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    parent, depth, starts = forest(pages)
    own = np.zeros((len(parent), 2))
    known: dict[tuple, float] = {}
    shown = []
    for p in pages:
        for i in range(len(p.parent)):
            key = (p.tag[i], p.tag[p.parent[i]] if i else "", p.attributes[i])
            if key not in known:
                known[key] = sum(model.words.get(w, 0.0) for w in names(p, i))
            shown.append(known[key])
    own[:, 1] = np.array(shown) + np.concatenate([amounts(p) for p in pages]) @ model.numbers
    content, _ = sum_product(parent, depth, own, model.edge)
    return ["\n".join(t for n, t in p.segments if content[s + n] > 0.5 and p.tag[n] not in HIDDEN) for p, s in zip(pages, starts)]


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id``, ``url``, ``text``, ``n_chars`` (code points).

    Null and empty pages, and pages without content, have an empty text; repeated rows give equal texts; pages are read
    whole; an empty table gives an empty result.  Other columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = extract(held.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
