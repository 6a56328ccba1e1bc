"""HTML extraction by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path. A path's text ratio is its
text length over its number of nodes, its punctuation ratio its punctuation marks over its
nodes. Both are laid out over the nodes in document order and smoothed by a Gaussian window
along those of the same parent path, so that a heading gains from the paragraphs beside it
in the tree, and a footer that only follows them in the document doesn't. They are scaled by
their largest value and fused, with the text ratio of the parent, by their geometric mean. A path is content if the mean
fused value of its nodes is at least THRESHOLD times the mean over all of the page's text, and
all nodes of content paths are given back in order, block elements on lines of their own.

Defined cases: a null page gives a null text, a page without text (empty, tags only) an empty one;
markup that is never closed is taken as it stands; scripts, styles and comments are no text;
an attribute's quotation mark that is never closed ends quoting for the rest of the page; repeated rows and
ties are each treated alone; names that clash get underscores appended; pages are used whole, whatever their
length or depth: a path is a number, that of its parent's and the tag, so that all is linear in the page.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.shared import free_name, prepare

THRESHOLD = 0.7
SMOOTHING = 1.5
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)", re.S | re.I)
#: What follows a tag's name: with quoted values, or without where a quotation mark is never closed.
QUOTED, PLAIN = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"), re.compile(r"([^>]*+)(?:>|\Z)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var".split())
#: An element that begins ends these, if they are open and nothing of the other kind lies between.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"} | dict.fromkeys("div article section ul ol table h1 h2 h3 h4 h5 h6 nav header footer aside main form pre blockquote".split(), "p")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…、。，！？]")
SPACE = re.compile(r"\s+")


class Node(NamedTuple):
    path: int
    parent: int
    block: int
    text: str


def text_nodes(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Text nodes in document order, with their path, its parent and the block they are in; and (parent, last tag)
    of each path by number. Inline elements are no part of a path; path 0 is the page."""
    out: list[Node] = []
    paths, number = [(0, "")], {}
    # tag, path, and where on the stack the innermost element that isn't inline lies (-1: nowhere)
    stack: list[tuple[str, int, int]] = []
    opened: Counter[str] = Counter()
    at = block = pos = 0
    tail = QUOTED

    def add(raw: str) -> None:
        text = SPACE.sub(" ", htmllib.unescape(raw))
        if text.strip() and not (opened["title"] or opened["head"]):
            path = stack[-1][1] if stack else 0
            out.append(Node(path, paths[path][0], block, text))

    while m := TOKEN.search(page, pos):
        if m.start() > at:
            add(page[at : m.start()])
        at = pos = m.end()
        if m.group(2):
            add(m.group(2))
        tag = (m.group(4) or "").lower()
        if not tag:
            continue
        if not (rest := tail.match(page, pos)):
            tail = PLAIN
            rest = tail.match(page, pos)
        at = pos = rest.end()
        block += tag not in INLINE
        if m.group(3):
            if opened[tag]:
                while (t := stack.pop()[0]) != tag:
                    opened[t] -= 1
                opened[tag] -= 1
        elif tag not in VOID and not rest[1].endswith("/"):
            for t in ENDS.get(tag, "").split():
                k = stack[-1][2] if stack else -1
                if k >= 0 and stack[k][0] == t:
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
            path, base = stack[-1][1:] if stack else (0, -1)
            if tag not in INLINE:
                if (path, tag) not in number:
                    number[path, tag] = len(paths)
                    paths.append((path, tag))
                path, base = number[path, tag], len(stack)
            stack.append((tag, path, base))
            opened[tag] += 1
    if at < len(page):
        add(page[at:])
    return out, paths


def smooth(x: np.ndarray, sigma: float = SMOOTHING) -> np.ndarray:
    """Gaussian window mean; the window is cut, and weighed anew, at the ends."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[r : r + len(x)] / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def select(nodes: list[Node], threshold: float = THRESHOLD, sigma: float = SMOOTHING) -> np.ndarray:
    """Which nodes are content."""
    if not nodes:
        return np.zeros(0, bool)
    _, path = np.unique([n.path for n in nodes], return_inverse=True)
    _, parent = np.unique([n.parent for n in nodes], return_inverse=True)
    length = np.array([len(n.text.strip()) for n in nodes], np.float64)
    marks = np.array([len(PUNCTUATION.findall(n.text)) for n in nodes], np.float64)
    count = np.bincount(path)
    ratios = [(np.bincount(path, v) / count)[path] for v in (length, marks)]
    order = np.argsort(parent, kind="stable")
    for beside in np.split(order, np.cumsum(np.bincount(parent))[:-1]):
        if len(beside) > 1:  # one alone is its own mean
            for r in ratios:
                r[beside] = smooth(r[beside], sigma)
    ratios.append((np.bincount(parent, length) / np.bincount(parent))[parent])
    a, b, c = (r / max(r.max(), 1e-12) for r in ratios)
    fused = np.cbrt(a * (b + 0.05) / 1.05 * c)
    by_path = np.bincount(path, fused) / count
    level = (fused * length).sum() / max(length.sum(), 1e-12)
    return (by_path >= threshold * level)[path]


def extract(page: str | None, threshold: float = THRESHOLD, sigma: float = SMOOTHING) -> tuple[str | None, int, int]:
    """(content, number of text nodes, number of content nodes) of a page."""
    if page is None:
        return None, 0, 0
    nodes, _ = text_nodes(page)
    chosen = select(nodes, threshold, sigma)
    parts: list[str] = []
    before = None
    for k in np.flatnonzero(chosen):
        parts += ["\n" if before is not None and nodes[k].block != before else "", nodes[k].text]
        before = nodes[k].block
    lines = (SPACE.sub(" ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x), len(nodes), int(chosen.sum())


def extract_pages(pages: DataFrame, threshold: float = THRESHOLD, sigma: float = SMOOTHING, html_col: str = "html") -> DataFrame:
    """``pages`` with ``content``, ``nodes`` and ``content_nodes`` in place of the markup."""
    prepare(pages.sparkSession)

    @F.pandas_udf("content string, nodes int, content_nodes int")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h, threshold, sigma) for h in html], columns=["content", "nodes", "content_nodes"])

    name = free_name(pages, "__extracted")
    out = pages.withColumn(name, run(F.col(f"`{html_col}`")))
    kept = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    return out.select(*kept, *[F.col(f"{name}.{c}").alias(free_name(pages, c)) for c in ("content", "nodes", "content_nodes")])
