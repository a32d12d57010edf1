"""HTML content extraction by a tree-structured graphical model.

Every element and every run of text of a page is a node with a hidden state, content or not. Each node
has evidence from its own features, and a potential connects it to its parent. Sum-product messages go
up the tree and down again, which gives every node's exact marginal; text whose marginal is above one
half is content. Evidence and potentials are trained from labelled pages.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_training import labelled_pages

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_LABEL = re.compile(r"\bdata-content\s*=\s*[\"']?([01])", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg")}
_BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_CLOSES = {"li": ("li", frozenset(("ul", "ol"))), "dd": ("dd", frozenset(("dl",))), "dt": ("dt", frozenset(("dl",))), "td": ("td", frozenset(("tr", "table"))), "th": ("th", frozenset(("tr", "table"))), "tr": ("tr", frozenset(("table",))), "option": ("option", frozenset(("select",)))}
_ENDS_P = _BLOCK - {"br", "body", "html", "head"}
_SCOPE = frozenset("article aside body div footer header html li main nav section table td th".split())
#: For an opening tag: lists of open elements that it adds to, with itself (True) or with a bar that hides those before it.
_WATCH: dict[str, list[tuple[str, bool]]] = {}
for _same, _scope in (("p", _SCOPE), *_CLOSES.values()):
    _WATCH.setdefault(_same, []).append((_same, True))
    for _tag in _scope - {_same}:
        _WATCH.setdefault(_tag, []).append((_same, False))

TAGS = {t: k for k, t in enumerate("#root #text html head body title article main section div span p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th a b i em strong u small code pre blockquote figure figcaption img br hr nav header footer aside form input button label select option script style noscript iframe".split())}
_OTHER = len(TAGS)
_HASHED = 64
_TEXT = 40
_ABOVE = _OTHER + 1 + _HASHED + _TEXT + _OTHER + 1  # hashed names of the parent of a run of text
WIDTH = _ABOVE + _HASHED
_MARKS = re.compile(r"[.!?](?=\s|$)|[,;:]")


@dataclass
class Tree:
    """A page's nodes in order of opening: parents, features of each, runs of text with their blocks, and labels where a page has them."""

    parent: list[int]
    depth: list[int]
    features: list[tuple[int, ...]]
    texts: list[tuple[int, int, str]]
    labels: list[int]


def _text_features(text: str, parent_tag: int, in_link: bool) -> tuple[int, ...]:
    base = _OTHER + 1 + _HASHED
    n = len(text)
    marks = len(_MARKS.findall(text))
    out = [TAGS["#text"], base + min(n.bit_length(), 12), base + 13 + min(marks, 7), base + 21 + in_link, base + 23 + (text[-1] in ".!?"), base + 25 + min(int(text.count(" ").bit_length()), 9), base + 35 + (text[0].isupper()), base + 37 + ("|" in text), _OTHER + 1 + _HASHED + _TEXT + parent_tag]
    return tuple(out)


def parse(page: str) -> Tree:
    """A tree of any input: tags that don't match are closed or passed over, and raw elements are skipped with what is in them.

    Time is linear in the page: what a tag may close is looked up, not searched for among the open elements.
    """
    parent, depth, features, labels = [-1], [0], [(TAGS["#root"],)], [0]
    tags = ["#root"]
    texts: list[tuple[int, int, str]] = []
    stack = [0]
    opened: dict[str, int] = {}
    watched: dict[str, list[int]] = {name: [] for name in ("p", *_CLOSES)}
    block, at, end, links = 0, 0, len(page), 0

    def add_text(raw: str) -> None:
        text = " ".join(_html.unescape(raw).split()) if raw else ""
        if text:
            top = stack[-1]
            raw0, raw1 = raw[:1].isspace(), raw[-1:].isspace()
            texts.append((len(parent), block, (" " if raw0 else "") + text + (" " if raw1 else "")))
            parent.append(top)
            depth.append(depth[top] + 1)
            labels.append(labels[top])
            tags.append("#text")
            above = tuple(f - _OTHER - 1 + _ABOVE for f in features[top] if _OTHER < f <= _OTHER + _HASHED)
            features.append(_text_features(text, TAGS.get(tags[top], _OTHER), links > 0) + above)

    def pop_to(k: int) -> None:
        nonlocal links
        for x in stack[k:]:
            name = tags[x]
            links -= name == "a"
            opened[name] -= 1
            for same, _ in _WATCH.get(name, ()):
                watched[same].pop()
        del stack[k:]

    def close(same: str) -> None:
        if watched[same] and watched[same][-1] >= 0:
            pop_to(watched[same][-1])

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            block += 1
        if m[1]:
            if opened.get(tag):
                k = len(stack) - 1
                while tags[stack[k]] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in _ENDS_P:
            close("p")
        if tag in _CLOSES:
            close(tag)
        if tag in _RAW:
            over = _RAW[tag].search(page, at)
            at = over.end() if over else end
            continue
        if tag in _VOID:
            continue
        top, attributes = stack[-1], m[3]
        own = [TAGS.get(tag, _OTHER)]
        label = labels[top]
        if attributes and len(attributes) > 3:
            for names in _NAMES.findall(attributes):
                for name in re.split(r"[\s_-]+", names.lower()):
                    if name:
                        own.append(_OTHER + 1 + (zlib.crc32(name.encode("utf-8", "replace")) * 2654435761 & 0xFFFFFFFF) // (1 << 26))
            if found := _LABEL.search(attributes):
                label = int(found[1])
        own.append(_OTHER + 1 + _HASHED + _TEXT + TAGS.get(tags[top], _OTHER))
        stack.append(len(parent))
        parent.append(top)
        depth.append(depth[top] + 1)
        labels.append(label)
        tags.append(tag)
        features.append(tuple(own))
        links += tag == "a"
        opened[tag] = opened.get(tag, 0) + 1
        for same, itself in _WATCH.get(tag, ()):
            watched[same].append(len(stack) - 1 if itself else -1)
        if not attributes.endswith("/"):
            continue
        pop_to(len(stack) - 1)
    return Tree(parent, depth, features, texts, labels)


@dataclass(frozen=True)
class ExtractionModel:
    """Weights and bias of the evidence, and log potentials [state of parent, state of child]; the root's are in ``first``."""

    weights: np.ndarray
    bias: float
    edge: np.ndarray
    first: np.ndarray


def _flat(trees: Sequence[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t.parent) for t in trees])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, starts)])
    parent[starts[:-1]] = -1
    depth = np.concatenate([np.array(t.depth) for t in trees])
    count = np.array([len(f) for t in trees for f in t.features])
    index = np.fromiter((x for t in trees for f in t.features for x in f), np.int64, int(count.sum()))
    return parent, depth, index, np.concatenate([[0], np.cumsum(count)])


def train(pages: Sequence[str], rounds: int = 1200) -> ExtractionModel:
    """Evidence by logistic regression over all nodes of the labelled pages, divided by the prior; potentials from counts of parents' and children's labels.

    An element is content if at least half the text in it is; a run of text has the label of its page's
    markup. Without pages the model takes all text for content.
    """
    trees = [parse(p) for p in pages]
    if not trees:
        return ExtractionModel(np.zeros(WIDTH), 2.0, np.zeros((2, 2)), np.zeros(2))
    labels = []
    for t in trees:
        size, good = [0] * len(t.parent), [0] * len(t.parent)
        for node, _, text in t.texts:
            size[node] = len(text)
            good[node] = len(text) * t.labels[node]
        for k in range(len(t.parent) - 1, 0, -1):
            size[t.parent[k]] += size[k]
            good[t.parent[k]] += good[k]
        labels += [int(2 * g >= s) if s else y for g, s, y in zip(good, size, t.labels)]
    y = np.array(labels, float)
    parent, _, index, bounds = _flat(trees)
    own = np.repeat(np.arange(len(y)), np.diff(bounds))
    w, bias, rate = np.zeros(WIDTH), 0.0, 4.0
    seen = np.bincount(index, minlength=WIDTH) + 4.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(own, w[index], len(y)) + bias)))
        e = y - p
        w += rate * (np.bincount(index, e[own], WIDTH) - 0.02 * w) / seen / 3
        bias += rate * e.mean() / 3
    edge = np.ones((2, 2))
    kids = np.flatnonzero(parent >= 0)
    np.add.at(edge, (y[parent[kids]].astype(int), y[kids].astype(int)), 1)
    prior = (y.sum() + 1) / (len(y) + 2)
    first = np.log(np.array([1 - y[parent < 0].mean() + 0.01, y[parent < 0].mean() + 0.01]))
    return ExtractionModel(w, float(bias - np.log(prior / (1 - prior))), np.log(edge / edge.sum(1, keepdims=True)), first)


def marginals(trees: Sequence[Tree], model: ExtractionModel) -> np.ndarray:
    """Each node's probability of content, tree after tree: messages from the deepest level up, then down, over all trees at once."""
    parent, depth, index, bounds = _flat(trees)
    n = len(parent)
    score = np.add.reduceat(model.weights[index], bounds[:-1]) + model.bias
    belief = np.zeros((n, 2))  # log evidence of a node and of all below it
    belief[:, 0], belief[:, 1] = -np.logaddexp(0, score), -np.logaddexp(0, -score)
    order = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    up = np.zeros((n, 2))
    for d in range(int(depth.max()), 0, -1):
        at = order[levels[d] : levels[d + 1]]
        up[at] = np.logaddexp(model.edge[:, 0] + belief[at, :1], model.edge[:, 1] + belief[at, 1:])
        to = parent[at]
        low, high = to.min(), to.max() + 1
        for s in (0, 1):
            belief[low:high, s] += np.bincount(to - low, up[at, s], high - low)
    roots = order[: levels[1]]
    belief[roots] += model.first
    for d in range(1, int(depth.max()) + 1):
        at = order[levels[d] : levels[d + 1]]
        above = belief[parent[at]] - up[at]  # what the parent knows without this child
        belief[at] += np.logaddexp(above[:, :1] + model.edge[0], above[:, 1:] + model.edge[1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def extract(pages: Sequence[str | None], model: ExtractionModel, least: float = 0.5) -> list[tuple[str, int, int]]:
    """For each page: its content, one line a block, the number of nodes, and that of runs of text that are content."""
    trees = [parse(p or "") for p in pages]
    out: list[tuple[str, int, int]] = []
    if not trees:
        return out
    p = marginals(trees, model)
    at = 0
    for t in trees:
        lines: list[str] = []
        last, kept = -1, 0
        for node, block, text in t.texts:
            if p[at + node] > least:
                kept += 1
                if block == last:
                    lines[-1] += text
                else:
                    lines.append(text)
                last = block
        at += len(t.parent)
        out.append(("\n".join(" ".join(x.split()) for x in lines), len(t.parent), kept))
    return out


def extract_content(pages: DataFrame, model: ExtractionModel | None = None, least: float = 0.5) -> DataFrame:
    """(page_id, text, nodes, kept) for each row of ``pages``: content as lines, DOM nodes, and runs of text kept.

    Null and empty pages have an empty text and one node, the root. Whole pages are read, however long;
    malformed markup is read as far as it can be. Rows that repeat give a row each, and a null page_id
    stays null. A marginal equal to ``least`` isn't content. No rows give no rows. Other columns aren't
    read. Without ``model`` one is trained from :func:`labelled_pages`.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                got = extract(part.column(1).to_pylist(), shared.value, least)
                text, nodes, kept = zip(*got)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(nodes, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "text", "nodes", "kept"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, nodes long, kept long")


def op2(spark, sf_dir: str) -> DataFrame:
    """The content of all pages."""
    return extract_content(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable] = {"op2_html_extraction": op2}
SQL: dict[str, str] = {}
