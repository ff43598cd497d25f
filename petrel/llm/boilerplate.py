"""The article of a page apart from its menus, notices, teasers and footers.

A page is a tree of nodes (its text lines); each node has a hidden role: headline,
subheading, paragraph, list item (with its place in the list), teaser heading, teaser (with
its place), menu, notice, footer. A node's own features speak for roles through a multinomial
logistic model; parent and child are tied by potentials, one table for neighbours and one
across a gap. Sum-product messages go up and down the tree and give each node's marginal; a
node is kept if the marginals of the article's roles sum to at least one half. Extracted text
has no markup, so its tree is the left-child right-sibling form of the lost one: each line
hangs from the line before it.

Training: lines of extracted text get their role from the element that holds the same text in
the HTML message of the same address. At most ``max_pages`` such pages are taken, the ones
with the smallest address hashes; this is the model's only bounded sample.

Scale: training reads a bounded sample to the driver; the model (a few hundred kB) is
broadcast; decoding is one pass without shuffle, a batch of pages level by level.

Defined cases: null and empty contents have no lines; blank lines are counted but never
kept; a page without any labelled counterpart in the data uses an untrained model, which
keeps every line; pages that are excluded (see exclusion.py, which does the one pass over the
pages) keep none; very long pages are decoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.llm.pages import bare, html_lines, response_page, site_label, squashed, text_of
from petrel.llm.residue import line_kind

CLASSES = ("head", "sub", "para", "item", "teaser_head", "teaser", "menu", "notice", "footer")
OF_TAG = {"h1": "head", "h2": "sub", "h3": "sub", "p": "para", "blockquote": "para", "pre": "para", "li": "item", "h4": "teaser_head", "a": "teaser", "nav": "menu", "div": "notice", "aside": "notice", "footer": "footer"}
PLACES = 5
STATES = tuple(s for c in CLASSES for s in ([f"{c}{k}" for k in range(1, PLACES + 1)] if c in ("item", "teaser") else [c]))
CLASS_OF = np.array([CLASSES.index(s.rstrip("12345")) for s in STATES])
CONTENT = np.array([CLASSES[c] in ("head", "sub", "para", "item") for c in CLASS_OF])
DIM = 1 << 15
MAX_PAGES = 2500
WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % DIM


def line_features(line: str, label: str) -> list[int]:
    """Hashed features of a line: its words, its shape, whether it names the site."""
    tokens = WORD.findall(re.sub(r"\d+", "0", line.lower()))
    names = {f"w:{t}" for t in tokens}
    if tokens:
        names |= {f"first:{tokens[0]}", f"last:{tokens[-1]}"}
        names |= {f"two:{a} {b}" for a, b in zip(tokens, tokens[1:])} if len(tokens) <= 8 else set()
    end = line.rstrip()[-1:] or " "
    n = len(tokens)
    separators = sum(line.count(s) for s in ("|", "·", " > ", "   "))
    names |= {
        f"end:{end if not end.isalnum() else 'word'}", f"n:{min(n, 8) if n < 12 else 12 + min(6, n // 12)}", f"sep:{min(separators, 3)}",
        f"stops:{min(4, len(re.findall(r'[.!?](?: |$)', line)))}", f"title:{sum(w[:1].isupper() for w in line.split()) * 4 // max(1, len(line.split()))}",
        f"digit:{any(c.isdigit() for c in line)}", f"copy:{'©' in line}", f"site:{bool(label) and label in squashed(line)}", "bias",
    }
    return [_slot(x) for x in sorted(names)]


def place_features(i: int, n: int, bullet: bool, gap: bool) -> list[int]:
    return [_slot(f"at:{min(i, 4)}"), _slot(f"left:{min(n - 1 - i, 4)}"), _slot(f"bullet:{bullet}"), _slot(f"gap:{gap}")]


def sum_product(parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, emit: np.ndarray, pair: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of every node of a forest, all trees at once, level by level.

    parent: index or -1; kind: which of ``pair``'s tables ties a node to its parent;
    emit: node x state; pair: kind x parent state x child state.
    """
    n, k = emit.shape
    if not n:
        return emit
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    gathered = np.zeros((n, k))  # log of the product of the children's messages
    message = np.ones((n, k))
    for level in reversed(levels):
        own = emit[level] * np.exp(gathered[level] - gathered[level].max(1, keepdims=True))
        if depth[level[0]] == 0:
            continue
        sent = np.empty_like(own)
        for t in range(len(pair)):
            sent[kind[level] == t] = own[kind[level] == t] @ pair[t].T
        sent = np.maximum(sent / np.maximum(sent.sum(1, keepdims=True), 1e-300), 1e-30)
        message[level] = sent
        np.add.at(gathered, parent[level], np.log(sent))
    belief = np.zeros((n, k))
    for level in levels:
        if depth[level[0]] == 0:
            above = np.tile(start, (len(level), 1))
        else:
            cavity = belief[parent[level]] / message[level]
            above = np.empty_like(cavity)
            for t in range(len(pair)):
                above[kind[level] == t] = cavity[kind[level] == t] @ pair[t]
        own = above * emit[level] * np.exp(gathered[level] - gathered[level].max(1, keepdims=True))
        belief[level] = own / np.maximum(own.sum(1, keepdims=True), 1e-300)
    return belief


class PageModel:
    def __init__(self) -> None:
        c, s = len(CLASSES), len(STATES)
        self.weights = np.zeros((DIM, c), np.float32)
        self.prior = np.full(c, 1 / c)
        self.pair = np.full((2, s, s), 1 / s)
        self.start = np.full(s, 1 / s)
        self.trained = False
        self._cache: dict[tuple[str, str], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def line_scores(self, line: str, label: str) -> np.ndarray:
        key = (line, label if label and label in squashed(line) else "")
        got = self._cache.get(key)
        if got is None:
            got = self.weights[line_features(line, key[1])].sum(0)
            if len(self._cache) > 200_000:
                self._cache.clear()
            self._cache[key] = got
        return got

    def emissions(self, scores: np.ndarray) -> np.ndarray:
        """Scaled likelihoods per state."""
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return (p / self.prior)[:, CLASS_OF]

    def marginals(self, pages: list[tuple[list[str], str]]) -> list[tuple[list[int], list[str], np.ndarray]]:
        """Per page (lines, site label): line numbers and bare texts of its non-blank lines, and their marginals."""
        numbers, texts, parents, depths, kinds, scores = [], [], [], [], [], []
        place_cache: dict[tuple, np.ndarray] = {}
        for lines, label in pages:
            own = [(k, line) for k, line in enumerate(lines, 1) if line.strip()]
            numbers.append([k for k, _ in own])
            texts.append([bare(line) for _, line in own])
            base = len(parents)
            for i, (k, line) in enumerate(own):
                gap = i > 0 and k > own[i - 1][0] + 1
                parents.append(base + i - 1 if i else -1)
                depths.append(i)
                kinds.append(int(gap))
                place = (min(i, 4), min(len(own) - 1 - i, 4), texts[-1][i] != line.strip(), gap)
                if place not in place_cache:
                    place_cache[place] = self.weights[place_features(place[0], place[0] + place[1] + 1 if place[1] < 4 else place[0] + 5, place[2], gap)].sum(0)
                scores.append(self.line_scores(texts[-1][i], label) + place_cache[place])
        if not parents:
            return [([], [], np.zeros((0, len(STATES)))) for _ in pages]
        beliefs = sum_product(np.array(parents), np.array(depths), np.array(kinds), self.emissions(np.array(scores)), self.pair, self.start)
        out, at = [], 0
        for k, t in zip(numbers, texts):
            out.append((k, t, beliefs[at : at + len(k)]))
            at += len(k)
        return out


def label_lines(lines: list[str], tags: dict[str, str]) -> list[str | None]:
    """The state of each non-blank line, from the tag of the same text in the HTML page."""
    out: list[str | None] = []
    run: tuple[str, int] = ("", 0)
    for line in lines:
        if not line.strip():
            continue
        c = OF_TAG.get(tags.get(bare(line), ""))
        if c == "teaser" and run[0] not in ("teaser", "teaser_head"):
            c = "menu"  # links that no heading of teasers precedes
        run = (c or "", run[1] + 1 if c == run[0] else 1)
        out.append(f"{c}{min(run[1], PLACES)}" if c in ("item", "teaser") else c)
    return out


def fit(pages: list[tuple[list[str], str, dict[str, str]]], epochs: int = 4, rate: float = 0.5) -> PageModel:
    """A model of labelled pages: (text lines, site label, tag by text)."""
    model = PageModel()
    rows: list[list[int]] = []
    labels: list[int] = []
    pair = np.full((2, len(STATES), len(STATES)), 0.05)
    start = np.full(len(STATES), 0.05)
    for lines, label, tags in pages:
        states = label_lines(lines, tags)
        own = [(k, line) for k, line in enumerate(lines) if line.strip()]
        before = None
        for i, ((k, line), s) in enumerate(zip(own, states)):
            if s is not None:
                text = bare(line)
                gap = i > 0 and k > own[i - 1][0] + 1
                rows.append(line_features(text, label) + place_features(min(i, 4), min(i, 4) + min(len(own) - 1 - i, 4) + 1, text != line.strip(), gap))
                labels.append(int(CLASS_OF[STATES.index(s)]))
                if i == 0:
                    start[STATES.index(s)] += 1
                elif before is not None:
                    pair[int(gap), STATES.index(before), STATES.index(s)] += 1
            before = s
    if not rows:
        return model
    width = max(map(len, rows))
    grid = np.full((len(rows), width), DIM, np.int64)  # the row after the last is always zero
    for r, features in enumerate(rows):
        grid[r, : len(features)] = features
    y = np.array(labels)
    w = np.zeros((DIM + 1, len(CLASSES)))
    squares = np.full((DIM + 1, 1), 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            b = order[at : at + 256]
            z = w[grid[b]].sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            slots, where = np.unique(grid[b], return_inverse=True)
            g = np.zeros((len(slots), len(CLASSES)))
            np.add.at(g, where.reshape(grid[b].shape), p[:, None, :])
            g = g / len(b) + 1e-5 * w[slots]
            squares[slots] += (g * g).sum(1, keepdims=True)
            w[slots] -= rate * g / np.sqrt(squares[slots])
            w[DIM] = 0
    model.weights = w[:DIM].astype(np.float32)
    model.prior = np.maximum(np.bincount(y, minlength=len(CLASSES)) / len(y), 1e-3)
    model.pair = pair / pair.sum(2, keepdims=True)
    model.start = start / start.sum()
    model.trained = True
    return model


def training_pages(records: DataFrame, max_pages: int = MAX_PAGES) -> list[tuple[list[str], str, dict[str, str]]]:
    """At most ``max_pages`` addresses with both an extracted text and an HTML message."""
    pages = records.where(F.col("content").isNotNull() & F.col("url").isNotNull() & F.col("type").isin("conversion", "response")).select("url", "type", "content")
    # which addresses: from two small columns, without contents
    both = records.where(F.col("url").isNotNull() & F.col("type").isin("conversion", "response")).groupBy("url")
    both = both.agg((F.max(F.col("type") == "conversion") & F.max(F.col("type") == "response")).alias("both")).where("both")
    urls = both.select("url", F.xxhash64("url").alias("h")).orderBy("h", "url").limit(max_pages)
    rows = pages.join(F.broadcast(urls), "url").groupBy("url", "type").agg(F.max_by("content", F.octet_length("content")).alias("content")).collect()
    got: dict[str, dict[str, bytes]] = {}
    for url, kind, content in rows:
        got.setdefault(url, {})[kind] = content
    out = []
    for url in sorted(got):
        if len(got[url]) == 2:
            _, page, _ = response_page(got[url]["response"])
            tags: dict[str, str] = {}
            for line in html_lines(page)[0]:
                if line.tag not in ("title", "noscript"):
                    tags.setdefault(line.text, line.tag)
            lines = text_of(got[url]["conversion"]).split("\n")
            if not any(line_kind(bare(x)) for x in lines):
                out.append((lines, site_label(url), tags))
    return out
