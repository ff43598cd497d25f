"""Evaluation texts inside training texts, by spaced-seed hashing.

A spaced seed is a fixed mask over SPAN word positions; ignored positions may differ. The
masked windows of all items are hashed into one sorted array; each document's windows are
hashed with the same masks and looked up. Around every hit the document and the item are
laid side by side and the overlap is verified: the longest run of equal words, and the
longest stretch with at most ``max_substitution_rate`` of substituted words. A run of SPAN
equal words matches under any mask, so no exact overlap of SPAN words is missed.

Scale: one pass over the documents, no shuffle. The items are taken in blocks of at most
``block_words`` words (an item is never split), each block a broadcast of bounded size. Beyond one
block the blocks follow one another: a block's rows are written and its broadcast is released
before the next is built, so a large held-out set costs further passes, never more memory.

Defined cases: null or short texts have no windows and match nothing; items that share a
passage each match; repeated documents each give rows; ids may be any value; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame

from petrel.llm.words import mixed, plain_words, window_hashes
from petrel.storage import written

SPAN = 12
#: Fixed masks; 0 marks an ignored position.
MASKS = ("110111011011", "101101110111", "111011011101")
BLOCK_WORDS = 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, doc_from int, item_from int, run_words int, overlap_words int, substituted int"


class ItemIndex:
    """The masked windows of one block of items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        vocabulary: dict[str, int] = {}
        for _, tokens in items:
            for t in tokens:
                vocabulary.setdefault(t, len(vocabulary) + 1)
        self.vocabulary = vocabulary
        self.items = [(i, np.fromiter((vocabulary[t] for t in tokens), np.int64, len(tokens))) for i, tokens in items]
        self.masks = [tuple(k for k, c in enumerate(m) if c == "1") for m in MASKS]
        keys, owner, at = [], [], []
        for number, (_, ids) in enumerate(self.items):
            for m, mask in enumerate(self.masks):
                h = window_hashes(mixed(ids.astype(np.uint64)), SPAN, mask) ^ np.uint64(m)
                keys.append(h)
                owner.append(np.full(len(h), number, np.int32))
                at.append(np.arange(len(h), dtype=np.int32))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int32))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int32))[order]

    def hits(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item number, diagonal) of every masked window that is also an item's."""
        found: set[tuple[int, int]] = set()
        scattered = mixed(ids.astype(np.uint64))
        for m, mask in enumerate(self.masks):
            h = window_hashes(scattered, SPAN, mask) ^ np.uint64(m)
            low = np.searchsorted(self.keys, h)
            high = np.searchsorted(self.keys, h, "right")
            for p in np.flatnonzero(high > low):
                for k in range(low[p], high[p]):
                    found.add((int(self.owner[k]), int(p) - int(self.at[k])))
        return found


def longest_run(equal: np.ndarray) -> tuple[int, int]:
    """(length, start) of the longest stretch of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    if not len(edges):
        return 0, 0
    lengths = edges[1::2] - edges[::2]
    k = int(np.argmax(lengths))
    return int(lengths[k]), int(edges[2 * k])


def tolerant_stretch(equal: np.ndarray, rate: float) -> tuple[int, int, int]:
    """(words, start, substituted) of the longest stretch from an equal word to an equal word with at most rate of substituted words."""
    bad = np.concatenate(([0], np.cumsum(~equal)))
    over = bad - rate * np.arange(len(bad))  # a stretch is within rate if this does not grow over it
    starts, ends = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    if not len(starts):
        return 0, 0, 0
    first = starts[np.searchsorted(np.maximum.accumulate(over[starts]), over[ends] - 1e-9)]
    k = int(np.argmax(ends - first))
    return int(ends[k] - first[k]), int(first[k]), int(bad[ends[k]] - bad[first[k]])


def find_overlaps(index: ItemIndex, text: str | None, rate: float) -> list[tuple[int, int, int, int, int, int]]:
    """Per item: (item_id, doc_from, item_from, run_words, overlap_words, substituted) of its longest overlap, run_words of its longest run."""
    tokens = plain_words(text)
    if len(tokens) < SPAN:
        return []
    get = index.vocabulary.get
    unknown = len(index.vocabulary) + 1
    ids = np.fromiter((get(t, unknown) for t in tokens), np.int64, len(tokens))
    if np.count_nonzero(ids != unknown) < min(len(m) for m in index.masks):
        return []
    best: dict[int, tuple] = {}
    runs: dict[int, int] = {}
    for number, diagonal in index.hits(ids):
        item_id, item = index.items[number]
        a, b = max(0, diagonal), min(len(ids), diagonal + len(item))
        equal = ids[a:b] == item[a - diagonal : b - diagonal]
        runs[number] = max(runs.get(number, 0), longest_run(equal)[0])
        overlap, start, substituted = tolerant_stretch(equal, rate)
        row = (overlap, -substituted, -a - start, item_id, a + start, a + start - diagonal)
        if number not in best or row > best[number]:
            best[number] = row
    return [(item_id, d, i, runs[number], overlap, -s) for number, (overlap, s, _, item_id, d, i) in best.items()]


def find_leaks(documents: DataFrame, items: DataFrame, max_substitution_rate: float = 0.15, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The best overlap of each document and item that share a masked window.

    documents: doc_id, text; items: item_id, text (read to the driver block by block:
    they are the stated query set).
    """
    spark = documents.sparkSession
    blocks: list[DataFrame] = []

    def scan(block: list[tuple[int, list[str]]]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(ItemIndex(block))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                rows = [(d, *r) for d, text in zip(batch["doc_id"], batch["text"]) for r in find_overlaps(index, text, max_substitution_rate)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        return documents.select("doc_id", "text").mapInPandas(find, SCHEMA), shared

    def finished(block: list[tuple[int, list[str]]]) -> DataFrame:
        rows, shared = scan(block)
        rows = written(rows, "overlaps")
        shared.destroy()
        return rows

    block: list[tuple[int, list[str]]] = []
    size = 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        tokens = plain_words(text)
        if block and size + len(tokens) > block_words:
            blocks.append(finished(block))
            block, size = [], 0
        block.append((item_id, tokens))
        size += len(tokens)
    blocks.append(finished(block) if blocks else scan(block)[0])
    return reduce(DataFrame.unionByName, blocks)
