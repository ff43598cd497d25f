"""Words as the problems define them, and hashes of them that are equal on every machine."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, lower case."""
    return WORD.findall(text.lower()) if text else []


def plain_words(text: str | None) -> list[str]:
    """Runs of letters or digits without letter case and accents."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        text = text.casefold()
        if not text.isascii():
            text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    else:
        text = text.lower()
    return WORD.findall(text)


@lru_cache(1 << 17)
def hash64(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(hash64, tokens), np.uint64, len(tokens))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = values + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def window_hashes(tokens: np.ndarray, span: int, offsets: tuple[int, ...] | None = None) -> np.ndarray:
    """One hash per window of ``span`` tokens; with ``offsets`` only those positions count."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in offsets if offsets is not None else range(span):
            out = (out + tokens[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return out
