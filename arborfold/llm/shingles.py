"""Word shingles of texts as sets of 64-bit hashes, by numpy over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _BASE, np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of each word of lower-cased UTF-8 ``data``; words are split at space, \\t, \\n, \\v, \\f, \\r."""
    b = np.frombuffer(data, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    offsets = np.cumsum(sizes) - sizes
    at = np.arange(total) - np.repeat(offsets, sizes)
    terms = (b[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[at]
    return starts, mix(np.add.reduceat(terms, offsets) + sizes.astype(np.uint64))


def shingle_sets(texts: list[str | None], words: int, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``words``-word shingles of each text; with fewer words, of all its words as one.

    A text without words, or a null one, has the empty set. A-Z are lower-cased, other letters are not.
    """
    k = 0
    while k < len(texts):
        parts, size, first = [], 0, k
        while k < len(texts) and (size < at_once or not parts):
            parts.append((texts[k] or "").encode().lower())
            size += len(parts[-1]) + 1
            k += 1
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        starts, hashes = word_hashes(b"\n".join(parts))
        cuts = np.searchsorted(starts, bounds)
        yield from (_shingles(hashes[cuts[j] : cuts[j + 1]], words) for j in range(k - first))


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total = mix(total + h[j : j + len(total)] + np.uint64(j + 1))
    return np.unique(total + np.uint64(n < words))
