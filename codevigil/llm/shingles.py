"""Sets of hashed word shingles, vectorised over the bytes of many texts.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z read as a-z. A set
holds the distinct shingles of ``k`` words; a text of fewer words has its whole word
sequence as its only shingle; a text without words has the empty set. Shingles are known
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SLICE, byte_table, mix, prefix_sums, span_hash, text_slices

_TABLE = byte_table(7)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xD1342543DE82EF95)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one more at the end)."""
    if len(data) > 4 * SLICE:  # one long text: in parts that end at a space
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + SLICE)
            while end < len(data) and not _SPACE[data[end]]:
                ahead = np.flatnonzero(_SPACE[data[end : end + SLICE]])
                end = end + int(ahead[0]) if len(ahead) else min(len(data), end + SLICE)
            parts.append(_words(data[at:end], np.array([0, end - at]))[0] if end - at <= 4 * SLICE else _long_word(data[at:end]))
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    space = _SPACE[data]
    begin, finish = ~space, ~space
    begin[1:] &= space[:-1]
    finish[:-1] &= space[1:]
    heads, tails = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    begin[heads] = ~space[heads]
    finish[tails] = ~space[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return span_hash(prefix_sums(_TABLE[data]), start, end), np.searchsorted(start, bounds)


def _long_word(data: np.ndarray) -> np.ndarray:
    space = np.flatnonzero(_SPACE[data])
    cut = np.concatenate([[-1], space, [len(data)]])
    out = []
    for a, b in zip(cut[:-1] + 1, cut[1:]):
        if b > a:
            out.append(span_hash(prefix_sums(_TABLE[data[a:b]]), np.array([0]), np.array([b - a])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    count = max(0, len(words) - k + 1)
    out, factor = np.zeros(count, np.uint64), np.uint64(1)
    for j in range(k):
        out += words[j : j + count] * factor
        factor = factor * _STEP
    return mix(out + np.uint64(k))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    with np.errstate(over="ignore"):
        for first, end, data, bounds in text_slices(column):
            words, at = _words(data, bounds)
            spans = _windows(words, k)
            for i in range(end - first):
                a, b = int(at[i]), int(at[i + 1])
                if b - a >= k:
                    yield first + i, np.unique(spans[a : b - k + 1])
                elif b > a:
                    yield first + i, _windows(words[a:b], b - a)
                else:
                    yield first + i, spans[:0]
