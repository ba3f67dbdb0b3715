"""Winnowing: content-defined fingerprints that every long enough shared span has in common.

A window of ``span`` words holds ``span - k + 1`` k-grams; its fingerprint is
the least of their hashes.  The choice depends on the window's
words alone, so two equal windows have equal fingerprints wherever they stand:
any span of ``span`` or more words that two texts share is found.  Neighbouring
windows mostly choose the same k-gram, so a text has about 2 fingerprints per
``span - k + 2`` words.
"""

from __future__ import annotations

import numpy as np

from wordloom.llm.common import _WORD_POWERS, U64, Words, mix


def gram_size(span: int) -> int:
    """k for windows of ``span`` words: 4 at most, so that the windows stay wide."""
    return max(1, min(4, span // 2))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done:]) if width > done else values


def fingerprints(words: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of each window of ``span`` words inside one row."""
    n, k = len(words.hashes), gram_size(span)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, U64)
    at = np.arange(n - k + 1)
    least = sliding_min(mix(_WORD_POWERS[0].spans(words.hashes, at, at + k)), span - k + 1)
    last = np.repeat(words.first[1:], np.diff(words.first))[: len(least)]
    at = np.flatnonzero(last - np.arange(len(least)) >= span)
    return at, least[at]


def windows(words: Words, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows that begin at the given words."""
    return tuple(mix(p.spans(words.hashes, at, at + span)) for p in _WORD_POWERS)


def distinct_per_row(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of the first of equal (row, value) pairs, by row."""
    order = np.lexsort((values, rows))
    new = np.ones(len(order), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]) | (values[order][1:] != values[order][:-1])
    return order[new]


def covered(n: int, starts: np.ndarray, span: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + span, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0
