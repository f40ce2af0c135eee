"""Word shingles of texts as sets of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from evenhand.llm.common import Rolling, mix

WORDS = 5
U = np.uint64
TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True  # what separates words
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z alone


def spans(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a slice."""
    solid = ~BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[off] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and text number of every word of a slice."""
    start, stop = spans(body, off)
    return Rolling(LOWER[body]).of(start, stop), np.searchsorted(off, start, "right") - 1


def shingle_sets(body: np.ndarray, off: np.ndarray, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words has one, of all its words, and none without words."""
    code, text = words(body, off)
    n = len(code) - k + 1
    total = np.zeros(max(n, 0), U)
    for j in range(k):
        total += code[j: j + n] * TURNS[j] if n > 0 else U(0)
    every = mix(total)
    ends = np.searchsorted(text, np.arange(len(off) - 1), "right").tolist()
    at = 0
    for end in ends:
        if end - at >= k:
            own = np.sort(every[at: end - k + 1])
            yield own[np.r_[True, own[1:] != own[:-1]]]
        elif end > at:
            yield mix(np.array([(code[at:end] * TURNS[: end - at]).sum(dtype=U) + U(end - at)], U))
        else:
            yield np.zeros(0, U)
        at = end
