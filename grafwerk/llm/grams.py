"""Sets of hashed word n-grams."""

from __future__ import annotations

import numpy as np

from grafwerk.llm.common import mix
from grafwerk.llm.words import PLAIN, hashes

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all texts in order, and where each text's begin. A text of fewer words has one gram of them all."""
    word, _, _, first = hashes(data, at, PLAIN)
    count = np.diff(first)
    out = word.copy()
    for k in range(1, n):
        # The gram at a word reaches k words on, as far as its text does.
        later = np.arange(len(word)) + k
        ends = np.repeat(first[1:], count)
        inside = later < ends
        out[inside] = mix(out[inside] * _A + word[later[inside]] * _B + np.uint64(k))
    last = np.repeat(first[1:], count) - np.arange(len(word))
    short = np.repeat(count < n, count) & (np.arange(len(word)) == np.repeat(first[:-1], count))
    keep = (last >= n) | short
    ends = np.zeros(len(word) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return out[keep], ends[first]


def sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct grams, ascending."""
    g, first = grams(data, at, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        x = np.sort(g[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out
