"""Words of many texts at once: boundaries and 64-bit hashes by numpy passes over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from grafwerk.llm.common import mix

_BASE = 0x9E3779B97F4A7C55
_rng = np.random.default_rng(20240607)
#: A random value for each byte, so that a word's polynomial doesn't depend on the bytes' order.
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.arange(256, dtype=np.uint8)
    space[[9, 10, 11, 12, 13, 32, 0]] = 0
    plain = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or (b < 0x80 and c.isalnum()):
            plain[b] = ord(c.lower()) if b < 0x80 else b
    return space, plain


#: Byte classes: `SPACE` keeps every byte but white space; `PLAIN` keeps lower-cased letters, digits and non-ASCII bytes.
SPACE, PLAIN = _tables()


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 20)
        inv = pow(_BASE, -1, 1 << 64)
        a = np.full(n, _BASE, np.uint64)
        b = np.full(n, inv, np.uint64)
        a[0] = b[0] = 1
        _powers, _inverse = np.cumprod(a), np.cumprod(b)


def split(data: np.ndarray, at: np.ndarray, kind: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, the mapped bytes, and the first word of each text (one more than there are texts)."""
    seen = kind[data]
    if kind is PLAIN and len(data):
        upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)
        seen[1:] += upper.astype(np.uint8) * np.uint8(0x20)
    inside = seen != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, seen, np.searchsorted(start, at)


def sums(seen: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial over the mapped bytes."""
    n = len(seen)
    _grow(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[seen] * _powers[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _inverse[start] + (end - start).astype(np.uint64))


def hashes(data: np.ndarray, at: np.ndarray, kind: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the first word of each text."""
    start, end, seen, words = split(data, at, kind)
    return span_hash(sums(seen), start, end), start, end, words
