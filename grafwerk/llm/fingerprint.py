"""Document fingerprints from prefix polynomial hashes.

A text's code points c are summed as c[j] * BASE**j modulo the prime 2**61 - 1. From the array of prefix sums
any span's hash is one subtraction, two spans are compared by bringing both to the same power, and the longest
common extension of two positions is found by binary search over such comparisons.

Contents are told apart by their texts, not by a hash. A beginning in common counts from `HEAD` characters on.

Defined cases: a null text has a null fingerprint and no neighbour; an empty text has fingerprint 0. A shorter
beginning in common counts as none, so that a text of fewer characters has no neighbour. Texts of any length are
compared whole. Rows that repeat have equal results; a content that has no doc_id asks, but is no answer; of
contents that share as much the smallest doc_id is told. Columns other than doc_id and text may have any names. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import cut, partitions, slices, small, strings, thin

PRIME = (1 << 61) - 1
BASE = 1_152_921_504_606_838_747
#: Characters from which on a beginning in common counts.
HEAD = 32

_P = np.uint64(PRIME)
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_S29, _S30, _S31, _S32, _S61 = (np.uint64(x) for x in (29, 30, 31, 32, 61))
_powers = np.array([1], np.uint64)


def reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of residues modulo the prime, without leaving 64 bits."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    ah, al, bh, bl = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = ah * bl + al * bh
    return reduce(np.uint64(2) * ah * bh + al * bl + (mid >> _S30) + ((mid & _M30) << _S31))


def powers(n: int) -> np.ndarray:
    """BASE**0 to BASE**(n - 1)."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(BASE, len(_powers), PRIME))
        _powers = np.concatenate([_powers, mulmod(_powers, step)])
    return _powers[:n]


def prefix(points: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Prefix sums of points * power modulo the prime; one longer than `points`."""
    c = points.astype(np.uint64)
    high = c * (power >> _S31)
    term = c * (power & _M31) + (high >> _S30) + ((high & _M30) << _S31)
    low = np.cumsum(term & np.uint64(0xFFFFFFFF), dtype=np.uint64)
    top = np.cumsum(term >> _S32, dtype=np.uint64)
    out = np.zeros(len(c) + 1, np.uint64)
    out[1:] = reduce(reduce((top >> _S29) + ((top & np.uint64((1 << 29) - 1)) << _S32)) + low)
    return out


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


class Prefixes:
    """The prefix array of one text."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        self.sums = prefix(points, powers(self.n))

    def span(self, start: int, end: int) -> int:
        """The span's sum, still with the powers of its place."""
        return (int(self.sums[end]) - int(self.sums[start])) % PRIME

    def same(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether `length` characters from `start` equal those of `other` from `at`."""
        mine = self.span(start, start + length) * pow(BASE, at, PRIME) % PRIME
        theirs = other.span(at, at + length) * pow(BASE, start, PRIME) % PRIME
        return mine == theirs

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """How many characters from the two positions on are equal."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters, fingerprint and head hash of each text, and where there is a head."""
    data, at = strings(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    at = chars[at]
    n = np.diff(at)
    place = np.arange(len(points)) - np.repeat(at[:-1], n)
    sums = prefix(points, powers(int(n.max(initial=0)) or 1)[place])
    whole = minus(sums[at[1:]], sums[at[:-1]])
    long = n >= HEAD
    head = minus(sums[np.where(long, at[:-1] + HEAD, at[:-1])], sums[at[:-1]])
    return n, whole, head, long


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        text = part.column("text")
        n, whole, head, long = _marks(text)
        null = np.asarray(text.is_null())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()),
                pa.array(n, pa.int64(), mask=null),
                pa.array(whole.astype(np.int64), pa.int64(), mask=null),
                pa.array(head.astype(np.int64), pa.int64(), mask=null | ~long),
                part.column("mark"),
            ],
            ["doc_id", "n_chars", "fingerprint", "head", "mark"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, head, mark) for each row; `mark` is a second, independent hash."""
    rows = thin(docs).select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(_fingerprints, "doc_id long, n_chars long, fingerprint long, head long, mark long")


def _headed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        _, whole, head, long = _marks(part.column("text"))
        rows = [part.column("doc_id").cast(pa.int64()), pa.array(whole.astype(np.int64)), part.column("mark"), pa.array(head.astype(np.int64)), part.column("text").cast(pa.string())]
        yield pa.RecordBatch.from_arrays(rows, ["doc_id", "fingerprint", "mark", "head", "text"]).filter(pa.array(long))


def nearest(ids: list[int | None], shared: list[int]) -> list[tuple[int, int]]:
    """For each of some sorted texts the smallest id among those that share most with it, and how much: (-1, 0) if none.

    `shared[k]` is what texts k and k + 1 have in common. Texts that share v or more are neighbours in the order, so
    that the intervals between smaller values form a tree; each is closed once and settles the texts left open in it.
    A text without an id asks but isn't an answer.
    """
    out = [(-1, 0)] * len(ids)
    stack: list[tuple[int, list[tuple[int, int]], list[int]]] = []

    def joined(a: tuple, b: tuple) -> tuple[list[tuple[int, int]], list[int]]:
        few, many = sorted((a[1], b[1]), key=len)
        many.extend(few)
        return sorted(a[0] + b[0])[:2], many

    for k, i in enumerate(ids):
        value = shared[k] if k < len(shared) else -1
        last = ([] if i is None else [(i, k)], [k])
        while stack and stack[-1][0] > value:
            v, *top = stack.pop()
            best, asking = joined(tuple(top), last)
            left = []
            for t in asking if best else ():
                other = next((near for near, at in best if at != t), None)
                if other is None:
                    left.append(t)
                else:
                    out[t] = (other, v)
            last = (best, left if best else asking)
        if stack and stack[-1][0] == value:
            v, *top = stack.pop()
            last = joined(tuple(top), last)
        stack.append((value, *last))
    return out


def _longest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of each head's contents, from rows sorted by head and text; only one text is held besides the batch."""
    head, last, same = None, None, None
    prints: list[tuple[int, int]] = []
    ids: list[int | None] = []
    shared: list[int] = []

    def settled() -> pa.RecordBatch:
        rows = [(*p, near, n) for p, (near, n) in zip(prints, nearest(ids, shared)) if n]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["fingerprint", "mark", "near_id", "common"])

    for batch in batches:
        for part in slices([batch], "text"):
            for i, p, m, h, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "fingerprint", "mark", "head", "text"))):
                if h != head:
                    if len(prints) > 1:
                        yield settled()
                    head, last, same, prints, ids, shared = h, None, None, [], [], []
                if text == same:
                    ids[-1] = min((x for x in (ids[-1], i) if x is not None), default=None)
                    continue
                own = Prefixes(text)
                if last is not None:
                    shared.append(last.extension(0, own, 0))
                last, same = own, text
                prints.append((p, m))
                ids.append(i)
    if len(prints) > 1:
        yield settled()


def longest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, near_id, common) for each row: its longest beginning in common with another content.

    `common` is the most characters that any other content shares from the start, and `near_id` the smallest doc_id
    of the contents that share so many; -1 and 0 where none shares `HEAD`.
    """
    marks = cut(fingerprints(docs))
    contents = marks.where("head IS NOT NULL").groupBy("head", "fingerprint", "mark").agg(F.min("doc_id").alias("of"))
    several = contents.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    wanted = cut(contents.join(several, "head", "left_semi").select("of").distinct())
    # Of each content the rows of its smallest doc_id; repeated ones meet in the sort.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = rows.join(small(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    rows = rows.mapInArrow(_headed, "doc_id long, fingerprint long, mark long, head long, text string")
    rows = rows.repartition(partitions(docs.sparkSession), "head").sortWithinPartitions("head", "text")
    common = cut(rows.mapInArrow(_longest, "fingerprint long, mark long, near_id long, common long"))
    found = marks.drop("head").join(small(common, common.count()), ["fingerprint", "mark"], "left")
    return found.select("doc_id", "n_chars", "fingerprint", F.coalesce("near_id", F.lit(-1)).alias("near_id"), F.coalesce("common", F.lit(0)).alias("common"))
