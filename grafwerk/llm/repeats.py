"""Passages that documents share, by threshold-bounded interval expansion over Burrows-Wheeler transforms.

A passage is a run of words of which every `LEAST` in a row also stand in another document.

Each window of `LEAST` words belongs to the smallest hash among its runs of `GRAM` words: equal windows belong
to equal hashes. Consecutive windows of one hash travel as one stretch of words, and only those do whose hash
occurs in two documents or more. The stretches that meet in a task become one text with separators. Its suffix
array gives the transform; from the interval of the empty string, backward extension derives the intervals of
longer and longer strings, level by level, and with them the common prefixes of neighbouring suffixes by
increasing length. At `LEAST` the expansion stops: suffixes not told apart by then begin with equal windows.

Documents of one text aren't compared: all of each is one passage, if it is long enough.

Defined cases: rows with a null doc_id or text have no passages, nor have texts of fewer than `LEAST` words.
Rows that repeat doc_id and text are one document; rows that repeat a doc_id with another text are documents of
their own, whose results bear the same doc_id. Texts of any length are compared whole. Words are told apart exactly,
by case and punctuation too; white space only separates them. Columns other than doc_id and text may have any names.
An empty table has no passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.llm import exact
from grafwerk.llm.common import cut, mix, partitions, ranges, runs, slices, small, strings
from grafwerk.llm.jaccard import single
from grafwerk.llm.words import hashes

#: Words of a window, and words of the runs whose smallest hash it belongs to.
LEAST, GRAM = 50, 10
#: Words whose transform one step makes.
TOGETHER = 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stretches(data: np.ndarray, at: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes, each text's first word, and of each stretch of windows its text, first and last window (by word) and hash."""
    word, _, _, first = hashes(data, at)
    n = len(word)
    ends = np.repeat(first[1:], np.diff(first))
    g = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    if n >= least:
        h = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            h = h * _A + word[k : n - gram + 1 + k]
        g[: n - gram + 1] = mix(h * _B)
    window = least - gram + 1
    low, wide = g, 1
    while wide * 2 <= window:
        low = np.minimum(low[: len(low) - wide], low[wide:])
        wide *= 2
    if window > wide:
        low = np.minimum(low[: len(low) - (window - wide)], low[window - wide :])
    valid = np.flatnonzero(np.arange(len(low)) + least <= ends[: len(low)]) if n >= least else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))[valid]
    low = low[valid]
    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])])) if len(valid) else valid
    last = valid[np.append(new[1:], len(valid)) - 1] if len(valid) else valid
    return word, first, text[new], valid[new], last, low[new]


def _owners(least: int, gram: int):
    """(hash, doc) of each stretch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, _, text, _, _, low = stretches(*strings(part.column("text")), least, gram)
            doc = part.column("doc_id").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(doc, pa.int64())], ["hash", "doc"])

    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the (hash, doc) of whole hashes those whose hash has two documents or more, each once."""
    held = [(b.column("hash").to_numpy(), b.column("doc").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    key, doc = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    keep = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    key, doc = key[keep], doc[keep]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, len(key)))
    many = np.repeat(count > 1, count)
    key, doc = key[many], doc[many]
    for i in range(0, len(key), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(doc[i : i + 100_000])], ["hash", "doc"])


def _cut_out(least: int, gram: int):
    """The stretches of the hashes that each document shares: (hash, doc, start, words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            word, first, text, start, last, low = stretches(*strings(part.column("text")), least, gram)
            wanted = part.column("hashes")
            flat = wanted.flatten().to_numpy()
            owner = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            # A hash of another document of this slice does no harm: hashes are shared or they aren't.
            keep = np.flatnonzero(np.isin(low.view(np.int64), flat)) if len(owner) else np.zeros(0, np.int64)
            text, start, last, low = text[keep], start[keep], last[keep], low[keep]
            doc = part.column("doc_id").to_numpy()[text]
            words = [word[a : b + least].tobytes() for a, b in zip(start.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.view(np.int64)), pa.array(doc, pa.int64()), pa.array(start - first[text], pa.int64()), pa.array(words, pa.binary())], ["hash", "doc", "start", "words"]
            )

    return run


def suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array, by doubling; suffixes equal in `depth` symbols and more may be left in any order."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    bits = np.uint64(max(1, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    wide = 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[: n - wide] = rank[wide:] + 1 if wide < n else 0
        key = rank.astype(np.uint64) * np.uint64(n + 2) + second.astype(np.uint64)
        if int(rank.max(initial=0)).bit_length() + 2 * int(bits) < 63:
            packed = np.sort(key << bits | np.arange(n, dtype=np.uint64))
            order = (packed & mask).astype(np.int64)
            key = packed >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.concatenate([[False], key[1:] != key[:-1]])
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(new)
        wide *= 2
        if wide >= depth or rank[order[-1]] == n - 1:
            return order


def prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix array the common prefix with the place before, or `least` if it is that or more.

    Breadth-first: the intervals of one level are those of strings of one length. Extending an interval's string
    by a symbol to the left gives an interval whose end, if no shorter string has ended there, is told apart
    from its successor by just the level's length.
    """
    n = len(symbols)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    # Where each suffix goes when the symbol before it is put in front (the text is a ring here).
    before = symbols[order - 1]
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    head = symbols[order]
    start, size = np.array([0]), np.array([n])
    for level in range(least):
        if not len(start):
            break
        at = step[ranges(start, size)]
        owner = np.repeat(np.arange(len(start)), size)
        if len(start) > 1 or size[0] < n:
            both = np.sort(owner << 32 | at)
            owner, at = both >> 32, both & 0xFFFFFFFF
        else:
            at = np.arange(n)
        symbol = head[at]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
        size = np.diff(np.append(new, len(at)))
        start = at[new]
        end = start + size
        fresh = lcp[end] < 0
        # The last interval of all ends where the array does and is followed though nothing is told there.
        lcp[end[fresh]] = level
        follow = fresh | (end == n) & (size > 0)
        start, size = start[follow], size[follow]
    out = lcp[:n].copy()
    out[out < 0] = least
    return out


def repeated(words: list[np.ndarray], low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows in distinct stretches, given each one's smallest and largest document: stretch, first and last window, smallest document."""
    size = np.array([len(w) for w in words])
    every = np.concatenate(words)
    _, dense = np.unique(every, return_inverse=True)
    m = len(words)
    ends = np.cumsum(size)
    symbols = np.empty(len(every) + m, np.int64)
    place = np.arange(len(every)) + np.repeat(np.arange(m), size)
    symbols[place] = dense + m
    symbols[ends + np.arange(m)] = np.arange(m)
    stretch = np.repeat(np.arange(m), size + 1)
    offset = np.arange(len(symbols)) - (ends - size + np.arange(m))[stretch]
    order = suffixes(symbols, least)
    lcp = prefixes(symbols, order, least)
    new = np.flatnonzero(lcp < least)
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    owner = stretch[order]
    first, last = np.minimum.reduceat(low[owner], new), np.maximum.reduceat(high[owner], new)
    good = (first != last)[group] & (offset[order] + least <= size[owner])
    owner, at, first = owner[good], offset[order][good], first[group][good]
    if not len(owner):
        return owner, at, at, first
    by = np.lexsort((at, owner))
    owner, at, first = owner[by], at[by], first[by]
    cuts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
    return owner[cuts], at[cuts], at[np.append(cuts[1:], len(at)) - 1], np.minimum.reduceat(first, cuts)


def _found(least: int):
    """(doc, low, high, first): runs of windows, from `low` to `high`, that another document has too."""

    def told(words: dict[bytes, list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        where = list(words.values())
        low, high = (np.array([f(d for d, _ in w) for w in where], np.int64) for f in (min, max))
        owner, a, b, first = repeated([np.frombuffer(w, np.uint64) for w in words], low, high, least)
        if not len(owner):
            return
        count = np.array([len(w) for w in where])
        docs = np.array([d for w in where for d, _ in w], np.int64)
        starts = np.array([s for w in where for _, s in w], np.int64)
        begin = np.cumsum(count) - count
        at = ranges(begin[owner], count[owner])
        rep = np.repeat(np.arange(len(owner)), count[owner])
        out = (docs[at], starts[at] + a[rep], starts[at] + b[rep], first[rep])
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int64()) for x in out], ["doc", "low", "high", "first"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[int, int]]] = {}
        size = 0
        for group in runs(batches, "hash"):
            for doc, start, words in zip(group.column("doc").to_pylist(), group.column("start").to_pylist(), group.column("words").to_pylist()):
                if words in held:
                    held[words].append((doc, start))
                else:
                    held[words] = [(doc, start)]
                    size += len(words) // 8
            if size >= TOGETHER:
                yield from told(held)
                held, size = {}, 0
        if held:
            yield from told(held)

    return run


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        _, _, _, first = hashes(*strings(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64())], ["doc", "n"])


def passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, begin, end, first_id): words [begin, end) of the document are a passage; `first_id` is the smallest doc_id that has part of it."""
    gram = min(gram, least)
    rows, numbers = single(docs)
    same = cut(exact.copies(rows))
    count = same.count()
    firsts = rows.join(small(same.select("doc_id"), count), "doc_id", "left_anti")
    parts = partitions(docs.sparkSession)
    owners = firsts.mapInArrow(_owners(least, gram), "hash long, doc long").repartition(parts, "hash")
    shared = owners.mapInArrow(_shared, "hash long, doc long").groupBy("doc").agg(F.collect_list("hash").alias("hashes"))
    # The lists grow with the text: they meet it by a shuffle, at every size.
    wanted = firsts.join(shared.withColumnRenamed("doc", "doc_id").hint("merge"), "doc_id")
    pieces = wanted.select("doc_id", "text", "hashes").mapInArrow(_cut_out(least, gram), "hash long, doc long, start long, words binary")
    found = pieces.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(_found(least), "doc long, low long, high long, first long")
    found = cut(found.select("doc", F.col("low").alias("begin"), (F.col("high") + least).alias("end"), "first"))
    whole = same.groupBy("copy_of").agg(F.collect_list("doc_id").alias("copies"))
    whole = whole.select(F.col("copy_of").alias("doc_id"), F.explode(F.concat(F.array("copy_of"), "copies")).alias("of"))
    sized = rows.join(small(same.select(F.col("copy_of").alias("doc_id")).distinct(), count), "doc_id", "left_semi").mapInArrow(_counted, "doc long, n long").where(F.col("n") >= least)
    # What the first of them shares with others, its copies share as well.
    earlier = found.groupBy(F.col("doc").alias("with")).agg(F.min("first").alias("first"))
    every = whole.join(sized, F.col("doc_id") == F.col("doc")).join(earlier, F.col("doc_id") == F.col("with"), "left")
    every = every.select(F.col("of").alias("doc"), F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), F.coalesce(F.least("doc_id", "first"), "doc_id").alias("first"))
    # A document of which there are copies is a passage as a whole; what it shares besides lies within.
    order = Window.partitionBy("doc").orderBy("begin", "end")
    both = found.unionByName(every)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("new", F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0))
    marked = marked.withColumn("nth", F.sum("new").over(order))
    merged = marked.groupBy("doc", "nth").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("first").alias("first_id"))
    if numbers is None:
        return merged.select(F.col("doc").alias("doc_id"), "begin", "end", "first_id")
    merged = merged.drop("nth").join(numbers.select("doc", "doc_id"), "doc")
    return merged.join(numbers.select(F.col("doc").alias("first_id"), F.col("doc_id").alias("first")), "first_id").select("doc_id", "begin", "end", F.col("first").alias("first_id"))
