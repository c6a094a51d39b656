"""Exact deduplication by cuckoo-filter indexes over digest buckets.

Every text's 64-bit digest goes to the bucket that owns it. A bucket's index answers most digests from its
cuckoo filter; a hit is looked up among the stored keys, and the texts behind digests that recur are then
compared themselves. Digests travel first, without texts; only texts whose digest recurs are moved.

Defined cases: a null text is no content, it is never a copy and is kept; empty texts are equal to each other.
Of equal texts the row with the smallest doc_id stays (null ids come last); of repeated rows one stays, and of rows
of one doc_id the smallest by the other columns. Texts of any length are compared whole, behind their digests.
Columns other than doc_id and text, also ones named like those used here, stay. An empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import col, cut, fresh, mix_int, small


class CuckooIndex:
    """Live digests: a cuckoo filter of 16-bit fingerprints in buckets of four, over a store of the keys.

    The store holds each digest's live count; a filter that overflows is rebuilt at twice the size from it.
    """

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 64) -> None:
        self.keys: dict[int, int] = {}
        self.resizes = 0
        self._build(buckets)

    def _build(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * self.SLOTS * buckets))

    @staticmethod
    def _mark(digest: int) -> int:
        return (mix_int(digest) >> 48) or 1

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, digest: int) -> bool:
        """False only if the digest isn't live."""
        mark = self._mark(digest)
        i = digest & self.mask
        j = self._other(i, mark)
        s, n = self.slots, self.SLOTS
        return mark in s[i * n : i * n + n] or mark in s[j * n : j * n + n]

    def __contains__(self, digest: int) -> bool:
        return self.maybe(digest) and digest in self.keys

    def _put(self, at: int, mark: int) -> bool:
        s, n = self.slots, self.SLOTS
        for k in range(at * n, at * n + n):
            if not s[k]:
                s[k] = mark
                return True
        return False

    def _place(self, digest: int) -> bool:
        mark = self._mark(digest)
        i = digest & self.mask
        j = self._other(i, mark)
        if self._put(i, mark) or self._put(j, mark):
            return True
        at = i
        for kick in range(self.KICKS):
            k = at * self.SLOTS + (mark + kick) % self.SLOTS
            self.slots[k], mark = mark, self.slots[k]
            at = self._other(at, mark)
            if self._put(at, mark):
                return True
        return False

    def insert(self, digest: int) -> bool:
        """Make the digest live; whether it was not live before."""
        if digest in self:
            self.keys[digest] += 1
            return False
        self.keys[digest] = 1
        if not self._place(digest):
            buckets = self.mask + 1
            while True:
                buckets *= 2
                self.resizes += 1
                self._build(buckets)
                if all(self._place(k) for k in self.keys):
                    break
        return True

    def delete(self, digest: int) -> bool:
        """Withdraw one live use of the digest; whether it was live."""
        if digest not in self:
            return False
        self.keys[digest] -= 1
        if not self.keys[digest]:
            del self.keys[digest]
            mark = self._mark(digest)
            i = digest & self.mask
            for at in (i, self._other(i, mark)):
                for k in range(at * self.SLOTS, at * self.SLOTS + self.SLOTS):
                    if self.slots[k] == mark:
                        self.slots[k] = 0
                        return True
        return True


def _recurring(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of which a bucket has two live uses or more, once those of withdrawn rows are deleted."""
    index = CuckooIndex()
    again: set[int] = set()
    gone: list[int] = []
    for batch in batches:
        for digest, withdrawn in zip(batch.column("digest").to_pylist(), batch.column("gone").to_pylist()):
            key = digest & 0xFFFFFFFFFFFFFFFF
            if withdrawn:
                gone.append(key)
            if not index.insert(key):
                again.add(digest)
    for key in gone:
        index.delete(key)
    out = sorted(d for d in again if index.keys.get(d & 0xFFFFFFFFFFFFFFFF, 0) > 1)
    for i in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 10_000], pa.int64())], ["digest"])


def _suspects(docs: DataFrame, withdrawn: Column | None = None) -> tuple[DataFrame, int]:
    """Digests of texts that occur more than once among live rows, and their number."""
    texts = docs.where(F.col("text").isNotNull())
    gone = F.lit(False) if withdrawn is None else F.coalesce(withdrawn, F.lit(False))
    digests = texts.select(F.xxhash64("text").alias("digest"), gone.alias("gone"))
    found = cut(digests.repartition("digest").mapInArrow(_recurring, "digest long"))
    return found, found.count()


def copies(docs: DataFrame, withdrawn: Column | None = None) -> DataFrame:
    """(doc_id, copy_of) for each row whose text an earlier row has; see the module for the order.

    `withdrawn` is a condition on `docs`; rows that meet it are inserted, deleted again and take no part.
    """
    found, n = _suspects(docs, withdrawn)
    if withdrawn is not None:
        docs = docs.where(~F.coalesce(withdrawn, F.lit(False)))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    rows = rows.join(small(found, n), "digest", "left_semi")
    each = rows.groupBy("digest", "text", "doc_id").agg(F.count("*").alias("n"))
    first = each.groupBy("digest", "text").agg(F.min("doc_id").alias("copy_of"))
    more = F.col("n") - F.when(F.col("doc_id").eqNullSafe(F.col("copy_of")), 1).otherwise(0)
    return (
        each.join(first, ["digest", "text"])
        .select("doc_id", "copy_of", more.alias("more"))
        .where("more > 0")
        .select(F.explode(F.array_repeat("doc_id", F.col("more").cast("int"))).alias("doc_id"), "copy_of")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    found, n = _suspects(docs)
    digest, row = fresh(docs, "digest", "row")
    keyed = docs.withColumn(digest, F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    side = small(found.withColumnRenamed("digest", digest), n)
    alone = keyed.join(side, digest, "left_anti").drop(digest)
    ordered = [F.col("doc_id").isNull(), F.col("doc_id")]
    ordered += [col(docs, c) for c, t in docs.dtypes if c.lower() not in ("doc_id", "text") and "map<" not in t and t != "variant"]
    whole = F.struct(*[col(docs, c) for c in docs.columns])
    kept = (
        keyed.join(side, digest, "left_semi")
        .groupBy(digest, "text")
        .agg(F.min_by(whole, F.struct(*ordered)).alias(row))
        .select(f"{row}.*")
    )
    return alone.unionByName(kept)
