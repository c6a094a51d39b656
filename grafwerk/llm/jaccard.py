"""Exact Jaccard join of documents' word n-gram sets, as a metric-space join.

Jaccard distance is a metric, so pivots, Voronoi regions and triangle-inequality windows find every pair within
a distance r. Nearly all documents are at distance 1 from nearly all others, so the first pivots are chosen by an
index of rare grams:

1. Each gram's document frequency is counted, exactly, from sorted blocks of (gram, document). A document with
   too few recurring grams to reach the threshold with anything is closed: it has no partner.
2. Of the others' grams, rarest first, a prefix is kept that any two partners must share `SHARED` grams of, or all
   that they share. Chance repeats of grams are many in a large table, but hardly any two documents share several
   rare ones. Pairs of the holders of a gram are counted, as ids, where sizes and places leave a partner possible;
   those that share enough are in a region of the smallest document tied to them. A gram of more than `FEW` holders
   has a region of all of them, with the smallest as its pivot. The regions cover all pairs.
3. Every region is split by pivots of its own, whatever its size: documents within a radius R of a pivot are at
   home in the Voronoi cell of the nearest one. A partner of one of them is within R + r of that pivot, by the
   triangle inequality; this window replicates documents of later cells into the cell. Cells join recursively,
   with a quarter of the radius, and what the last radius leaves together is compared outright.
4. A region of more than `LEAF` documents doesn't fit into one task. It is first split across tasks by the same
   rule, with a few drawn pivots; documents beyond R of all of them form a cell behind the others. Regions that
   `DEPTH` such rounds leave too large, or whose windows would send more sets than blocks, are parted in blocks, each
   pair of which is a region. Where only classes are wanted, as in `dedup`, partners of the drawn pivots are tied to
   them, and blocks of the largest group tied together meet only the others.
5. A pair is told in the cell where both are at home or one is in the window of the other's, and of several gram
   regions that hold it in the one of its smallest common pivot.

Documents of one text are joined as one, with their number as a weight; `pairs` tells their pairs for each, `classes`
a row for each document.

Defined cases: rows with a null doc_id or text, or a text without words, have no partners. A text of fewer words
than n has one gram of them all; texts of any length are compared whole. Rows that repeat doc_id and text are one
document; rows that repeat a doc_id with another text are documents of their own, but no pair of one doc_id is
told; for `classes` they are partners like others, and a row of a null doc_id has no class. Of equally near pivots the first counts. Columns other than doc_id and text may have any names. An empty
table has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.llm import exact
from grafwerk.llm.common import cut, fresh, partitions, ranges, runs, slices, small, strings, thin, written
from grafwerk.llm.grams import sets

N, THRESHOLD = 3, 0.5
#: Documents that one task joins at once, pivots that split a larger region, and rounds of such splits.
LEAF, PIVOTS, DEPTH = 2_000, 16, 3
#: Radii of cells as parts of the distance sought: within a task one after the other, across tasks the first.
RADII = (0.5, 0.125)
#: Grams of their prefixes that partners must share, if they share as many; holders up to which a gram's pairs are listed.
SHARED, FEW = 3, 16
#: Lists of ids that take at most this many bytes go to the texts, in place of the texts to them.
IDS_BYTES = 64 << 20
#: Grams that a task holds before it hands them on.
HELD = 1_000_000
_BLOCK = "bucket int, base long, keys binary, docs binary"


def least(size: np.ndarray, threshold: float) -> np.ndarray:
    """Grams that a partner of a set of `size` must share with it."""
    return np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)


def _blocks(n: int, buckets: int):
    """Sorted blocks of (32 bits of the gram, document) by gram bucket; and blocks of (size, document) by document bucket, numbered below zero."""

    def told(keys: np.ndarray, docs: np.ndarray, group: np.ndarray, sign: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(group, kind="stable")
        group, keys, docs = group[order], keys[order], docs[order]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a, b in zip(edge[:-1], edge[1:]):
            base = int(docs[a:b].min())
            wide = int(docs[a:b].max()) - base >= 1 << 32
            off = (docs[a:b] - base).astype(np.uint64 if wide else np.uint32)
            for o, v in zip(out, (int(group[a]) * sign - (sign < 0), base, keys[a:b].tobytes(), off.tobytes())):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["bucket", "base", "keys", "docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        sizes: list[tuple[int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            g = np.concatenate(grams)
            d = np.repeat(np.array([x for x, _ in sizes], np.int64), [x for _, x in sizes])
            bucket = ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
            yield from told(g.astype(np.uint32), d, bucket, 1)
            del g, bucket
            d, s = np.array([x for x, _ in sizes], np.int64), np.array([x for _, x in sizes], np.uint32)
            yield from told(s, d, _home(d, buckets), -1)

        for part in slices(batches, "text"):
            data, at = strings(part.column("text"))
            for doc, s in zip(part.column("doc_id").to_pylist(), sets(data, at, n)):
                if len(s):
                    grams.append(s)
                    sizes.append((doc, len(s)))
                    held += len(s)
                    if held >= HELD:
                        yield from flush()
                        grams, sizes, held = [], [], 0
        if held:
            yield from flush()

    return run


def _home(docs: np.ndarray, buckets: int) -> np.ndarray:
    return ((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _unpacked(base: list[int], docs: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.frombuffer(d, np.uint32 if len(d) == 4 * n else np.uint64).astype(np.int64) + b for b, d, n in zip(base, docs, sizes)])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest takes, first bytes first, so that they compress."""
    wide = np.dtype(next(f"u{k}" for k in (1, 2, 4, 8) if k == 8 or int(x.max(initial=0)) < 1 << 8 * k))
    return x.astype(wide).view(np.uint8).reshape(-1, wide.itemsize).T.tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    wide = len(raw) // n
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, n).T).view(f"u{wide}")[:, 0].astype(np.int64)


#: What is sent to a bucket: ascending documents as a base and steps, and up to three numbers of each.
_SENT = "bucket int, source int, base long, n int, docs binary, x binary, y binary, z binary"


def _send(bucket: int, source: int, doc: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cells: list = [bucket, source, int(doc[0]), len(doc), _packed(np.diff(doc, prepend=doc[:1])), *(_packed(x[order]) for x in more)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cells + [b""] * (8 - len(cells)), kinds)], [c.split()[0] for c in _SENT.split(", ")])


def _sends(to: np.ndarray, source: int, doc: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(to, kind="stable")
    to, doc, more = to[order], doc[order], tuple(x[order] for x in more)
    edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else []
    for a, b in zip(edge[:-1], edge[1:]):
        yield _send(int(to[a]), source, doc[a:b], *(x[a:b] for x in more))


def _received(group: pa.Table, more: int) -> list[np.ndarray]:
    """Source, document and the numbers of all that was sent to a bucket."""
    out: list[list] = [[] for _ in range(2 + more)]
    for row in group.to_pylist():
        n = row["n"]
        cells = (np.full(n, row["source"]), row["base"] + np.cumsum(_numbers(row["docs"], n)), *(_numbers(row[c], n) for c in "xyz"[:more]))
        for o, v in zip(out, cells):
            o.append(v)
    return [np.concatenate(o) for o in out]


def _recurring(buckets: int):
    """From the blocks of a gram bucket the ranks of grams that recur, rarest first, by document bucket; blocks of sizes pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "bucket"):
            bucket = group.column("bucket")[0].as_py()
            key = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint32)
            doc = _unpacked(group.column("base").to_pylist(), group.column("docs").to_pylist(), [len(k.as_buffer()) // 4 for k in group.column("keys")])
            del group
            if bucket < 0:
                yield _send(-1 - bucket, -1, doc, key)
                continue
            low = int(doc.min())
            if int(doc.max()) - low < 1 << 32:
                both = key.astype(np.uint64)
                both <<= np.uint64(32)
                doc -= low
                both |= doc.view(np.uint64)
                both.sort()
                key = (both >> np.uint64(32)).astype(np.uint32)
                both &= np.uint64(0xFFFFFFFF)
                doc = both.view(np.int64)
                doc += low
            else:
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            df = np.diff(np.append(start, len(key)))
            many = df > 1
            start, df = start[many], df[many]
            rank = np.empty(len(df), np.int64)
            rank[np.argsort(df, kind="stable")] = np.arange(len(df))
            doc, rank = doc[ranges(start, df)], np.repeat(rank, df)
            yield from _sends(_home(doc, buckets), bucket, doc, rank)

    return run


def _prefixes(threshold: float, buckets: int):
    """The prefixes of documents that could have a partner, by gram bucket: rank, size, and how many recurring grams there are from this one on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "bucket"):
            source, doc, value = _received(group, 1)
            del group
            told = source < 0
            ids, size = doc[told], value[told]
            order = np.argsort(ids)
            ids, size = ids[order], size[order]
            # Ranks count alike in all buckets; with the bucket they order all grams, about by rarity.
            doc, gram = doc[~told], value[~told] * buckets + source[~told]
            at = np.searchsorted(ids, doc)
            count = np.bincount(at, minlength=len(ids))
            need = least(size, threshold)
            keep = (count >= need)[at]
            at, gram = at[keep], gram[keep]
            if not len(at):
                continue
            order = np.lexsort((gram, at))
            at, gram = at[order], gram[order]
            nth = np.arange(len(at)) - np.searchsorted(at, np.arange(len(ids)))[at]
            # Grams of one hash are one place: the first.
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])])
            nth = nth[np.flatnonzero(new)[np.cumsum(new) - 1]]
            # Of the prefix of size - need + SHARED grams the ones that don't recur come first.
            inside = nth < (count - need + SHARED)[at]
            at, gram, left = at[inside], gram[inside], (count[at] - nth)[inside]
            yield from _sends(gram % buckets, 0, ids[at], gram // buckets, size[at], left)

    return run


def _mates(size: np.ndarray, left: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether holders i and j of a gram could be partners that have it among their first common ones; how many of those prefixes must share."""
    need = np.maximum(1, np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)).astype(np.int64)
    share = np.minimum(SHARED, need)
    apart = np.minimum(size[i], size[j]) < threshold * np.maximum(size[i], size[j]) - 1e-9
    return ~apart & (np.minimum(left[i], left[j]) > need - share), share


def _holders(threshold: float, buckets: int):
    """Of grams with few holders in prefixes their possible pairs (a, b) and how many grams those must share; of others (pivot, holder) and 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "bucket"):
            _, doc, rank, size, left = _received(group, 3)
            del group
            order = np.lexsort((doc, rank))
            doc, rank, size, left = doc[order], rank[order], size[order], left[order]
            start = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            count = np.diff(np.append(start, len(rank)))
            end = np.repeat(start + count, count)
            few = np.repeat(count <= FEW, count)
            out: list[list[np.ndarray]] = [[], [], []]

            def tell(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> None:
                for o, v in zip(out, (a, b, share)):
                    o.append(v)

            for step in range(1, min(FEW, int(count.max()))):
                i = np.flatnonzero(few[: len(doc) - step] & (np.arange(len(doc) - step) + step < end[: len(doc) - step]))
                good, share = _mates(size, left, i, i + step, threshold)
                good &= doc[i] != doc[i + step]
                tell(doc[i[good]], doc[i[good] + step], share[good])
            for a, n in zip(start[count > FEW].tolist(), count[count > FEW].tolist()):
                these = np.arange(a, a + n)
                if n <= 1024:
                    i, j = (x.ravel() for x in np.meshgrid(these, these))
                    good, _ = _mates(size, left, i, j, threshold)
                    these = these[(good & (doc[i] != doc[j])).reshape(n, n).any(axis=0)]
                own = np.unique(doc[these])
                if len(own) > 1:
                    tell(np.full(len(own), own[0]), own, np.zeros(len(own), np.int64))
            if out[0]:
                a, b, share = map(np.concatenate, out)
                yield from _sends(_home(a, buckets), 0, a, b - a, share)

    return run


def _regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, hot): pairs that share as many grams of their prefixes as they must, and the holders b of hot grams by pivot a."""
    for group in runs(batches, "bucket"):
        _, a, more, share = _received(group, 2)
        del group
        order = np.lexsort((share, more, a))
        a, more, share = a[order], more[order], share[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (more[1:] != more[:-1]) | (share[1:] != share[:-1])]))
        enough = np.diff(np.append(first, len(a))) >= share[first]
        first = first[enough]
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(a[first] + more[first]), pa.array(share[first] == 0)], ["a", "b", "hot"])


def _sets(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, at = strings(part.column("text"))
            packed = pa.array([s.tobytes() for s in sets(data, at, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), packed], ["doc", "grams"])

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def distance(a: np.ndarray, b: np.ndarray) -> float:
    both = overlap(a, b)
    return 1 - both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class Region:
    """Sets of one region, with the places of every gram, so that one pass gives a set's overlaps with all.

    Of a gram that most members have, those without it are listed: two sets share all such grams but what either
    lacks, plus what both lack. Near copies have few such places, and would have nearly all others.
    """

    def __init__(self, members: list[np.ndarray]) -> None:
        self.members = members
        m = len(members)
        self.sizes = np.array([len(x) for x in members], np.int64)
        owner = np.repeat(np.arange(m), self.sizes)
        every = np.concatenate(members)
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        gram = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))[: len(every)]
        count = np.bincount(gram)
        common = count * 2 > m
        self.common = int(common.sum())
        held = common[gram]
        lacking = np.ones((self.common, m), bool)
        lacking[(np.cumsum(common) - 1)[gram[held]], owner[held]] = False
        lacked, who = np.nonzero(lacking)
        self.lacks = np.bincount(who, minlength=m)
        gram, self.owner = np.concatenate([gram[~held], len(count) + lacked]), np.concatenate([owner[~held], who])
        new = np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)]
        edge = np.append(np.flatnonzero(new), len(gram))
        nth = np.cumsum(new)
        self.start, self.end = edge[nth - 1], edge[nth]
        self.mine = np.argsort(self.owner, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=m))])

    def overlaps(self, i: int, later: bool = False) -> np.ndarray:
        """How many grams each member (or each later one) shares with member i."""
        at = self.mine[self.first[i] : self.first[i + 1]]
        start = at + 1 if later else self.start[at]
        shared = np.bincount(self.owner[ranges(start, self.end[at] - start)], minlength=len(self.members))
        shared += self.common - self.lacks[i] - self.lacks
        if later:
            shared[: i + 1] = 0
        return shared


def _near(sizes: np.ndarray, size: int, shared: np.ndarray, threshold: float) -> np.ndarray:
    # Compared as counts: no rounding at the threshold.
    return shared >= threshold * (size + sizes - shared) - 1e-9


def cells(region: Region, threshold: float, radius: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pivot, its partners, their similarities, others at home, window) of each Voronoi cell of a region.

    Members further than `radius` from all pivots before become pivots, in their order; everyone is at home with the
    nearest. Partners are those of the pivot itself, at home or in the window, so that a cell of one is settled.
    """
    m = len(region.members)
    nearest, home = np.full(m, np.inf), np.full(m, -1)
    rows = []
    for i in range(m):
        if nearest[i] <= radius:
            continue
        shared = region.overlaps(i)
        at = np.flatnonzero(shared)
        shared = shared[at]
        far = 1 - shared / (region.sizes[i] + region.sizes[at] - shared)
        closer = (far < nearest[at]) & (far <= radius)
        nearest[at[closer]], home[at[closer]] = far[closer], len(rows)
        nearest[i], home[i] = 0.0, len(rows)
        reach = far <= radius + (1 - threshold) + 1e-9
        rows.append((i, at[reach], shared[reach], far[reach]))
    for k, (i, at, shared, far) in enumerate(rows):
        own = home[at] == k
        widest = far[own].max(initial=0.0)
        window = (home[at] > k) & (far <= widest + (1 - threshold) + 1e-9)
        good = (own | window) & (at != i) & _near(region.sizes[at], region.sizes[i], shared, threshold)
        similar = shared[good] / (region.sizes[i] + region.sizes[at[good]] - shared[good])
        yield i, at[good], similar, at[own & (at != i)], at[window]


def within(members: list[np.ndarray], threshold: float, radii: Sequence[float] = RADII) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, Jaccard similarity), in arrays, for all pairs i < j of sets that reach the threshold, each once."""
    region = Region(members)
    if not radii:
        for i in range(len(members) - 1):
            shared = region.overlaps(i, later=True)
            j = np.flatnonzero(shared)
            both = shared[j]
            good = _near(region.sizes[j], region.sizes[i], both, threshold)
            if good.any():
                j, both = j[good], both[good]
                yield np.full(len(j), i), j, both / (region.sizes[i] + region.sizes[j] - both)
        return
    for i, js, near, home, window in cells(region, threshold, radii[0] * (1 - threshold)):
        if len(js):
            yield np.minimum(i, js), np.maximum(i, js), near
        if len(home) and len(home) + len(window) > 1:
            # The rest of the cell: pairs at home, and of home and window.
            inner = np.concatenate([home, window])
            inner.sort()
            inside = np.isin(inner, home)
            for a, b, near in within([members[x] for x in inner], threshold, radii[1:]):
                told = inside[a] | inside[b]
                if told.any():
                    yield inner[a[told]], inner[b[told]], near[told]


_MEMBER = "region string, pivot long, doc long, grams binary, pivots array<bigint>, weight long, away int, block int, crossed boolean"


def _found(batches: Iterable[pa.RecordBatch], threshold: float, once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """The documents of each region, their weights, and the pairs that are told there; `once` leaves pairs of several gram regions to one of them."""

    def told(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        members = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
        pivot = group.column("pivot")[0].as_py()
        pivots = group.column("pivots").to_pylist()
        away = group.column("away").to_numpy()
        block, crossed = group.column("block").to_numpy(), group.column("crossed")[0].as_py()
        heads = np.array([p[0] for p in pivots])
        for i, j, near in within(members, threshold):
            good = (away[i] & away[j]) == 0
            if crossed:
                good &= block[i] != block[j]
            sure = (heads[i] == pivot) & (heads[j] == pivot)
            for k in np.flatnonzero(good & ~sure).tolist() if once else ():
                good[k] = min(set(pivots[i[k]]).intersection(pivots[j[k]])) == pivot
            if good.any():
                yield i[good], j[good], near[good]

    for group in runs(batches, "region"):
        if group.num_rows > 1:
            group = group.sort_by("doc")
            yield group.column("doc").to_numpy(), group.column("weight").to_numpy(), told(group)


class _Forest:
    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def new(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs connect what wasn't connected before."""
        out = np.zeros(len(i), bool)
        root = np.array(self.root)
        maybe = np.flatnonzero(root[i] != root[j])
        for k, a, b in zip(maybe.tolist(), i[maybe].tolist(), j[maybe].tolist()):
            a, b = self.find(a), self.find(b)
            out[k] = a != b
            self.root[max(a, b)] = min(a, b)
        return out


def _joined(threshold: float, forest: bool):
    """The pairs of each region; as a forest, only as many of them as connect what they connect."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, found in _found(batches, threshold, not forest):
            trees = _Forest(len(doc))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0
            for i, j, near in found:
                if forest:
                    good = trees.new(i, j)
                    i, j, near = i[good], j[good], near[good]
                if len(i):
                    out.append((doc[i], doc[j], near))
                    held += len(i)
                if held >= 50_000:
                    yield _pairs(out)
                    out, held = [], 0
            yield _pairs(out)

    return run


def _linked(threshold: float):
    """A forest of each region's pairs (a, b) with 0; and (a, a) with the weight of the partners that a has there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, weight, found in _found(batches, threshold):
            trees, links = _Forest(len(doc)), np.zeros(len(doc), np.int64)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j, _ in found:
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                good = trees.new(i, j)
                out.append((doc[i[good]], doc[j[good]]))
            own = links > 0
            a, b = (np.concatenate([*(x[k] for x in out), doc[own]]) for k in range(2))
            more = np.concatenate([np.zeros(len(a) - int(own.sum()), np.int64), links[own]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more)], ["a", "b", "links"])

    return run


def _pairs(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, near = (np.concatenate([x[k] for x in out] or [np.zeros(0)]) for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(near)], ["a", "b", "jaccard"])


_PLACE = "region string, doc long, cells array<int>, mask int, ties array<long>, near array<double>"


def _places(threshold: float):
    """Of each member of a region, from regions in which the pivots come first: its cells, the last of which is its home, and the pivots that are its partners.

    A member is at home in the cell of its nearest pivot, and in the windows of cells before that; beyond the radius
    of all pivots it is at home in a last cell.
    """
    radius = RADII[0] * (1 - threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivots, heads = None, [], []
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for region, doc, raw in zip(batch.column("region").to_pylist(), batch.column("doc").to_pylist(), batch.column("grams").to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                if region != last:
                    last, pivots, heads = region, [], []
                if len(pivots) < PIVOTS:
                    pivots.append(own)
                    heads.append(doc)
                sizes, shared = np.array([len(p) for p in pivots]), np.array([overlap(own, p) for p in pivots])
                similar = shared / (sizes + len(own) - shared)
                far = 1 - similar
                nearest = int(far.argmin())
                home = nearest if far[nearest] <= radius else PIVOTS
                tied = np.flatnonzero(_near(sizes, len(own), shared, threshold)).tolist()
                window = np.flatnonzero(far[:home] <= radius + (1 - threshold) + 1e-9).tolist()
                for o, v in zip(rows, ([*window, home], sum(1 << k for k in tied), [heads[k] for k in tied], similar[tied].tolist())):
                    o.append(v)
            kinds = (pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("doc"), *(pa.array(v, k) for v, k in zip(rows, kinds))], [c.split()[0] for c in _PLACE.split(", ")])

    return run


def _largest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each region the pivots, as a mask, that its largest group tied together by pivots has."""
    for group in runs(batches, "region"):
        masks: dict[int, int] = {}
        for mask, count in zip(group.column("mask").to_pylist(), group.column("count").to_pylist()):
            for other in [m for m in masks if m & mask]:
                count += masks.pop(other)
                mask |= other
            masks[mask] = count
        most = max(masks, key=lambda m: (masks[m], m))
        yield pa.RecordBatch.from_arrays([pa.array([group.column("region")[0].as_py()]), pa.array([most], pa.int32())], ["region", "most"])


def _parted(members: DataFrame, leaf: int) -> DataFrame:
    """Members of regions in blocks, each pair of which is a region; but no pairs of blocks that are `inside`."""
    n = members.groupBy("region").agg(F.sum(F.col("inside").cast("long")).alias("in"), F.count("*").alias("all"))
    n = n.select("region", F.ceil(F.col("in") * 2 / F.lit(leaf)).cast("int").alias("k"), F.ceil((F.col("all") - F.col("in")) * 2 / F.lit(leaf)).cast("int").alias("m"))
    n = cut(n)
    placed = members.join(small(n, n.count()), "region")
    # Blocks inside have the numbers below k; without any others nothing is left to compare.
    placed = placed.withColumn("block", F.expr("IF(inside, pmod(xxhash64(doc), greatest(k, 1)), k + pmod(xxhash64(doc), greatest(m, 1)))").cast("int"))
    placed = placed.withColumn("with", F.explode(F.expr("IF(m = 0, NULL, sequence(IF(inside, k, 0), k + m - 1))")))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    # A block meets itself in a region of its own, told apart from those where it meets others.
    return placed.withColumn("region", F.concat_ws("/", "region", low, high)).withColumn("crossed", F.col("block") != F.col("with"))


def _split(members: DataFrame, sizes: DataFrame, threshold: float, leaf: int, ties: list[DataFrame] | None) -> DataFrame:
    """Split regions of more than `leaf` members until all fit into a task.

    `sizes` has the regions of more than that, with their `count`. Where windows would send more sets than blocks do, as
    in a group of near copies, which all are in each other's windows, a region is parted in blocks. With `ties` given,
    only what pairs connect matters: partners of pivots are tied to them there, as (a, b, jaccard), and members of the
    largest group that is tied together already aren't compared with each other.
    """
    order = [c.split()[0] for c in _MEMBER.split(", ")]
    done: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        sizes = cut(sizes)
        large = sizes.count()
        if not large:
            done.append(members.select(*order))
            break
        side = small(sizes.withColumnRenamed("count", "n"), large)
        done.append(members.join(side, "region", "left_anti").select(*order))
        members = cut(members.join(side, "region"))
        seen = members.select("region", "doc", "grams", F.xxhash64("doc", F.lit(depth)).alias("h"))
        seen = seen.repartition(partitions(members.sparkSession), "region").sortWithinPartitions("region", "h", "doc")
        placed = cut(seen.mapInArrow(_places(threshold), _PLACE))
        if ties is not None:
            tied = placed.select("doc", F.inline(F.arrays_zip("ties", "near"))).where("doc <> ties")
            ties.append(tied.select(F.least("doc", "ties").alias("a"), F.greatest("doc", "ties").alias("b"), F.col("near").alias("jaccard")))
            masks = placed.where("mask <> 0").groupBy("region", "mask").count()
            most = cut(masks.repartition("region").sortWithinPartitions("region").mapInArrow(_largest, "region string, most int"))
            inside = placed.join(small(most, large), "region").select("region", "doc", F.expr("(mask & most) <> 0").alias("inside"))
            done.append(_parted(members.join(inside, ["region", "doc"]), leaf).select(*order))
            break
        parts = placed.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").count()
        blocks = "{0} * IF({0} > " + str(leaf) + ", ceil({0} * 2 / " + str(leaf) + "), 1)"
        sent = parts.groupBy("region").agg(F.sum(F.expr(blocks.format("count"))).alias("sent"))
        paid = cut(sent.join(side, "region").where(F.expr("sent < " + blocks.format("n"))).select("region")) if depth < DEPTH else sizes.select("region").limit(0)
        paid = small(paid, large)
        done.append(_parted(members.join(paid, "region", "left_anti").withColumn("inside", F.lit(False)), leaf).select(*order))
        cells = placed.select("region", "doc", F.element_at("cells", -1).alias("home"), F.explode("cells").alias("cell"))
        members = members.join(paid, "region", "left_semi").drop("n").join(cells, ["region", "doc"])
        members = members.withColumn("away", F.expr(f"away | IF(cell = home, 0, {1 << depth})")).withColumn("region", F.concat_ws("/", "region", "cell")).select(*order)
        sizes = members.groupBy("region").count().where(F.col("count") > leaf)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def single(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of the rows that can have partners, one for each document; and where doc_ids repeat, what they are numbered by.

    Numbers stand for doc_ids then, in their order, and the second table has (doc, doc_id, mark) of each.
    """
    rows = thin(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    if every.where("n > 1").isEmpty():
        return rows, None
    marked = rows.withColumn("mark", F.md5("text"))
    order = cut(marked.select("doc_id", "mark").distinct().sort("doc_id", "mark").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    ahead = order.groupBy("part").agg(F.count("*").alias("size"))
    ahead = ahead.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    numbers = order.join(F.broadcast(ahead), "part")  # a row for each partition
    numbers = cut(numbers.select((F.col("at").bitwiseAND((1 << 33) - 1) + F.col("ahead")).alias("doc"), "doc_id", "mark"))
    return marked.dropDuplicates(["doc_id", "mark"]).join(numbers, ["doc_id", "mark"]).select(F.col("doc").alias("doc_id"), "text"), numbers


def _members(rows: DataFrame, n: int, threshold: float, leaf: int, weights: DataFrame | None = None, ties: list[DataFrame] | None = None) -> DataFrame:
    """The members of all regions of documents of distinct texts, those of a region together; `weights` has (doc, weight) where it isn't 1.

    If only what pairs connect matters, `ties` gets pairs that aren't found among the members; see `_split`.
    """
    buckets = partitions(rows.sparkSession)

    def sent(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    blocks = sent(rows.mapInArrow(_blocks(n, buckets), _BLOCK))
    posted = sent(blocks.mapInArrow(_recurring(buckets), _SENT))
    held = sent(posted.mapInArrow(_prefixes(threshold, buckets), _SENT))
    told = cut(sent(held.mapInArrow(_holders(threshold, buckets), _SENT)).mapInArrow(_regions, "a long, b long, hot boolean"))
    # A pair is in the region of the smallest mate of its smaller document, so that a group mostly has one region.
    few = told.where("NOT hot")
    both = few.select(F.col("a").alias("doc"), "b").unionByName(few.select(F.col("b").alias("doc"), F.col("a").alias("b")))
    low = both.groupBy("doc").agg(F.min("b").alias("low")).select(F.col("doc").alias("a"), F.least("doc", "low").alias("pivot"))
    placed = few.join(low, "a")
    edges = told.where("hot").select(F.col("a").alias("pivot"), F.col("b").alias("doc"))
    edges = edges.unionByName(placed.select("pivot", F.col("a").alias("doc"))).unionByName(placed.select("pivot", F.col("b").alias("doc"))).distinct()
    edges = edges.groupBy("doc").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))
    edges = edges.withColumn("weight", F.lit(1).cast("long")) if weights is None else edges.join(weights, "doc", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
    edges = cut(edges)
    wanted = edges.count()
    texts = rows.join(small(edges.select(F.col("doc").alias("doc_id")), wanted, IDS_BYTES), "doc_id", "left_semi")
    held = texts.mapInArrow(_sets(n), "doc long, grams binary").join(small(edges, wanted), "doc")
    members = held.select(
        F.explode("pivots").alias("pivot"), "doc", "grams", "pivots", "weight", F.lit(0).alias("away"), F.lit(0).alias("block"), F.lit(False).alias("crossed")
    ).withColumn("region", F.col("pivot").cast("string"))
    order = [c.split()[0] for c in _MEMBER.split(", ")]
    sizes = edges.select(F.explode("pivots").alias("region")).withColumn("region", F.col("region").cast("string")).groupBy("region").count().where(F.col("count") > leaf)
    members = _split(members.select(*order), sizes, threshold, leaf, ties)
    return members.repartition(buckets, "region").sortWithinPartitions("region")


def distinct_pairs(rows: DataFrame, n: int, threshold: float, forest: bool, leaf: int = LEAF) -> DataFrame:
    """(a, b, jaccard) of documents of distinct texts, a < b; as a forest, as many as connect what all connect, or some more."""
    ties: list[DataFrame] = []
    found = _members(rows, n, threshold, leaf, ties=ties if forest else None).mapInArrow(_joined(threshold, forest), "a long, b long, jaccard double")
    for more in ties:
        found = found.unionByName(more)
    return found


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """(doc_id, other_id, jaccard) for each pair of documents that reach the threshold, the larger doc_id first."""
    rows, numbers = single(docs)
    same = cut(exact.copies(rows))
    count = same.count()
    firsts = rows.join(small(same.select("doc_id"), count, IDS_BYTES), "doc_id", "left_anti")
    found = cut(distinct_pairs(firsts, n, threshold, False, leaf))
    groups = cut(same.select("copy_of", F.col("doc_id").alias("copy")).unionByName(same.select("copy_of", F.col("copy_of").alias("copy")).distinct()))
    k = groups.count()
    out = found
    for c in ("a", "b"):
        side = small(groups.withColumnsRenamed({"copy_of": c, "copy": f"{c}_copy"}), k)
        out = out.join(side, c, "left").withColumn(c, F.coalesce(f"{c}_copy", c)).drop(f"{c}_copy")
    # Copies of a text with words are at distance 0 of each other.
    word = F.col("text").rlike(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
    told = rows.where(word).select(F.col("doc_id").alias("copy_of")).join(small(groups.select("copy_of").distinct(), k), "copy_of", "left_semi")
    own = groups.join(small(told, k), "copy_of", "left_semi")
    twice = own.alias("x").join(own.alias("y"), F.expr("x.copy_of = y.copy_of AND x.copy < y.copy"))
    out = out.select("a", "b", "jaccard").unionByName(twice.select(F.col("x.copy").alias("a"), F.col("y.copy").alias("b"), F.lit(1.0).alias("jaccard")))
    if numbers is not None:
        for c in ("a", "b"):
            out = out.join(numbers.select(F.col("doc").alias(c), F.col("doc_id").alias(f"{c}_id")), c).drop(c).withColumnRenamed(f"{c}_id", c)
        out = out.where("a <> b")
    return out.select(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("other_id"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(doc, root): the smallest document that each document of `edges` (a, b) is connected to, by alternating star contractions."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # Large star: each larger neighbour of a node is tied to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least_of = big.groupBy("u").agg(F.min("v").alias("m"))
        tied = big.join(least_of, "u")
        new = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least_of.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(new)
        changed = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if changed:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("root"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """(doc_id, class_id, links) for each row of `docs`: the smallest doc_id that pairs connect its document to, and how many other documents it reaches the threshold with.

    Documents are told apart by doc_id and text, here also as partners; without partners one is its own class.
    """
    rows, numbers = single(docs)
    rows = rows.where(F.col("text").rlike(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"))
    same = cut(exact.copies(rows))
    count = same.count()
    firsts = rows.join(small(same.select("doc_id"), count, IDS_BYTES), "doc_id", "left_anti")
    weights = same.groupBy(F.col("copy_of").alias("doc")).agg((F.count("*") + 1).alias("weight"))
    found = cut(_members(firsts, n, threshold, leaf, weights).mapInArrow(_linked(threshold), "a long, b long, links long"))
    links = found.where("a = b").groupBy(F.col("a").alias("doc")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b").select("a", "b"))
    own = links.join(roots, "doc", "left").select("doc", F.coalesce("root", "doc").alias("root"), "links")
    # A document has the links of its text's first one, and all other copies.
    own = own.join(weights, "doc", "full").select("doc", F.coalesce("root", "doc").alias("root"), (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("links"))
    copies = same.select("doc_id", F.col("copy_of").alias("doc")).join(own, "doc").select(F.col("doc_id").alias("doc"), "root", "links")
    told = own.unionByName(copies)
    if numbers is None:
        every, key = docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id"
        told = told.withColumnRenamed("doc", "doc_id")
    else:
        every, key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("mark")), ["doc_id", "mark"]
        root = numbers.select(F.col("doc").alias("root"), F.col("doc_id").alias("root_id"))
        told = told.join(root, "root").join(numbers, "doc").select("doc_id", "mark", F.col("root_id").alias("root"), "links")
    told = cut(told)
    out = every.join(small(told, told.count()), key, "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def dedup(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """The rows of `docs` but those that are connected to a document of a smaller doc_id, with all their columns.

    Documents of one doc_id go by the order of their texts' digests; only those connected to one before them go.
    """
    rows, numbers = single(docs)
    same = cut(exact.copies(rows))
    count = same.count()
    firsts = rows.join(small(same.select("doc_id"), count, IDS_BYTES), "doc_id", "left_anti")
    tied = distinct_pairs(firsts, n, threshold, True, leaf).select("a", "b")
    tied = tied.unionByName(same.select(F.col("copy_of").alias("a"), F.col("doc_id").alias("b")))
    gone = components(tied).select("doc")
    name, mark = fresh(docs, "gone", "mark")
    if numbers is None:
        gone = cut(gone.withColumnRenamed("doc", name))
        return docs.join(small(gone, gone.count()), F.col("doc_id") == F.col(name), "left_anti")
    gone = cut(numbers.join(gone, "doc").select(F.col("doc_id").alias(name), F.col("mark").alias(mark)))
    return docs.join(small(gone, gone.count()), (F.col("doc_id") == F.col(name)) & (F.md5("text") == F.col(mark)), "left_anti")
