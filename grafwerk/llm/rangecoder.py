"""Token ids as binary blocks, by an adaptive context-mixing range coder.

A block holds `LENGTH` ids and is coded by itself: its models start empty and its ids have a checksum. Three
models count the ids of the block so far: order 2 those that followed the same two ids, order 1 those that
followed the same id, order 0 all. After every id all of them know it. An id's probability is the weighted sum of
its shares in the three; the weights follow, by how much a context has seen, how often its model knew the id that
came. The sum's part of the range drives a 64-bit range coder.

The encoder knows all ids beforehand: what a context had counted before each id comes from sorts and tables
over ranks, and many blocks step through weights and coder side by side.

Defined cases: a null text is noted with a total of -1 and an empty one with 0, both without ids; a text of any
length runs on through as many blocks as it takes. Rows that repeat, also in doc_id alone, are told apart by their
place (chunk, nth) and each decoded. Other columns of the input, whatever their names, are not carried. An empty
table gives no blocks.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import slices, strings, thin

#: Default place of the ranks of a byte-level vocabulary, and its pattern of words.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Ids of a block, and bytes of text that are coded side by side.
LENGTH, CHUNK = 4096, 4 << 20
_TOTAL = 1 << 24
_GAIN = 32  # what one occurrence adds to an id's order-0 share of 1
_KEPT2, _KEPT1 = 1 << 20, 1 << 19  # what the lower orders keep at least
#: Blocks whose counts are worked out together, and group sizes up to which all pairs of a group are compared.
TOGETHER, _WIDTHS = 64, (4, 8, 16, 32, 64)
_CLASSES = 8  # contexts by how much they have seen: 0, 1, 2-3, 4-7, ... ids


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    return np.frexp(x.astype(np.float32))[1].astype(np.int32)


def _earlier(values: np.ndarray, equal: bool) -> list[np.ndarray]:
    """For each place of the rows of `values`: how many places before it have a smaller value, and maybe an equal one."""
    m, wide = values.shape
    out = [np.empty((m, wide), np.uint8) for _ in range(1 + equal)]
    step = max(1, (1 << 17) // wide)
    for k in range(0, m, step):
        here = np.ascontiguousarray(values[k : k + step].T)  # so that a distance between places is one pass
        hit = np.empty(here.shape, bool)
        for told, test in zip(out, (np.less, np.equal)):
            count = np.zeros(here.shape, np.uint8)
            for far in range(1, wide):
                test(here[:-far], here[far:], out=hit[far:])
                count[far:] += hit[far:].view(np.uint8)
            told[k : k + step] = count.T
    return out


def _ranked(values: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As `_earlier` for long rows, of which row k has size[k] values: how many values before each are smaller, and how many equal.

    Places and ranks are cut in stretches of 64. A table counts what lies in earlier stretches of both; pairs within
    a stretch of either are compared.
    """
    m, n = values.shape
    parts = -(-n // 64)
    wide = parts * 64
    at = np.arange(wide, dtype=np.uint32)
    key = np.full((m, wide), 1 << 29, np.uint32)  # behind all values
    np.left_shift(values, 13, out=key[:, :n], dtype=np.uint32)
    if size is not None:
        key[at >= size[:, None]] = 1 << 29
    key |= at
    key.sort(axis=1)
    turn = (key & 0x1FFF).astype(np.int32)
    key >>= 13
    first = np.zeros((m, wide), np.int32)
    np.multiply(at[1:], key[:, 1:] != key[:, :-1], out=first[:, 1:], casting="unsafe")
    np.maximum.accumulate(first, axis=1, out=first)
    equal = at.astype(np.int32) - first
    row = np.arange(m, dtype=np.int32)[:, None]
    cell = (row * parts + (turn >> 6)) * parts + (at >> 6).astype(np.int32)
    table = np.zeros((m, parts + 1, parts + 1), np.int32)
    table[:, 1:, 1:] = np.bincount(cell.ravel(), minlength=m * parts * parts).reshape(m, parts, parts)
    np.cumsum(table, axis=1, out=table)
    np.cumsum(table, axis=2, out=table)
    (less,) = _earlier((turn >> 6).astype(np.uint8).reshape(-1, 64), False)
    place = row * wide + turn
    out, same, rank = np.empty(m * wide, np.int32), np.empty(m * wide, np.int32), np.empty(m * wide, np.uint16)
    # Equal values before one have smaller ranks; they are taken off again.
    out[place] = table[:, :-1, :-1].reshape(-1)[cell] + less.reshape(m, wide) - equal
    same[place], rank[place] = equal, at
    (less,) = _earlier(rank.reshape(-1, 64), False)
    out += less.ravel()
    return out.reshape(m, wide)[:, :n], same.reshape(m, wide)[:, :n]


def _history(ids: np.ndarray, context: np.ndarray, skip: int, equal: bool) -> list[np.ndarray]:
    """What each id's context has counted before it: ids in all, smaller ids, and maybe the id itself."""
    m, n = ids.shape
    out = [np.zeros(m * n, np.int32) for _ in range(2 + equal)]
    if n <= skip:
        return out
    key = np.arange(m, dtype=np.uint64)[:, None] << np.uint64(45) | context.reshape(m, n) << np.uint64(13) | np.arange(n, dtype=np.uint64)
    key = np.sort(key[:, skip:].ravel())
    place = (key >> np.uint64(45)).astype(np.int32) * np.int32(n) + (key & np.uint64(0x1FFF)).astype(np.int32)
    key >>= np.uint64(13)
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    start = np.flatnonzero(new).astype(np.int32)
    size = np.diff(np.append(start, np.int32(len(key))))
    out[0][place] = np.arange(len(key), dtype=np.int32) - np.repeat(start, size)
    value = np.append(ids.ravel()[place], np.uint16(0))
    two = start[size == 2]
    later = place[two + 1]
    for told, hit in zip(out[1:], (np.less, np.equal)):
        told[later] = hit(value[two], value[two + 1])
    least = 2
    for wide in _WIDTHS:
        these = (size > least) & (size <= wide)
        if these.any():
            at = start[these][:, None] + np.arange(wide, dtype=np.int32)
            there = np.arange(wide) < size[these][:, None]
            where = place[at[there]]
            for told, part in zip(out[1:], _earlier(value[np.minimum(at, len(key))], equal)):
                told[where] = part[there]
        least = wide
    while least < n:
        wide, these = least * 2, (size > least) & (size <= least * 2)
        if these.any():
            at = start[these][:, None] + np.arange(wide, dtype=np.int32)
            there = np.arange(wide) < size[these][:, None]
            where = place[at[there]]
            for told, part in zip(out[1:], _ranked(value[np.minimum(at, len(key))], size[these])):
                told[where] = part[there]
        least = wide
    return out


def _standing(kind: np.ndarray, asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a context of the same kind was asked before in the block (a column), and how often it knew the id."""
    n, m = kind.shape
    kind = kind + (np.arange(m) * _CLASSES).astype(np.int32)
    more = asked.astype(np.int32) << 16 | known
    held, out = np.zeros(m * _CLASSES, np.int32), np.empty((n, m), np.int32)
    for t in range(n):
        np.take(held, kind[t], out=out[t])
        held[kind[t]] = out[t] + more[t]
    return out >> 16, out & 0xFFFF


def _seen(ids: np.ndarray) -> list[np.ndarray]:
    """For each id of the blocks (rows) what orders 2, 1 and 0 have counted before it: all (not 0), smaller ids, the id itself."""
    m, n = ids.shape
    more = np.zeros((m, n + 1), np.uint16)
    more[:, :n] = ids
    one = np.zeros(more.size, np.uint64)
    one[1:] = more.ravel()[:-1]
    two = np.zeros(more.size, np.uint64)
    two[1:] = one[:-1]
    all2, less2, own2 = (x.reshape(m, n + 1) for x in _history(more, two << np.uint64(16) | one, 2, True))
    all1, less1 = (x.reshape(m, n + 1) for x in _history(more, one, 1, False))
    # What the next id's context has counted is how often this context and id came before.
    own1, own0 = all2[:, 1:].copy(), all1[:, 1:]
    own1[:, 0] = 0
    return [x[:, :n] for x in (all2, less2, own2, all1, less1, own1, _ranked(ids)[0], own0)]


def _shares(ids: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of `_TOTAL` that each id (a row) of each block (a column) gets: its start and its width."""
    m, n = ids.shape
    ids = ids.astype(np.uint16)
    told = [np.empty((n, m), np.int16) for _ in range(8)]
    for k in range(0, m, TOGETHER):
        for x, y in zip(told, _seen(ids[k : k + TOGETHER])):
            x[:, k : k + TOGETHER] = y.T
    seen2, below2, own2, seen1, below1, own1, below0, own0 = told
    new = own2 == 0
    kind = np.minimum(_bits(np.concatenate([seen2, seen1], axis=1)), _CLASSES - 1)
    asked, known = _standing(kind, np.concatenate([seen2 > 0, new & (seen1 > 0)], axis=1), np.concatenate([own2 > 0, new & (own1 > 0)], axis=1))
    del kind, new
    start, width = np.empty((n, m), np.uint64), np.empty((n, m), np.uint64)
    step = max(1, (1 << 16) // max(1, m))
    for t in range(0, n, step):
        s = slice(t, t + step)
        # All products stay below 2**53 and quotients keep away from the next integer, so that these floors are exact.
        w2 = np.floor((known[s, :m] + 1.0) * (_TOTAL - _KEPT2) / (asked[s, :m] + 2)) * (seen2[s] > 0)
        w1 = np.floor((known[s, m:] + 1.0) * (_TOTAL - _KEPT1 - w2) / (asked[s, m:] + 2)) * (seen1[s] > 0)
        rest, total = _TOTAL - w2 - w1, (wide + _GAIN * np.arange(n)[s])[:, None]
        below = ids[:, s].T + _GAIN * below0[s].astype(np.float64)
        begin = np.floor(rest * below / total)
        end = np.floor(rest * (below + 1 + _GAIN * own0[s].astype(np.float64)) / total)
        for w, seen, less, own in ((w2, seen2, below2, own2), (w1, seen1, below1, own1)):
            w, n_seen = w, np.maximum(seen[s], 1)
            begin += np.floor(w * less[s] / n_seen)
            end += np.floor(w * (less[s] + own[s]) / n_seen)
        start[s], width[s] = begin, end - begin
    return start, width


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, wide: int) -> list[bytes]:
    """Code the rows of `ids`, of which row k has lengths[k] ids, each to a string of bytes."""
    m, n = ids.shape
    start, width = _shares(ids, wide)
    dead = np.arange(n)[:, None] >= lengths
    start[dead], width[dead] = 0, _TOTAL
    room = n + 4
    out = np.zeros(m * room, np.uint32)
    base = np.arange(m) * room + 1  # a word before each, for a carry that never comes
    end = base.copy()
    low = np.zeros(m, np.uint64)
    size = np.full(m, 0xFFFFFFFFFFFFFFFF, np.uint64)
    s24, s32, one = np.uint64(24), np.uint64(32), np.uint64(1) << np.uint64(32)

    def carry(rows: np.ndarray) -> None:
        for r in rows.tolist():
            k = end[r] - 1
            while out[k] == 0xFFFFFFFF:
                out[k] = 0
                k -= 1
            out[k] += 1

    for t in range(n):
        part = size >> s24
        new = low + part * start[t]
        over = new < low
        if over.any():
            carry(np.flatnonzero(over))
        size = part * width[t]
        short = size < one
        out[end] = new >> s32
        end += short
        shift = short * s32
        low = new << shift
        size <<= shift
    new = low + (one - np.uint64(1))
    carry(np.flatnonzero(new < low))
    out[end] = new >> s32
    end += 1
    return [out[a:b].tobytes() for a, b in zip(base.tolist(), end.tolist())]


class _Model:
    """The counts of one context in the decoder: its ids in order, each as often as it came."""

    def __init__(self) -> None:
        self.ids: list[int] = []

    def part(self, weight: int, i: int) -> int:
        """The part of `weight` that ids below `i` have."""
        return weight * bisect_left(self.ids, i) // (len(self.ids) or 1)


def decode_block(raw: bytes, n: int, wide: int) -> np.ndarray:
    """The ids of one block."""
    words = np.frombuffer(raw, np.uint32).tolist() + [0, 0, 0]
    code, at = (words[0] << 32) | words[1], 2
    low, size = 0, (1 << 64) - 1
    contexts: dict[tuple[int, ...], _Model] = {}
    none, order0 = _Model(), _Model()
    asked = {(o, c): [0, 0] for o in (1, 2) for c in range(_CLASSES)}
    ids: list[int] = []
    mask = (1 << 64) - 1
    for t in range(n):
        one = contexts.setdefault((ids[-1],), _Model()) if t >= 1 else none
        two = contexts.setdefault((ids[-2], ids[-1]), _Model()) if t >= 2 else none
        of2 = asked[2, min(len(two.ids).bit_length(), _CLASSES - 1)]
        of1 = asked[1, min(len(one.ids).bit_length(), _CLASSES - 1)]
        w2 = (of2[1] + 1) * (_TOTAL - _KEPT2) // (of2[0] + 2) if two.ids else 0
        w1 = (of1[1] + 1) * (_TOTAL - _KEPT1 - w2) // (of1[0] + 2) if one.ids else 0
        rest, total = _TOTAL - w2 - w1, wide + _GAIN * t

        def start(i: int) -> int:
            return two.part(w2, i) + one.part(w1, i) + rest * (i + _GAIN * bisect_left(order0.ids, i)) // total

        part = size >> 24
        value = min(((code - low) & mask) // part, _TOTAL - 1)
        i, above = 0, wide - 1
        while i < above:
            middle = (i + above + 1) // 2
            if start(middle) <= value:
                i = middle
            else:
                above = middle - 1
        begin, end = start(i), start(i + 1)
        knew2, knew1 = (bisect_right(x.ids, i) > bisect_left(x.ids, i) for x in (two, one))
        if two.ids:
            of2[0] += 1
            of2[1] += knew2
        if one.ids and not knew2:
            of1[0] += 1
            of1[1] += knew1
        if t >= 2:
            insort(two.ids, i)
        if t >= 1:
            insort(one.ids, i)
        insort(order0.ids, i)
        ids.append(i)
        low = (low + part * begin) & mask
        size = part * (end - begin)
        if size < 1 << 32:
            low = (low << 32) & mask
            size <<= 32
            code = ((code << 32) & mask) | words[at]
            at += 1
    return np.array(ids, np.int32)


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The worker's tokenizer of a file of ranks."""
    if path not in _tokenizers:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _tokenizers[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[path]


_SHAPE = "chunk bigint, first bigint, doc_ids array<bigint>, starts array<bigint>, counts array<int>, totals array<bigint>, n_ids int, checksum bigint, payload binary"


def _written(path: str, length: int):
    names = [x.split()[0] for x in _SHAPE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]

    def pack(chunk: int, docs: list, flat: np.ndarray, at: np.ndarray, wide: int) -> pa.RecordBatch:
        n = max(1, -(-len(flat) // length))
        ids = np.zeros(n * length, np.int32)
        ids[: len(flat)] = flat
        ids = ids.reshape(n, length)
        lengths = np.minimum(length, np.maximum(0, len(flat) - np.arange(n) * length))
        payloads = encode_blocks(ids[:, : int(lengths.max(initial=1)) or 1], lengths, wide)
        cols: list[list] = [[] for _ in names]
        doc = 0
        for b in range(n):
            lo, hi = b * length, b * length + int(lengths[b])
            first = doc
            rows: list[list] = [[], [], [], []]
            while doc < len(docs):
                begin, end = int(at[doc]), int(at[doc + 1])
                a, e = max(begin, lo), min(end, hi)
                if begin >= hi and not (begin == end == hi and (b == n - 1)):
                    break
                doc_id, total = docs[doc]
                for c, v in zip(rows, (doc_id, a - begin, e - a, total)):
                    c.append(v)
                if end > hi:
                    break
                doc += 1
            raw = ids[b, : int(lengths[b])].astype(np.uint32).tobytes()
            for c, v in zip(cols, (chunk, first, *rows, int(lengths[b]), zlib.crc32(raw), payloads[b])):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        wide = tok.n_vocab
        if wide > 1 << 16:
            raise ValueError("ids of more than 16 bits aren't supported")
        # A task that runs again numbers its chunks alike.
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 32
        docs: list[tuple] = []
        flat = array("i")
        at, held = [0], 0

        def packed() -> pa.RecordBatch:
            return pack(chunk, docs, np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.array(at, np.int64), wide)

        # Batches end anywhere: what is left of one is coded with the next, as every chunk takes as many steps as a full one.
        for part in slices(batches, "text", max(1, CHUNK // 16)):
            size = int(strings(part.column("text"))[1][-1])
            if docs and held + size > CHUNK:
                yield packed()
                docs, flat, at, held = [], array("i"), [0], 0
                chunk += 1
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = tok.encode_ordinary(t) if t else []
                flat.extend(array("i", ids))
                docs.append((i, -1 if t is None else len(ids)))
                at.append(len(flat))
            held += size
        if docs:
            yield packed()

    return run


def write(docs: DataFrame, path: str = RANKS, length: int = LENGTH) -> DataFrame:
    """Blocks of coded ids: which parts of which documents each holds, the number and checksum of its ids, and its bytes.

    `chunk` numbers what was coded together, and `first` is the place in it of the block's first document.
    """
    if not 1 <= length <= LENGTH:
        raise ValueError(f"a block has 1 to {LENGTH} ids")
    return thin(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_written(path, length), _SHAPE)


def _read(path: str):
    names = ["chunk", "nth", "doc_id", "total", "start", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = tokenizer(path).n_vocab
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"], row["n_ids"], wide)
                if zlib.crc32(ids.astype(np.uint32).tobytes()) != row["checksum"]:
                    raise ValueError("a block's checksum is wrong")
                ends = np.concatenate([[0], np.cumsum(row["counts"])]).astype(int)
                n = len(row["doc_ids"])
                nth = range(row["first"], row["first"] + n)
                longs = ([row["chunk"]] * n, nth, row["doc_ids"], row["totals"], row["starts"])
                parts = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), pa.array(parts, pa.list_(pa.int32()))], names)

    return run


def read(blocks: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids) from blocks, each checked against its checksum; a null text's ids are null."""
    parts = blocks.mapInArrow(_read(path), "chunk long, nth long, doc_id long, total long, start long, ids array<int>")
    whole = parts.groupBy("chunk", "nth", "doc_id", "total").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p"))
    return whole.select("doc_id", F.when(F.col("total") >= 0, F.flatten("p.ids")).alias("ids"))
