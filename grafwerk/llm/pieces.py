"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut at its spaces into words, none of which a piece crosses. Distinct words of equal length advance
together: at each position the hash of every ending substring is looked up among the pieces, and the best way
to end there is stored as a backpointer.

For a unigram model a way's value is its sum of piece scores. A model of merges has no such sums: its way is
the one in which every two neighbours are a pair that merging would leave apart, which decides for one piece at
each position; so there the step from piece to piece is allowed or not, and the result equals the merges'.

Words longer than `LONG` characters are cut into windows that advance together, each begun `AHEAD` characters
early. A step depends on the steps of the longest piece's length before it, so that a window that agrees with the
one before on as many positions goes on as the whole word would; one that doesn't is stepped through again from
the state of the one before.

Characters without a piece become byte pieces (or the unknown piece, in a model without those).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import ranges, slices, strings, thin

#: Default place of the model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of words, about, that a worker remembers, and words that advance together at most.
REMEMBERED, TOGETHER = 40 << 20, 20_000
#: Bytes of text that a task encodes at once.
CHUNK = 2 << 20
#: Characters of words that are cut into windows, of a window, and before it.
LONG, WINDOW, AHEAD = 1024, 256, 64
_BASE = np.uint64(0x9E3779B97F4A7C55)
_NONE = -1


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        elif key & 7 == 1:
            value, at = raw[at : at + 8], at + 8
        elif key & 7 == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Vocabulary:
    """Pieces as arrays: ids start with the characters, then the longer pieces from the first merge on."""

    names: list[str]  # by model id
    kinds: list[int]  # 1 ordinary, 2 unknown, 3 control, 6 byte
    merges: bool
    dummy: bool
    squeeze: bool
    unknown: int
    bytes_: list[int]
    ids: np.ndarray  # model id of each inner number
    keys: np.ndarray  # sorted hashes
    of_key: np.ndarray  # inner number of each hash
    size: np.ndarray  # characters of each inner piece
    power: np.ndarray  # _BASE ** size
    own: np.ndarray  # hash of each inner piece
    score: np.ndarray
    left: np.ndarray  # the halves of each inner piece; itself if it is a character
    right: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        # A direct table over the high bits of the keys; a probe then looks at the few keys of one cell.
        self.bits = 18
        cell = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(cell, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The inner number of the piece of each hash, or -1."""
        cell = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        out = np.full(hashes.shape, _NONE, np.int32)
        live = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            if not len(live):
                break
            hit = self.keys[at[live]] == hashes[live]
            out[live[hit]] = self.of_key[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def _hash(points: Sequence[int]) -> int:
    h = 0
    for c in points:
        h = (h * int(_BASE) + _spread_int(c)) & 0xFFFFFFFFFFFFFFFF
    return h


def _spread_int(c: int) -> int:
    x = (c + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 29)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF


def _spread(c: np.ndarray) -> np.ndarray:
    x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _merged(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last merge on the way from characters to the piece, if merging leads there."""
    parts = list(piece)
    while len(parts) > 2:
        at = [(rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best, i = min(at)
        if best == 1 << 30:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file whose normalisation is the identity."""
    pieces: list[tuple[str, float, int]] = []
    kind_of_model, dummy, squeeze, fallback = 1, True, True, False
    with open(path, "rb") as f:
        raw = f.read()
    for tag, value in fields(raw):
        if tag == 1:
            p = dict(fields(value))
            pieces.append((p.get(1, b"").decode(), float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]), p.get(3, 1)))
        elif tag == 2:
            t = dict(fields(value))
            kind_of_model, fallback = t.get(3, 1), bool(t.get(35, 0))
        elif tag == 3:
            t = dict(fields(value))
            if t.get(2):
                raise ValueError("models with a normalisation table aren't supported")
            dummy, squeeze = bool(t.get(3, 1)), bool(t.get(4, 1))
    if kind_of_model not in (1, 2):
        raise ValueError("only unigram models and models of merges are supported")
    merges = kind_of_model == 2
    usable = [i for i, (_, _, kind) in enumerate(pieces) if kind in (1, 4)]
    if any(SPACE in pieces[i][0].lstrip(SPACE) for i in usable):
        raise ValueError("a piece holds a space after another character")
    usable.sort(key=lambda i: (len(pieces[i][0]) > 1, -pieces[i][1] if merges else 0, i))
    names = [pieces[i][0] for i in usable]
    rank = {p: n for n, p in enumerate(names)}
    left = np.arange(len(names), dtype=np.int32)
    right = left.copy()
    if merges:
        for n, p in enumerate(names):
            if len(p) > 1 and (halves := _merged(p, rank)):
                left[n], right[n] = rank[halves[0]], rank[halves[1]]
    own = np.array([_hash([ord(c) for c in p]) for p in names], np.uint64)
    order = np.argsort(own)
    size = np.array([len(p) for p in names], np.int32)
    power = np.array([pow(int(_BASE), len(p), 1 << 64) for p in names], np.uint64)
    byte = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
    return Vocabulary(
        names=[p for p, _, _ in pieces],
        kinds=[k for _, _, k in pieces],
        merges=merges,
        dummy=dummy,
        squeeze=squeeze,
        unknown=next((i for i, (_, _, k) in enumerate(pieces) if k == 2), 0),
        bytes_=[byte[f"<0x{b:02X}>"] for b in range(256)] if fallback and len(byte) == 256 else [],
        ids=np.array(usable, np.int64),
        keys=own[order],
        of_key=order.astype(np.int32),
        size=size,
        power=power,
        own=own,
        score=np.array([pieces[i][1] for i in usable]),
        left=left,
        right=right,
        longest=int(size.max(initial=1)),
    )


class Encoder:
    """Encodes and decodes with one vocabulary, and remembers words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = v = vocabulary
        self._forget()
        # The bytes that each id stands for in a text.
        shown = [bytes([v.bytes_.index(i)]) if i in set(v.bytes_) else self._shown(i) for i in range(len(v.names))]
        self.bytes_size = np.array([len(x) for x in shown], np.int64)
        self.bytes_at = np.concatenate([[0], np.cumsum(self.bytes_size)])[:-1]
        self.bytes_all = np.frombuffer(b"".join(shown), np.uint8)
        self.asked = np.full(1 << 20, -1, np.int64)
        self.answer = np.zeros(1 << 20, bool)
        self.lines = not any("\n" in p for p in v.names)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _shown(self, i: int) -> bytes:
        kind = self.v.kinds[i]
        return b"" if kind == 3 else " \u2047 ".encode() if kind == 2 else self.v.names[i].replace(SPACE, " ").encode("utf-8", "surrogatepass")

    # Pairs of neighbours: undo the later merge of the two, step by step, and see whether another merge across
    # the border would have come before it.
    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) * len(self.v.ids) + b
        cell = (pair.astype(np.uint64) * _BASE >> np.uint64(44)).astype(np.int64)
        unknown = np.flatnonzero(self.asked[cell] != pair)
        out = self.answer[cell]
        if len(unknown):
            new, back = np.unique(pair[unknown], return_inverse=True)
            told = self._undone(new // len(self.v.ids), new % len(self.v.ids))
            out[unknown] = told[back]
            self.asked[cell[unknown]] = pair[unknown]
            # Of pairs that share a cell the last is kept; its answer goes with it.
            self.answer[cell[unknown]] = out[unknown]
        return out

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = self.v
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 30, np.int64)
        while len(live):
            met = v.find(v.own[a] * v.power[b] + v.own[b])
            stay = (met < 0) | (met >= limit)
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
            if not len(live):
                break
            # The later merge of the two is undone; characters are never undone.
            undo_a = (a > b) & (v.right[a] != a) | (v.left[b] == b)
            over = undo_a & (v.right[a] == a)
            out[live[over]] = True
            go = ~over
            live, a, b, limit, undo_a = live[go], a[go], b[go], limit[go], undo_a[go]
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, v.right[a], a), np.where(undo_a, b, v.left[b])
        return out

    def _batch(self, points: np.ndarray, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of one length: the inner piece that ends at each position (-1: a character without a piece), and backpointers.

        `given` has what ends at the first positions, where that is known.
        """
        v = self.v
        m, n = points.shape
        prefix = np.zeros((n + 1, m), np.uint64)
        spread = _spread(points.T)
        for i in range(n):
            prefix[i + 1] = prefix[i] * _BASE + spread[i]
        power = np.ones(n + 1, np.uint64)
        for i in range(n):
            power[i + 1] = np.uint64(int(power[i]) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
        last = np.full((n + 1, m), _NONE, np.int32)
        back = np.zeros((n + 1, m), np.int32)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0.0
        lone = float(v.score.min(initial=0.0)) - 10.0
        known = 0 if given is None else len(given)
        if known:
            last[:known] = given
        for i in range(max(1, known), n + 1):
            back[i] = i - 1
            open_ = np.arange(m)
            for k in range(min(i, v.longest), 0, -1):
                if not len(open_):
                    break
                piece = v.find(prefix[i, open_] - prefix[i - k, open_] * power[k])
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                rows, piece = open_[hit], piece[hit]
                if v.merges:
                    before = last[i - k, rows]
                    good = (before < 0) if i > k or known else np.ones(len(rows), bool)
                    ask = np.flatnonzero(~good)
                    if len(ask):
                        good[ask] = self._apart(before[ask], piece[ask])
                    value = np.where(good, 0.0, -np.inf)
                else:
                    value = best[i - k, rows] + v.score[piece]
                better = np.flatnonzero(value > best[i, rows])
                at = rows[better]
                best[i, at] = value[better]
                last[i, at] = piece[better]
                back[i, at] = i - k
                if v.merges:
                    # One piece at most can end here, so that a word with one is done.
                    done = np.zeros(m, bool)
                    done[at] = True
                    open_ = open_[~done[open_]]
            bare = np.isneginf(best[i])
            best[i, bare] = 0.0 if v.merges else best[i - 1, bare] + lone
        return last, back

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that aren't remembered yet."""
        by: dict[int, list[str]] = {}
        for w in words:
            if w and w not in self.known:
                by.setdefault(len(w), []).append(w)
        for n, group in by.items():
            if n > LONG and self.v.merges:
                for w in group:
                    ids = self._long(w)
                    self._keep([w], np.zeros(len(ids), np.int64), ids)
                continue
            for i in range(0, len(group), max(1, TOGETHER * 16 // max(n, 16))):
                part = group[i : i + max(1, TOGETHER * 16 // max(n, 16))]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                self._trace(part, points, *self._batch(points))

    def _trace(self, words: list[str], points: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        v = self.v
        m, n = points.shape
        at = np.full(m, n, np.int32)
        live = np.arange(m)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            piece = last[at[live], live]
            # A character without a piece is told as its place, below -1.
            steps.append((live, np.where(piece >= 0, v.ids[np.maximum(piece, 0)], -1 - at[live].astype(np.int64))))
            at[live] = back[at[live], live]
            live = live[at[live] > 0]
        owner = np.concatenate([o for o, _ in steps[::-1]])
        ids = np.concatenate([p for _, p in steps[::-1]])
        order = np.argsort(owner, kind="stable")
        self._keep(words, owner[order], ids[order])

    def _long(self, word: str) -> np.ndarray:
        """The ids of one long word, as `_trace` has them."""
        v = self.v
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, ahead = len(points), max(AHEAD, 2 * v.longest)
        wide = max(WINDOW, ahead)
        count = -(-n // wide)
        padded = np.zeros(ahead + count * wide, np.uint32)
        padded[ahead : ahead + n] = points
        windows = np.lib.stride_tricks.sliding_window_view(padded, ahead + wide)[::wide]
        last, back = np.full(n + 1, _NONE, np.int32), np.zeros(n + 1, np.int64)
        again: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
        for k in range(0, count, 2048):
            some = np.ascontiguousarray(windows[k : k + 2048])
            ends, backs = self._batch(some)
            if not k:
                first_end, first_back = self._batch(points[None, :wide])
                ends[ahead:, 0], backs[ahead:, 0] = _NONE, 0
                size = min(n, wide)
                last[: size + 1], back[: size + 1] = first_end[: size + 1, 0], first_back[: size + 1, 0]
            for j in range(1 if not k else 0, len(some)):
                at = (k + j) * wide
                size = min(wide, n - at)
                own, ways = ends[:, j], backs[:, j]
                # Position `ahead` of the window is `at` of the word.
                if (own[ahead - v.longest : ahead + 1] != last[at - v.longest : at + 1]).any():
                    seed = last[at - v.longest : at + 1]
                    key = some[j, ahead - v.longest :].tobytes(), seed.tobytes()
                    if key not in again:
                        e, b = self._batch(some[j : j + 1, ahead - v.longest :], seed[:, None])
                        again[key] = e[:, 0], b[:, 0]
                    e, b = again[key]
                    own, ways = e[v.longest :], b[v.longest :] - v.longest
                else:
                    own, ways = own[ahead:], ways[ahead:] - ahead
                last[at + 1 : at + size + 1] = own[1 : size + 1]
                back[at + 1 : at + size + 1] = ways[1 : size + 1] + at
        out = []
        ends_, backs_ = last.tolist(), back.tolist()
        at = n
        while at > 0:
            piece = ends_[at]
            out.append(int(v.ids[piece]) if piece >= 0 else -1 - at)
            at = backs_[at]
        return np.array(out[::-1], np.int64)

    def _keep(self, words: list[str], owner: np.ndarray, ids: np.ndarray) -> None:
        """Remember the ids of words, given in the words' order; characters without a piece are places below -1."""
        v, m = self.v, len(words)
        count = np.bincount(owner, minlength=m)
        if (ids < 0).any():
            ends = np.cumsum(count)
            got = np.split(ids, ends[:-1])
            for w in np.unique(owner[ids < 0]).tolist():
                parts = list(chain.from_iterable([p] if p >= 0 else self._bytes(words[w][-2 - p]) for p in got[w].tolist()))
                if not v.bytes_:
                    # Neighbouring unknown characters are one unknown piece.
                    parts = [p for i, p in enumerate(parts) if p != v.unknown or not i or parts[i - 1] != v.unknown]
                got[w] = np.array(parts, np.int64)
                count[w] = len(parts)
            ids = np.concatenate(got)
        first, n_known = self.used, len(self.known)
        if first + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        if n_known + m > len(self.at):
            more = np.zeros(max(len(self.at), m), np.int64)
            self.at, self.count = np.concatenate([self.at, more]), np.concatenate([self.count, more])
        self.pool[first : first + len(ids)] = ids
        self.used += len(ids)
        self.count[n_known : n_known + m] = count
        self.at[n_known : n_known + m] = first + np.cumsum(count) - count
        self.known.update(zip(words, range(n_known, n_known + m)))
        self.held += 4 * len(ids) + sum(map(len, words)) + 160 * m

    def _bytes(self, c: str) -> list[int]:
        return [self.v.bytes_[b] for b in c.encode("utf-8", "surrogatepass")] if self.v.bytes_ else [self.v.unknown]

    def words(self, text: str) -> list[str]:
        """The text with marks for spaces, cut before each run of them."""
        if self.v.squeeze:
            text = " ".join(text.split(" ")).strip(" ") if "  " not in text else " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        if self.v.dummy:
            text = " " + text
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.lines or "\n" not in text:
            return self._line(text)
        # No piece holds a line break, so that none crosses one.
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            out += self._line(line)
        return out

    @staticmethod
    def _line(text: str) -> list[str]:
        parts = text.split(" ")
        if "  " not in text and parts[-1]:
            out = [SPACE + p for p in parts[1:]]
            return [parts[0], *out] if parts[0] else out
        out, run = [], 0
        if parts[0]:
            out.append(parts[0])
        for p in parts[1:]:
            run += 1
            if p:
                out.append(SPACE * run + p)
                run = 0
        if run:
            out.append(SPACE * run)
        return out

    def flat(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        cut = [self.words(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        if self.held > REMEMBERED:
            self._forget()
            new = set(chain.from_iterable(cut))
        self.learn(new)
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        code = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(lengths.sum()))
        size = self.count[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets = ends[np.concatenate([[0], np.cumsum(lengths)])]
        return self.pool[ranges(self.at[code], size)], offsets

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        ids, at = self.flat(texts)
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]

    def unflat(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts of ids in a row, and where each text's begin."""
        size = self.bytes_size[ids]
        data = self.bytes_all[ranges(self.bytes_at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        if self.v.dummy:
            # The space that encoding put before the text goes again.
            starts = ends[:-1][ends[1:] > ends[:-1]]
            starts = starts[data[starts] == 32]
            gone = np.zeros(len(data) + 1, np.int64)
            gone[starts + 1] = 1
            ends = ends - np.cumsum(gone)[ends]
            keep = np.ones(len(data), bool)
            keep[starts] = False
            data = data[keep]
        return data, ends

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        data, _ = self.unflat(np.asarray(ids, np.int64), np.array([0, len(ids)]))
        return data.tobytes().decode("utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of this vocabulary, with the words that it remembers."""
    key = (len(vocabulary.names), int(vocabulary.own.sum()), vocabulary.merges)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _encoded(shared, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for part in slices(batches, "text", CHUNK):
            column = part.column("text")
            ids, at = e.flat(["" if t is None else t for t in column.to_pylist()])
            data, ends = e.unflat(ids, at)
            given, begin = strings(column)
            same = np.diff(ends) == np.diff(begin)
            if len(data) == len(given) and same.all() and not (data == given).all():
                same = np.array([(data[a:b] == given[a:b]).all() for a, b in zip(ends[:-1], ends[1:])], bool)
            elif not same.all():
                same = np.array([data[a:b].tobytes() == given[c:d].tobytes() for a, b, c, d in zip(ends[:-1], ends[1:], begin[:-1], begin[1:])], bool)
            null = np.asarray(column.is_null())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            kept = [part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(np.diff(at), pa.int32(), mask=null), pa.array(same, pa.bool_(), mask=null)], [*names, "ids", "n_ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for each row; `round_trip` tells whether decoding gives the text again.

    Defined cases: a null text has null ids, an empty one none. The mark U+2581 in a text is a space, as in the
    library, so that such a text's round trip fails. Texts of any length, with or without spaces, are encoded whole.
    Rows that repeat are encoded alike; of equal sums of a unigram model the one with the longer last piece is taken.
    Columns other than doc_id and text may have any names. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # tens of thousands of pieces: the model's size, not the table's
    return thin(docs).select("doc_id", "text").mapInArrow(_encoded(shared, ["doc_id"]), "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def _decoded(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else e.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decoded(shared), "doc_id long, text string")
