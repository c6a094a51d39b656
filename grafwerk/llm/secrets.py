"""Secrets by a linear-chain conditional random field.

Words between white space are tagged as the begin of a secret, inside one, or outside. Features are a word's
shape, its beginning, the words around it and their shapes, and the file's language, size and share of digits.
The tags of a document are those of the best whole sequence, found by Viterbi's algorithm.

All words are scored. One that its score holds outside, by more than any tags of its neighbours could make up
for, is outside in every best sequence; such words part a document into chains exactly, and chains of many documents
advance together.

The field is fitted here, by its likelihood, to sentences made up by a seeded generator: secrets of common
forms, and harmless numbers, addresses, hashes and paths that resemble them.

Defined cases: a null or empty text has no secrets. A null language counts as another one. Words and texts of any
length are tagged as a whole; of sequences of equal score the one with the lower tags first is taken. Rows that
repeat have equal results, also with a null doc_id. Columns other than doc_id, text and lang may have any names. An
empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grafwerk.llm.common import mix, slices, strings, thin
from grafwerk.llm.words import PLAIN, SPACE, span_hash, split, sums

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
BITS = 16
#: Sentences that the fit uses, and its steps over them.
SENTENCES, EPOCHS = 12_000, 6
#: Parts of words that name secrets, in lower case.
NAMING = (b"pass", b"pwd", b"token", b"secret", b"key", b"auth", b"cred", b"phrase", b"mnemonic", b"pin", b"kennwort", b"geheim", b"contrase", b"clave")
_LANGS = ("en", "de", "fr", "es")
_SIGNS = b"=:_/+-.@\"'$*<>#%&"
_BLOCKED = -1e9


def _classes() -> list[np.ndarray]:
    def of(f) -> np.ndarray:
        return np.array([f(b) for b in range(256)], bool)

    digit = of(lambda b: 48 <= b <= 57)
    upper = of(lambda b: 65 <= b <= 90)
    lower = of(lambda b: 97 <= b <= 122)
    hexa = of(lambda b: 97 <= b <= 102)
    high = of(lambda b: b >= 128)
    return [digit, upper, lower, hexa, high, *(of(lambda b, s=s: b == s) for s in _SIGNS)]


_CLASSES = _classes()


class Words:
    """The words of some texts, with what their features need."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: Sequence[str | None]) -> None:
        self.start, self.end, seen, self.first = split(data, at, SPACE)
        self.at = at
        n = len(self.start)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        digits = self._count(data, _CLASSES[0])
        self.data, self.n = data, n
        self._hints()
        digit_share = np.add.reduceat(np.append(digits, 0), np.minimum(self.first[:-1], n)) * (np.diff(self.first) > 0)
        size = np.diff(at)
        lang = np.array([_LANGS.index(x) if x in _LANGS else len(_LANGS) for x in langs])
        self.file = np.stack([lang, np.log2(size + 1).astype(int) // 2, np.minimum(5, np.log2(1 + 200 * digit_share / (size + 1)).astype(int))])

    def _count(self, data: np.ndarray, kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=total[1:])
        return total[self.end] - total[self.start]

    def _hints(self) -> None:
        """Where assignments to names of secrets, and blocks, stand.

        `where`: 1 in a block of a key, 2 on a line behind an assignment to a name of secrets, 0 elsewhere.
        """
        data, n = self.data, self.n
        self.where = np.zeros(n, np.int8)
        self.lines = np.flatnonzero(data == 10)
        if not n:
            self.given = self.asked = np.zeros(0, np.int64)
            return
        sign = (data == 61) | (data == 58)
        signs = np.zeros(len(data) + 1, np.int32)
        np.cumsum(sign, out=signs[1:])
        inner = signs[self.end - 1] > signs[self.start]
        inner |= (self.end - self.start > 1) & sign[self.start] & ~sign[self.end - 1]
        ending = sign[self.end - 1]
        same = self.text[1:] == self.text[:-1]
        small = np.where(self.data - np.uint8(65) < 26, data | np.uint8(32), data)
        name = np.zeros(n, np.int8)
        for code, part in enumerate(NAMING, 1):
            at = np.flatnonzero((small[: len(small) - 1] == part[0]) & (small[1:] == part[1]))
            at = at[at + len(part) <= len(data)]
            for j in range(2, len(part)):
                at = at[small[at + j] == part[j]]
            word = np.searchsorted(self.start, at, "right") - 1
            name[word[(word >= 0) & (at + len(part) <= self.end[word])]] = code
        naming = name > 0
        # The line goes on behind `name=`, `name = ` and `name : `.
        given = naming & (inner | ending)
        given[:-1] |= naming[:-1] & same & sign[self.start[1:]]
        w = np.flatnonzero(given)
        # What is given, and whether in quotes: of the name's own word, or of the word behind the sign.
        value = np.minimum(n - 1, np.where(inner[w], w, np.where(ending[w], w + 1, w + 2)))
        quote = (data == 34) | (data == 39)
        quotes = np.zeros(len(data) + 1, np.int32)
        np.cumsum(quote, out=quotes[1:])
        quoted = np.where(inner[w], quotes[self.end[w]] > quotes[self.start[w]], quote[self.start[value]])
        self.given, self.asked = w, name[w].astype(np.int64) * 2 + quoted
        stop = np.append(self.lines, len(data))[np.searchsorted(self.lines, self.end[w])]
        stop = np.minimum(np.searchsorted(self.start, stop), self.first[self.text[w] + 1])
        self._mark(w + 1, stop, 2)
        raw = data.tobytes()
        if b"-----BEGIN" in raw:
            begin = np.searchsorted(self.start, [m.start() for m in re.finditer(rb"-----BEGIN", raw)], "right") - 1
            ends = np.searchsorted(self.start, [m.start() for m in re.finditer(rb"-----END", raw)], "right") - 1
            stop = np.append(ends, n)[np.searchsorted(ends, begin)]
            self._mark(begin + 1, np.minimum(stop, self.first[self.text[begin] + 1]), 1)

    def _mark(self, start: np.ndarray, stop: np.ndarray, kind: int) -> None:
        on = np.zeros(self.n + 1, np.int32)
        np.add.at(on, start, stop > start)
        np.subtract.at(on, stop, stop > start)
        self.where[np.cumsum(on)[:-1] > 0] = kind

    def _place(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word: where it stands, whether quotes are open on its line before it, and whether it begins the line.

        And again with the name that its line asks for, and whether what was given is in quotes.
        """
        at = self.start
        k = np.searchsorted(self.lines, at)
        head = np.maximum(self.at[self.text], np.append(0, self.lines + 1)[k])
        out = self.where.astype(np.int64)
        for quote in (34, 39):
            seen = np.zeros(len(self.data) + 1, np.int32)
            np.cumsum(self.data == quote, out=seen[1:])
            out = out * 2 + ((seen[at] - seen[head]) & 1)
        out = out * 2 + (np.append(0, self.end[:-1]) <= head)
        k = np.searchsorted(self.given, np.arange(self.n)) - 1  # the word itself is no block of its own
        on = (self.where == 2) & (k >= 0)
        return out, np.where(on, self.asked[np.maximum(k, 0)] if len(self.given) else 0, 0) * 32 + out

    def codes(self) -> Iterator[np.ndarray]:
        """Hashed feature numbers of all words, one feature after the other."""
        n, raw = self.n, self.data
        size = self.end - self.start
        length = np.maximum(1, size)
        count = [self._count(raw, kind) for kind in _CLASSES]
        digit, upper, lower, hexa, high = count[:5]
        share = [np.minimum(4, 5 * c // length) for c in (digit, upper, lower, high)]
        grade = np.minimum(9, np.log2(length).astype(int) * 2 + (length * length >= 2 << (2 * np.log2(length).astype(int))))
        marks = np.zeros(n, np.int64)
        for k, c in enumerate(count[5:]):
            marks |= (c > 0).astype(np.int64) << k
        letters = digit + upper + lower
        hexlike = (digit + hexa >= letters) & (digit > 0)
        form = np.where(letters == digit, 0, np.where(hexlike, 1, np.where(lower == 0, 2, np.where(upper == 0, 3, np.where(digit > 0, 4, 5)))))
        shape = ((grade * 5 + share[0]) * 5 + share[1]) * 6 + form
        del count, share
        prefix, plain = sums(raw), sums(PLAIN[raw])
        whole = span_hash(plain, self.start, self.end)
        first4, first8 = (span_hash(prefix, self.start, np.minimum(self.start + k, self.end)) for k in (4, 8))
        # What stands before the first sign of assignment, as `password` in `password=...`.
        sign = np.flatnonzero((raw == 61) | (raw == 58))
        k = np.searchsorted(sign, self.start)
        first_sign = np.append(sign, len(raw))[k]
        has = first_sign < self.end
        key = np.where(has, span_hash(plain, self.start, np.where(has, first_sign, self.start)), 0).astype(np.uint64)
        rest = np.where(has, np.minimum(5, np.log2(np.maximum(1, self.end - first_sign)).astype(int)), 9)
        del prefix, plain
        distinct = np.minimum(9, self._distinct() // 3)
        # Neighbours count as words only if they are words: what another secret says is no context.
        tame = (digit == 0) & (size < 32)
        looking = shape * 64 + np.minimum(63, marks % 61)

        def moved(x: np.ndarray, by: int, none: int, fit: np.ndarray | None = None) -> np.ndarray:
            """Each word's value of `x` for the word `by` places on, if that is of the same text."""
            out = np.full(n, none, x.dtype)
            if n > abs(by):
                here, there = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
                good = self.text[here] == self.text[there]
                if fit is not None:
                    good &= fit[there]
                out[here] = np.where(good, x[there], np.array(none, x.dtype))
            return out

        two, one, after = (moved(whole, by, 7, tame) for by in (-2, -1, 1))
        place, asked = self._place()
        parts = (
            lambda: shape,
            lambda: grade * 8 + form,
            lambda: marks,
            lambda: form * 16 + distinct,
            lambda: first4,
            lambda: first8,
            lambda: key,
            lambda: key * np.uint64(31) + (form * 16 + rest).astype(np.uint64),
            lambda: two,
            lambda: one,
            lambda: after,
            lambda: two * np.uint64(33) + one,
            lambda: one * np.uint64(31) + form.astype(np.uint64),
            lambda: (two * np.uint64(17) + one) * np.uint64(31) + (form * 16 + grade).astype(np.uint64),
            lambda: moved(looking, -1, -1),
            lambda: moved(looking, 1, -1),
            *(lambda f=f: f[self.text] * 8 + form for f in self.file),
            lambda: place * 8 + form,
            lambda: (place * 8 + form) * 16 + grade,
            lambda: asked * 8 + form,
            lambda: whole,
        )
        for i, part in enumerate(parts):
            x = np.asarray(part()).astype(np.int64).view(np.uint64) + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            yield (mix(x) >> np.uint64(64 - BITS)).astype(np.int32)

    def _distinct(self) -> np.ndarray:
        """How many different bytes each word has."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(inside, self.start, 1)
        np.subtract.at(inside, self.end, 1)
        on = np.cumsum(inside[:-1]) > 0
        word = np.repeat(np.arange(self.n, dtype=np.uint32), self.end - self.start)
        key = np.sort(word << np.uint32(8) | self.data[on])
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        return np.bincount(key[new] >> np.uint32(8), minlength=self.n)

    def chains(self, kept: np.ndarray) -> np.ndarray:
        """Where each run of neighbouring words of a text begins, among the ones kept; and the end of all."""
        if not len(kept):
            return np.zeros(1, np.int64)
        new = (kept[1:] != kept[:-1] + 1) | (self.text[kept[1:]] != self.text[kept[:-1]])
        return np.append(np.flatnonzero(np.append(True, new)), len(kept))


def slack(moves: np.ndarray) -> float:
    """What steps can gain at most by a word's being inside a secret rather than outside.

    If the word behind it was inside, that begins a secret of its own then: what this costs is not counted here.
    """
    gain = 0.0
    for a in range(3):
        for x in (BEGIN, INSIDE):
            for c in range(3):
                if min(moves[a, x], moves[x, c]) <= _BLOCKED / 2:
                    continue
                new = BEGIN if c == INSIDE else c
                on = max(0.0, float((moves[c] - moves[new])[moves[new] > _BLOCKED / 2].max())) if new != c else 0.0
                gain = max(gain, moves[a, x] + moves[x, c] - moves[a, OUTSIDE] - moves[OUTSIDE, new] + on)
    return gain


def viterbi(emission: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each chain. Before and after a chain stands an outside word; `moves[a, b]` scores a step."""
    tags = np.zeros(len(emission), np.int8)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    longest = int(size.max(initial=0))
    live = np.searchsorted(-size, -np.arange(longest), "left") if longest else np.zeros(0, int)
    if not longest:
        return tags
    score = emission[start] + moves[OUTSIDE]
    back: list[np.ndarray] = []
    ends = np.empty((len(start), 3))
    for t in range(1, longest + 1):
        on = int(live[t]) if t < longest else 0
        ends[on : len(score)] = score[on:] + moves[:, OUTSIDE]
        if not on:
            break
        way = score[:on, :, None] + moves[None]
        back.append(way.argmax(axis=1).astype(np.int8))
        score = way.max(axis=1) + emission[start[:on] + t]
    tag = ends.argmax(axis=1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        on = int(live[t])
        tags[start[:on] + t] = tag[:on]
        if t:
            tag[:on] = back[t - 1][np.arange(on), tag[:on]]
    return tags


# --- made-up sentences -------------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    w = "".join(r.choice(string.ascii_lowercase + "aeiouéüñ") for _ in range(r.randint(1, 10)))
    return (w.capitalize() if r.random() < 0.1 else w) + (r.choice(".,;:!?") if r.random() < 0.12 else "")


_COMMON = ("is", "was", "ist", "est", "es", "the", "of", "to", "und", "de", "it", "that")


def _prose(r: random.Random) -> str:
    """A word as prose has it: some are very common, some long."""
    x = r.random()
    return r.choice(_COMMON) if x < 0.15 else _some(r, string.ascii_lowercase + "aeiouéü", r.randint(8, 20)) if x < 0.25 else _word(r)


def _some(r: random.Random, letters: str, n: int) -> str:
    return "".join(r.choice(letters) for _ in range(n))


_HEX, _ALNUM, _UPPER = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
_NAMES = ("password", "passwd", "pwd", "pass", "token", "secret", "api_key", "apikey", "api-key", "secret_key", "access_token", "auth_token", "client_secret", "private_key", "auth", "key")
_SAFE = ("id", "commit", "sha1", "md5", "checksum", "order", "version", "uuid", "phone", "tel", "card", "date", "ref", "build", "size", "ip", "etag", "color", "page", "isbn")


#: Forms of secrets that tell themselves; and others, with other names, that the fit never sees.
_FORMS = (
    lambda r: r.choice(("AKIA", "ASIA")) + _some(r, _UPPER, 16),
    lambda r: r.choice(("ghp_", "gho_", "ghs_")) + _some(r, _ALNUM, 36),
    lambda r: r.choice(("sk-", "sk_live_", "pk_live_", "rk_test_")) + _some(r, _ALNUM, r.choice((24, 32, 48))),
    lambda r: "xox" + r.choice("bap") + "-" + _some(r, string.digits, 11) + "-" + _some(r, _ALNUM, 24),
    lambda r: "AIza" + _some(r, _ALNUM + "_-", 35),
    lambda r: "eyJ" + _some(r, _ALNUM, 20) + ".eyJ" + _some(r, _ALNUM, 30) + "." + _some(r, _ALNUM + "_-", 43),
    lambda r: _some(r, string.ascii_lowercase, r.randint(2, 5)) + r.choice("_-") + _some(r, _ALNUM, r.randint(20, 64)),
)
_UNSEEN = (
    lambda r: "glpat-" + _some(r, _ALNUM + "_-", 20),
    lambda r: "npm_" + _some(r, _ALNUM, 36),
    lambda r: "SG." + _some(r, _ALNUM, 22) + "." + _some(r, _ALNUM + "_-", 43),
    lambda r: "dop_v1_" + _some(r, _HEX, 64),
    lambda r: "hf_" + _some(r, string.ascii_letters, 34),
    lambda r: "shpat_" + _some(r, _HEX, 32),
    lambda r: "PMAK-" + _some(r, _HEX, 24) + "-" + _some(r, _HEX, 34),
)
_UNSEEN_NAMES = ("db_passwd", "signing_key", "encryption_key", "service_token", "masterkey", "smtp_pass", "credentials", "session_secret")


def _value(r: random.Random) -> str:
    kind = r.randrange(4)
    n = r.choice((16, 18, 20, 24, 32, 36, 40, 48, 64))
    return _some(r, _HEX, n) if kind < 2 else _some(r, _ALNUM, n) if kind == 2 else _some(r, _ALNUM + "!%^*_-", r.randint(9, 20)) + r.choice(string.digits)


def _short(r: random.Random) -> str:
    """A value of few characters, or of letters only."""
    kind = r.randrange(4)
    if kind == 0:
        return _some(r, string.ascii_lowercase, r.randint(3, 7)) + _some(r, string.digits, r.randint(1, 2))
    if kind == 1:
        value = list(_some(r, string.ascii_lowercase, r.randint(5, 8)))
        for i in r.sample(range(len(value)), 2):
            value[i] = r.choice(string.digits)
        return "".join(value)
    return _some(r, string.ascii_lowercase if kind == 2 else r.choice((string.ascii_lowercase, string.ascii_letters)), r.randint(12, 40))


def _secret(r: random.Random, unseen: bool = False) -> tuple[list[str], list[int]]:
    """Words of a secret in its setting, and their tags."""
    kind = r.randrange(16)
    if kind < 3:
        return [r.choice(_UNSEEN if unseen else _FORMS)(r)], [BEGIN]
    name = r.choice(_UNSEEN_NAMES if unseen else _NAMES)
    if r.random() < 0.15:
        name = r.choice(("db_", "aws_", "user_", "my_")) + name
    if r.random() < 0.15:
        name = name.upper()
    value = _value(r)
    quote = r.choice(('"', "'", "", ""))
    if kind < 6:
        return [name + r.choice("=:") + quote + value + quote], [BEGIN]
    if kind < 9:
        quote = r.choice(('"', "'", '"', ""))
        return [name, r.choice(("=", ":", ":=", "=")), quote + value + quote], [OUTSIDE, OUTSIDE, BEGIN]
    if kind == 9:
        return [name + ":", quote + value + quote], [OUTSIDE, BEGIN]
    if kind == 10:
        return [r.choice(("postgres", "mysql", "mongodb", "amqp")) + "://" + _word(r).strip(".,;:!?") + ":" + value + "@" + _some(r, string.ascii_lowercase, 6) + ".example:5432/db"], [BEGIN]
    if 11 < kind < 15:
        value = _short(r)
        if kind == 12:
            return [name + r.choice("=:") + quote + value + quote], [BEGIN]
        if kind == 13 and r.random() < 0.5:
            return [name, r.choice(("=", ":", ":=", "=")), quote + value + quote], [OUTSIDE, OUTSIDE, BEGIN]
        if kind == 13 or not any(c.isdigit() for c in value):
            return [name + r.choice(("=", ":", ":")), quote + value + quote], [OUTSIDE, BEGIN]
        return [name, r.choice(("is", "was", "ist", "est", "es")), quote + value + quote], [OUTSIDE, OUTSIDE, BEGIN]
    if kind == 15:
        words = [_some(r, string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(3, 12))]
        quote = r.choice(('"', "'", ""))
        name = r.choice(("passphrase", "phrase", "mnemonic", "recovery_phrase", "wallet_passphrase", "Passphrase") + (("password", "secret", "pass") if quote else ()))
        words[0], words[-1] = quote + words[0], words[-1] + quote
        tags = [BEGIN, *[INSIDE] * (len(words) - 1)]
        form = r.randrange(3)
        if form == 0:
            return [name + r.choice("=:") + words[0], *words[1:]], tags
        return ([name + r.choice("=:")] if form == 1 else [name, r.choice("=:")]) + words, [OUTSIDE] * form + tags
    lines = [_some(r, _ALNUM + "+/", 64) for _ in range(r.randint(2, 6))]
    if r.random() < 0.7:
        lines.append(_some(r, r.choice((_ALNUM, string.ascii_letters)), r.randint(1, 40)) + r.choice(("", "=", "==")))
    return ["-----BEGIN", r.choice(("RSA", "EC")), "PRIVATE", "KEY-----", *lines, "-----END", "RSA", "PRIVATE", "KEY-----"], [0, 0, 0, 0, BEGIN, *[INSIDE] * (len(lines) - 1), 0, 0, 0, 0]


def _harmless(r: random.Random) -> list[str]:
    digits = string.digits
    kind = r.randrange(25)
    if kind == 0:
        return ["+1", f"({_some(r, digits, 3)})", f"{_some(r, digits, 3)}-{_some(r, digits, 4)}"]
    if kind == 1:
        return [_some(r, digits, r.choice((8, 10, 12, 13, 15, 16, 16, 16, 19)))]
    if kind == 2:
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]
    if kind == 3:
        return [_some(r, string.ascii_lowercase, r.randint(3, 9)) + r.choice((".", "_", "")) + str(r.randint(1, 999)) + "@" + _some(r, string.ascii_lowercase, r.randint(3, 8)) + str(r.randint(1, 99)) + r.choice((".com", ".example.com", ".org"))]
    if kind == 4:
        return [f"{r.randint(1980, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" + r.choice(("", f"T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00Z"))]
    if kind == 5:
        return ["https://" + _some(r, string.ascii_lowercase, 8) + ".example/" + _some(r, string.ascii_lowercase, 5) + "/" + str(r.randint(1, 99999))]
    if kind == 6:
        return ["-".join(_some(r, _HEX, n) for n in (8, 4, 4, 4, 12))]
    if kind == 7:
        return [r.choice(_SAFE), *r.choice(((), ("=",), (":",))), _some(r, _HEX, r.choice((32, 40, 64)))]
    if kind == 8:
        return [r.choice(_SAFE) + r.choice("=:") + r.choice((_some(r, digits, r.randint(5, 12)), _some(r, _HEX, r.choice((8, 32, 40))), _some(r, string.ascii_lowercase, 12)))]
    if kind == 9:
        return [_word(r).strip(".,;:!?") + r.choice(("$$$", "***", "%%%", "&&&", "###")) for _ in range(r.randint(1, 4))]
    if kind == 10:
        return ["/" + "/".join(_some(r, string.ascii_lowercase, 5) for _ in range(3)) + "/file" + str(r.randint(0, 99)) + ".txt"]
    if kind == 11:
        return [_some(r, string.ascii_lowercase, r.randint(5, 12)) + str(r.randint(10, 9999))]
    if kind == 12:
        return [f"v{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 9999)}-rc{r.randint(1, 9)}"]
    if kind == 13:
        return ["<a", f"href=\"x{r.randint(1, 9999)}.html\">", f"{r.randint(1000, 999999999):,}.00"]
    if kind == 14:
        return [r.choice(("the", "a", "your", "my", "new")), r.choice(("password", "token", "secret", "key")), r.choice(("is", "was", "of", "must", "for")), r.choice(("required.", "wrong", "changed,", "needed"))]
    if kind == 15:
        return [r.choice(_NAMES) + ":", *(_word(r) for _ in range(r.randint(2, 8)))]
    if kind == 16:
        return [_word(r).strip(".,;:!?") + r.choice((":", "=", " :", " =")).strip(), *(_word(r) for _ in range(r.randint(1, 5)))]
    if kind == 17:
        return [r.choice(_NAMES), *(_word(r) for _ in range(r.randint(1, 4)))]
    if kind == 21:
        return [r.choice(_COMMON)] * r.randint(2, 9) + [_prose(r)]
    if kind == 22:
        return [_word(r).strip(".,;:!?"), r.choice(("is", "was", "ist", "est", "es")), *(_prose(r) for _ in range(r.randint(1, 3)))]
    if kind == 23:
        return [_word(r).strip(",;:!?") + r.choice((".", "", ",")) + str(r.randint(1, 99)) + "@mail" + str(r.randint(1, 20)) + ".example.com", _word(r)]
    if kind == 24:
        return [_word(r).strip(".,;:!?") + r.choice(("$$$", "***", "%%%", "&&&", "###")) + _some(r, string.ascii_lowercase + "é", r.randint(0, 3)) for _ in range(r.randint(1, 4))]
    if kind > 18:  # long ordinary words, in prose or in the cells of a table
        cell = r.choice(((), (), ("|",), ("-",)))
        words = ["".join(_word(r).strip(".,;:!?") for _ in range(r.randint(3, 7))) + r.choice(("", "", ".", ",", "!!")) for _ in range(r.randint(1, 3))]
        words = [w.upper() for w in words] if r.random() < 0.25 else words
        return [x for w in words for x in (*cell, w, *cell)]
    return ["TODO" + _some(r, string.ascii_uppercase, r.randint(12, 20)), _some(r, string.ascii_uppercase + "_", r.randint(16, 24))]


def sentences(n: int, seed: int, unseen: bool = False) -> tuple[list[str], list[list[int]], list[str]]:
    """Made-up texts, a tag for each of their words, and languages."""
    r = random.Random(seed)

    def own_line(w: list[str], t: list[int]) -> bool:
        """A phrase without quotes ends with its line."""
        return t[-1] == INSIDE and not re.search("[\"'][.,]?$", w[-1])

    texts, tags, langs = [], [], []
    for _ in range(n):
        words: list[str] = []
        own: list[int] = []
        for _ in range(r.randint(1, 3)):
            plain = [_prose(r) for _ in range(r.randint(0, 8))]
            words += plain
            own += [OUTSIDE] * len(plain)
            if r.random() < 0.45:
                w, t = _secret(r, unseen)
            else:
                w = _harmless(r)
                t = [OUTSIDE] * len(w)
            if r.random() < 0.1:
                w[-1] += r.choice(".,")
            if own_line(w, t) or r.random() < 0.15:
                w[-1] += "\n"
            words += w
            own += t
        plain = [_prose(r) for _ in range(r.randint(0, 6))]
        texts.append(" ".join(words + plain))
        tags.append(own + [OUTSIDE] * len(plain))
        langs.append(r.choice(_LANGS))
    return texts, tags, langs


class Field:
    """Weights of features by tag, and of steps between tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def scores(self, words: Words) -> np.ndarray:
        """The score of each tag of each word by itself."""
        out = np.zeros((words.n, 3), np.float32)
        for code in words.codes():
            out += self.weights[code]
        return out

    def tag(self, words: Words) -> np.ndarray:
        """The tag of each word in its document's best sequence."""
        out = np.zeros(words.n, np.int8)
        score = self.scores(words)
        # What the next word loses if it must begin a secret rather than go on in one.
        later = np.append(np.maximum(0, score[1:, INSIDE] - score[1:, BEGIN]), 0)[: words.n]
        sure = score[:, OUTSIDE] - np.maximum(score[:, BEGIN], score[:, INSIDE]) > slack(self.moves) + later + 1e-3
        kept = np.flatnonzero(~sure)
        out[kept] = viterbi(score[kept].astype(np.float64), words.chains(kept), self.moves)
        return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(n: int = SENTENCES, epochs: int = EPOCHS, seed: int = 11) -> Field:
    """Fit by AdaGrad steps on the conditional likelihood, with forward and backward sums over all chains of a batch."""
    texts, tags, langs = sentences(n, seed)
    column = pa.array(texts)
    words = Words(*strings(column), langs)
    codes, bounds = np.stack(list(words.codes()), axis=1), words.chains(np.arange(words.n))
    truth = np.concatenate([np.array(t) for t in tags])
    weights = np.zeros((1 << BITS, 3))
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = _BLOCKED
    allowed = moves > _BLOCKED / 2
    w2, m2 = np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2)
    rng = np.random.default_rng(seed)
    size, start = np.diff(bounds), bounds[:-1]
    for _ in range(epochs):
        mixed = rng.permutation(len(start))
        for k in range(0, len(mixed), 256):
            pick = mixed[k : k + 256]
            s, z = start[pick], size[pick]
            longest = int(z.max())
            place = np.minimum(s[:, None] + np.arange(longest), (s + z - 1)[:, None])
            on = np.arange(longest) < z[:, None]
            score = weights[codes[place]].sum(axis=2)
            ahead = np.empty((len(pick), longest, 3))
            behind = np.empty_like(ahead)
            ahead[:, 0] = score[:, 0] + moves[OUTSIDE]
            for t in range(1, longest):
                new = _sum(ahead[:, t - 1, :, None] + moves[None], 1) + score[:, t]
                ahead[:, t] = np.where(on[:, t, None], new, ahead[:, t - 1])
            behind[:, -1] = moves[:, OUTSIDE]
            for t in range(longest - 2, -1, -1):
                new = _sum(moves[None] + (score[:, t + 1] + behind[:, t + 1])[:, None], 2)
                behind[:, t] = np.where(on[:, t + 1, None], new, moves[:, OUTSIDE])
            total = _sum(ahead[:, -1] + moves[:, OUTSIDE], 1)
            p = np.exp(ahead + behind - total[:, None, None])
            y = truth[place]
            error = (p - np.eye(3)[y]) * on[:, :, None]
            flat = codes[place][on]
            used, at = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(at.ravel(), weights=np.repeat(e, flat.shape[1]), minlength=len(used)) for e in error[on].T], axis=1)
            step = np.zeros((3, 3))
            for a, b, there in [(np.zeros(len(pick), int), y[:, 0], np.ones(len(pick), bool))] + [(y[:, t - 1], y[:, t], on[:, t]) for t in range(1, longest)]:
                np.subtract.at(step, (a[there], b[there]), 1)
            last = y[np.arange(len(pick)), z - 1]
            np.subtract.at(step, (last, np.zeros(len(pick), int)), 1)
            step[OUTSIDE] += p[:, 0].sum(axis=0)
            step[:, OUTSIDE] += p[np.arange(len(pick)), z - 1].sum(axis=0)
            for t in range(1, longest):
                pair = ahead[:, t - 1, :, None] + moves[None] + (score[:, t] + behind[:, t])[:, None] - total[:, None, None]
                step += (np.exp(pair) * on[:, t, None, None]).sum(axis=0)
            grad = g / len(pick) + 1e-5 * weights[used]
            w2[used] += grad * grad
            weights[used] -= 0.2 * grad / np.sqrt(w2[used])
            step /= len(pick)
            m2 += step * step
            moves[allowed] -= (0.1 * step / np.sqrt(m2))[allowed]
    return Field(weights.astype(np.float32), moves)


@lru_cache(maxsize=1)
def fitted() -> Field:
    return fit()


def spans(words: Words, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last word of each secret: a begin and the insides after it."""
    begin = np.flatnonzero(tags == BEGIN)
    stop = np.ones(words.n + 1, bool)
    stop[1:-1] = (tags[1:] != INSIDE) | (words.text[1:] != words.text[:-1])
    cuts = np.flatnonzero(stop)
    last = cuts[np.searchsorted(cuts, begin, "right")] - 1 if len(begin) else begin
    return words.text[begin], begin, last


def _scanned(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for part in slices(batches, "text"):
            data, at = strings(part.column("text"))
            words = Words(data, at, part.column("lang").to_pylist())
            text, a, b = spans(words, field.tag(words))
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            begin, end = chars[words.start[a]] - chars[at[text]], chars[words.end[b]] - chars[at[text]]
            ids = part.column("doc_id").cast(pa.int64()).take(pa.array(text, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "begin", "end"])

    return run


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end) of each secret, in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted())  # 2**16 features by 3 tags, whatever the table
    return thin(docs).selectExpr("doc_id", "text", "cast(lang as string) as lang").mapInArrow(_scanned(shared), "doc_id long, begin long, end long")
