import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from grafwerk.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
ENCODER = pieces.Encoder(pieces.load())
ODD = ["Hello  world\n\n ok", "  lead", "▁x y", "", " ", "a\tb", "naïve 日本 😀", "a\x00b", "trail  ", "     many     spaces      x", " \n \n", "\n", "123 --- ===>", "ééé" * 50]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = ENCODER.encode([text])[0]
    assert ids == LIBRARY.encode(text)
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


def test_random_pieces_in_a_row():
    r = random.Random(1)
    names = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    texts = ["".join(r.choice(names) for _ in range(r.randint(1, 8))) for _ in range(5000)]
    assert ENCODER.encode(texts) == LIBRARY.encode(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    ids = ENCODER.encode([text])[0]
    assert ids == LIBRARY.encode(text)
    assert ENCODER.decode(ids) == text.replace("▁", " ")


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    e = pieces.Encoder(ENCODER.v)
    texts = ["one two three", "four five six seven", "one two"]
    assert [e.encode([t])[0] for t in texts] == LIBRARY.encode(texts)


@pytest.mark.parametrize("kind", ["random", "letters", "base64", "a", "ab", "cjk", "odd"])
def test_long_texts_without_spaces(kind, monkeypatch):
    r = random.Random(kind)
    names = [LIBRARY.id_to_piece(i).replace("▁", "") for i in range(259, 32_000)]
    text = {
        "random": "".join(r.choice(names) for _ in range(1500)),
        "letters": "".join(r.choice("etaoinshrdlu") for _ in range(9000)),
        "base64": "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(9000)),
        "a": "a" * 9001,
        "ab": "ab=" * 3001,
        "cjk": "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(5000)),
        "odd": "".join(r.choice("a😀é\x00b=") for _ in range(6000)),
    }[kind]
    e = pieces.Encoder(ENCODER.v)
    assert e.encode([text])[0] == LIBRARY.encode(text)
    assert e.encode(["x " + text, text[1:]]) == LIBRARY.encode(["x " + text, text[1:]])


def test_a_megabyte_without_spaces_takes_seconds():
    import base64
    import time

    text = base64.b64encode(random.Random(3).randbytes(750_000)).decode()
    for t in (text, "a" * 1_000_000):
        began = time.process_time()
        ids = pieces.Encoder(ENCODER.v).encode([t])[0]
        assert time.process_time() - began < 60
        assert ENCODER.decode(ids) == t


def test_unigram_model_takes_the_best_sum():
    """A small unigram vocabulary against all segmentations."""
    import numpy as np

    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    scores = [0.0, -2.0, -3.0, -3.1, -3.2, -4.0, -5.5, -9.0, -4.1, -5.0, -4.4]
    hashes = np.array([pieces._hash([ord(c) for c in n]) for n in names[1:]], np.uint64)
    order = np.argsort(hashes)
    size = np.array([len(n) for n in names[1:]], np.int32)
    v = pieces.Vocabulary(names, [2] + [1] * 10, False, True, False, 0, [], np.arange(1, 11), hashes[order], order.astype(np.int32), size, np.array([pow(int(pieces._BASE), int(k), 1 << 64) for k in size], np.uint64), hashes, np.array(scores[1:]), np.arange(10), np.arange(10), 3)
    e = pieces.Encoder(v)

    def best(word):
        table = {0: (0.0, [])}
        for i in range(1, len(word) + 1):
            ways = [(table[j][0] + scores[names.index(word[j:i])], [*table[j][1], names.index(word[j:i])]) for j in range(i) if word[j:i] in names]
            table[i] = max(ways)
        return table[len(word)]

    r = random.Random(0)
    for _ in range(300):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        got = e.encode([word])[0]
        assert sum(scores[i] for i in got) == pytest.approx(best("▁" + word)[0])
    assert e.encode(["axxb"])[0].count(0) == 1


def test_operator(spark):
    rows = [(1, "a b", "x"), (None, "c", None), (2, None, "y"), (3, "", "z"), (1, "a b", "x"), (4, "▁", "m"), (5, "wort " * 60_000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode(df)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert by[2]["ids"] is None and by[2]["round_trip"] is None and by[3]["ids"] == [] and by[3]["round_trip"]
    assert by[5]["ids"] == LIBRARY.encode(rows[-1][1]) and by[5]["round_trip"] and not by[4]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()}
    assert back[1] == "a b" and back[2] is None and back[3] == "" and back[4] == " "
    assert pieces.encode(df.limit(0)).count() == 0
