import random

import numpy as np

from grafwerk.llm import fingerprint as fp


def whole(text):
    return sum(ord(c) * pow(fp.BASE, j, fp.PRIME) for j, c in enumerate(text)) % fp.PRIME


def test_residues():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, fp.PRIME, 2000), rng.integers(0, fp.PRIME, 2000)
    a[0] = b[0] = fp.PRIME - 1
    assert fp.mulmod(a.astype(np.uint64), b.astype(np.uint64)).tolist() == [int(x) * int(y) % fp.PRIME for x, y in zip(a, b)]


def test_spans_and_extensions():
    r = random.Random(2)
    for _ in range(200):
        a = "".join(r.choice("abé😀") for _ in range(r.randint(1, 80)))
        b = a[r.randrange(len(a)) :] + "".join(r.choice("abé😀") for _ in range(r.randint(1, 20)))
        x, y = fp.Prefixes(a), fp.Prefixes(b)
        assert x.span(0, x.n) == whole(a)
        i, j = r.randrange(len(a)), r.randrange(len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.extension(i, y, j) == n
        k = r.randint(0, min(len(a) - i, len(b) - j))
        assert x.same(i, y, j, k) == (a[i : i + k] == b[j : j + k])


def test_odd_rows(spark):
    head = "the same beginning of thirty-two "
    rows = [(3, head + "a long tail"), (1, head + "a longer tail"), (2, head + "a long tail"), (7, "short"), (8, None), (9, ""), (None, head + "zz"), (10, "y" * 100_000), (10, "y" * 100_000), (10, "y" * 50)]
    got = fp.longest(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, head int, mark int")).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[7, 5]["fingerprint"] == whole("short") and by[8, None]["fingerprint"] is None and by[9, 0]["fingerprint"] == 0
    assert (by[2, 44]["near_id"], by[2, 44]["common"]) == (1, len(head) + 6) and by[3, 44]["near_id"] == 1 and by[1, 46]["near_id"] == 2
    assert by[10, 100_000]["fingerprint"] == whole("y" * 100_000) and by[10, 100_000]["common"] == 50 and by[None, 35]["near_id"] == 1


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    """Contents whose fingerprints collide stay two contents."""
    rows = [(i, 0, 5, 77, "x" * 40 + c) for i, c in ((1, "a"), (2, "b"), (3, "b"), (4, "bc"))]
    import pyarrow as pa

    cols = [pa.array([r[k] for r in rows]) for k in range(5)]
    (out,) = fp._longest([pa.RecordBatch.from_arrays(cols, ["doc_id", "fingerprint", "mark", "head", "text"])])
    assert out.column("common").to_pylist() == [40, 41, 41] and out.column("near_id").to_pylist() == [2, 4, 2]


def test_longest_equals_all_pairs(spark):
    r = random.Random(3)
    head = "x" * fp.HEAD
    texts = [head + "".join(r.choice("aé") for _ in range(r.randint(0, 9))) for _ in range(150)]
    rows = [(None if r.random() < 0.2 else r.randrange(120), t) for t in texts] + [(500, "short"), (501, None), (502, "y" * 40)]
    got = fp.longest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {}
    for i, t in rows:
        if t is not None and len(t) >= fp.HEAD:
            of[t] = min((x for x in (of.get(t), i) if x is not None), default=None)

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = []
    for i, t in rows:
        near = [(-common(t, u), j) for u, j in of.items() if j is not None and t in of and u != t and u[: fp.HEAD] == t[: fp.HEAD]]
        n, j = min(near, default=(0, -1))
        want.append((i, None if t is None else whole(t), j, -n))
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((g["doc_id"], g["fingerprint"], g["near_id"], g["common"]) for g in got), key=key) == sorted(want, key=key)
    assert fp.longest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_content_of_a_head_has_a_neighbour(spark):
    head = "the same beginning of thirty-two "
    rows = [(1, head + "abcdef"), (2, head + "zz"), (3, head + "abcdxx"), (4, head + "zzz")]
    by = {x["doc_id"]: (x["near_id"], x["common"] - len(head)) for x in fp.longest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by == {1: (3, 4), 2: (4, 2), 3: (1, 4), 4: (2, 2)}
