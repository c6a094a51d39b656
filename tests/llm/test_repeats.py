import random
from collections import defaultdict

import numpy as np
import pytest

from grafwerk.llm import repeats


def brute(rows, least):
    docs = {}
    for i, t in rows:
        if i is not None and t is not None and (i not in docs or t < docs[i]):
            docs[i] = t
    where = defaultdict(set)
    words = {i: t.split() for i, t in docs.items()}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = set()
    for i, w in words.items():
        span = None
        for k in range(len(w) - least + 1):
            ids = where[tuple(w[k : k + least])]
            if len(ids) > 1:
                if span and k <= span[1]:
                    span = [span[0], k + least, min(span[2], *ids)]
                else:
                    if span:
                        out.add((i, *span))
                    span = [k, k + least, min(ids)]
        if span:
            out.add((i, *span))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_transform_gives_bounded_prefixes(seed):
    rng = np.random.default_rng(seed)
    s = np.append(rng.integers(1, 4, 300), 0)
    order = repeats.suffixes(s, 12)
    got = repeats.prefixes(s, order, 12)
    tail = [tuple(s[i : i + 12].tolist()) for i in order]
    assert tail == sorted(tail)
    for k in range(1, len(s)):
        a, b = s[order[k - 1] :], s[order[k] :]
        n = min(len(a), len(b))
        same = int(np.argmin(np.append(a[:n] == b[:n], False)))
        assert got[k] == min(12, same)


def made(seed):
    r = random.Random(seed)
    passages = [[f"p{seed}{k}{j % 7}" if k % 2 else f"q{r.randrange(50)}" for j in range(r.randint(6, 40))] for k in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [f"w{r.randrange(30)}" for _ in range(r.randint(0, 20))]
            if r.random() < 0.5:
                p = r.choice(passages)
                w += p[r.randint(0, 3) :]
        rows.append((i, " \n".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[4][1] + " end")]
    return rows


@pytest.mark.parametrize(("seed", "least", "gram"), [(1, 8, 3), (2, 5, 5), (3, 12, 2)])
def test_passages_equal_brute_force(spark, seed, least, gram):
    rows = [*made(seed), (200, None), (201, ""), (None, made(seed)[3][1]), (202, "long " * 20_000), (203, "long " * 30)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, hash int, first int")
    got = {tuple(r) for r in repeats.passages(df, least, gram).collect()}
    assert got == brute(rows, least)


def test_empty_table(spark):
    assert repeats.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_repeat_a_doc_id_are_compared_each(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    rows = [(1, a), (5, "x " + a), (5, "y " + b), (5, "y " + b), (7, b + " z")]
    got = sorted(tuple(r) for r in repeats.passages(spark.createDataFrame(rows, "doc_id long, text string"), 8, 3).collect())
    assert got == [(1, 0, 12, 1), (5, 1, 13, 1), (5, 1, 13, 5), (7, 0, 12, 5)]
