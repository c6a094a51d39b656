from collections import defaultdict

import numpy as np
import pytest

from grafwerk.llm import sharding


def naive(sizes, k):
    """Differencing by the definition, on plain lists."""
    parts = [sorted([s] + [0] * (k - 1)) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return sorted(parts[0], reverse=True)


@pytest.mark.parametrize("k", [2, 3, 8])
def test_differencing(k):
    rng = np.random.default_rng(k)
    sizes = rng.integers(1, 10_000, 60)
    slot, sums = sharding.difference(sizes, k)
    assert np.bincount(slot, weights=sizes, minlength=k).tolist() == sums.tolist()
    assert sums.max() - sums.min() <= np.ptp(naive(sizes.tolist(), k)) + sizes.min()
    assert sums.max() - sums.min() < sizes.mean()


def test_combining_keeps_all_parts():
    parts = [[9, 4, 0], [7, 7, 1], [3, 2, 2], [0, 0, 8]]
    sums, members = sharding.combine(parts, "abcd")
    assert sum(sums) == sum(map(sum, parts)) and sums == sorted(sums, reverse=True)
    assert sorted(x for m in members for x in m) == [(i, j) for i in "abcd" for j in range(3)]
    for s, m in zip(sums, members):
        assert s == sum(parts["abcd".index(i)][j] for i, j in m)


@pytest.mark.parametrize("leaf", [20_000, 9])
def test_groups_stay_whole_and_shards_are_even(spark, monkeypatch, leaf):
    monkeypatch.setattr(sharding, "LEAF", leaf)
    monkeypatch.setattr(sharding, "FAN", 2)
    rows = [(i, "x" * (50 + i * 37 % 400) + str(i % 80), 5) for i in range(160)] + [(500, None, 1), (501, None, 1), (502, "", 1), (503, "", 1), (502, "", 1)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 4).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    of, load = defaultdict(set), defaultdict(int)
    for r in got:
        if text[r["doc_id"]] is not None:
            of[text[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["bytes"]
    assert all(len(s) == 1 for s in of.values())
    assert max(load.values()) - min(load.values()) < 900
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
