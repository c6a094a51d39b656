import math
from collections import Counter, defaultdict

import pytest

from grafwerk.llm import mixing

SHAPE = "doc_id long, source string, n_chars long, copies int"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, n, 7) for i, s, n in rows], SHAPE)


def test_pivots_keep_the_sum_and_each_probability():
    parts = [0.2, 0.7, 0.5, 0.9, 0.3, 0.4]
    hits = Counter()
    for seed in range(6000):
        done, held = mixing.pivot(list(enumerate(parts)), f"s{seed}")
        assert held is None
        assert sum(v for _, v in done) == 3 and len(done) == len(parts)
        for i, v in done:
            hits[i] += v
    for i, p in enumerate(parts):
        assert abs(hits[i] / 6000 - p) < 0.03


@pytest.mark.parametrize("leaf", [50_000, 7])
def test_totals_of_sources(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i, "abc"[min(2, i // 60)], 100 + i % 3) for i in range(200)]
    d = docs(spark, rows)
    rate = {r["source"]: r["rate"] for r in mixing.rates(d).collect()}
    assert min(rate.values()) == pytest.approx(1.0)
    mass = defaultdict(int)
    for _, s, n in rows:
        mass[s] += n
    for a in rate:
        for b in rate:
            assert rate[a] / rate[b] == pytest.approx((mass[a] / mass[b]) ** (mixing.TEMPERATURE - 1))
    total, n = Counter(), Counter(s for _, s, _ in rows)
    got = mixing.copies(d).collect()
    assert len(got) == 200
    for r in got:
        total[r["source"]] += r["copies"]
        assert math.floor(rate[r["source"]] + 1e-9) <= r["copies"] <= math.ceil(rate[r["source"]] - 1e-9) or rate[r["source"]] == pytest.approx(1)
    for s in n:
        assert abs(total[s] - n[s] * rate[s]) < 1


def test_nulls_repeats_and_columns(spark):
    d = docs(spark, [(1, "a", 10), (1, "a", 10), (None, "a", None), (2, None, 5), (None, None, None), (3, "z", 0)])
    assert mixing.copies(d).count() == 5
    out = mixing.mixed(d)
    assert out.columns == d.columns and out.count() >= 6
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert {(r["doc_id"], r["source"]) for r in out.collect()} == {(r["doc_id"], r["source"]) for r in d.collect()}


def plainly(units, rate, seed="mix"):
    """Copies of (doc_id, source) units of one source by pairs, one after the other, in plain steps."""
    whole = math.floor(rate + 1e-9)
    out, open_ = {}, None
    for step, i in enumerate(sorted(units)):
        q = rate - whole
        if q < 1e-9:
            out[i] = whole
            continue
        if open_ is None:
            open_ = (i, q)
            continue
        a, p = open_
        draw = mixing.unit(f"{seed}/0/{units[i]}/0", step, i)
        if p + q < 1:
            keeps, other = (a, i) if draw * (p + q) < p else (i, a)
            out[other], rest = whole, p + q
        else:
            other, keeps = (a, i) if draw * (2 - p - q) < 1 - q else (i, a)
            out[other], rest = whole + 1, p + q - 1
        open_ = (keeps, rest)
        if rest <= 1e-9 or rest >= 1 - 1e-9:
            out[keeps], open_ = whole + round(rest), None
    return out, open_


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.2, "c": 0.3}, {"a": 3, "c": 1}, {"b": 0.0, "c": 2}])
def test_copies_equal_plain_steps(spark, weights):
    rows = [(i, "abc"[min(2, i // 40)], 50 + i % 7) for i in range(150)]
    d = docs(spark, rows)
    rate = {r["source"]: r["rate"] for r in mixing.rates(d, weights=weights).collect()}
    got = {r["doc_id"]: r["copies"] for r in mixing.copies(d, weights=weights).collect()}
    assert len(got) == 150
    for s in "abc":
        units = {i: s for i, x, _ in rows if x == s}
        want, left = plainly(units, rate[s])
        for i, k in want.items():
            assert got[i] == k
        if left is not None:
            assert got[left[0]] - math.floor(rate[s] + 1e-9) in (0, 1)


def test_target_weights(spark):
    rows = [(i, "abc"[min(2, i // 300)], 100) for i in range(1000)]
    d = docs(spark, rows)
    want = {"a": 0.2, "b": 0.5, "c": 0.3}
    total = Counter()
    for r in mixing.copies(d, weights=want, chars=120_000).collect():
        total[r["source"]] += r["copies"] * 100
    for s, w in want.items():
        assert abs(total[s] - w * 120_000) <= 100
    rate = {r["source"]: r["rate"] for r in mixing.rates(d, weights={"a": 1, "b": 1}).collect()}
    assert rate == {"a": 1.0, "b": 1.0, "c": 0.0}
    assert {r["source"] for r in mixing.mixed(d, weights={"a": 1, "b": 1}).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        mixing.rates(d, weights={"a": -1})
    assert mixing.copies(docs(spark, []), weights={"a": 1}).count() == 0
    assert {r["copies"] for r in mixing.copies(docs(spark, [(1, None, 5), (2, None, 5)]), weights={None: 1}).collect()} == {1}
