import random
import re

import numpy as np
import pyarrow as pa
import pytest

from grafwerk.llm import jaccard

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def grams(text, n):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, t):
    sets = {i: grams(x, n) for i, x in rows if i is not None and x is not None}
    ids = sorted(sets)
    out = {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= t - 1e-12:
                    out[a, b] = j
    return out


def made(seed, groups=12, copies=6):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(1, copies)):
            w = [x if r.random() > 0.06 else "z" * r.randint(1, 9) for x in base]
            rows.append((len(rows), " ".join(w).replace("aa", r.choice(("aa", "Aa,", "AA")))))
    return rows


@pytest.mark.parametrize(("leaf", "n", "t"), [(2000, 3, 0.5), (2, 3, 0.5), (4, 1, 0.7), (3, 2, 0.9)])
def test_join_equals_brute_force(spark, leaf, n, t):
    rows = made(leaf + n)
    rows += [(900, None), (901, ""), (902, "!?"), (903, ""), (904, "one two"), (905, "One, two"), (906, "one two"), (None, rows[0][1]), (907, "w " * 30_000)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, pivot int, grams int")
    told = jaccard.pairs(df, n, t, leaf).collect()
    got = {(r["other_id"], r["doc_id"]): r["jaccard"] for r in told}
    assert len(got) == len(told)
    want = brute(rows, n, t)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_one_of_each_group_stays(spark):
    rows = made(5) + [(900, None), (901, ""), (903, "")]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows] + [(None, rows[0][1], 1)], "doc_id long, text string, gone int")
    out = jaccard.dedup(df)
    assert out.columns == df.columns
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted(brute(rows, 3, 0.5)):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {i for i, _ in rows if find(i) == i}
    # Empty texts are copies of each other.
    assert {r["doc_id"] for r in out.collect()} == want - {903} | {None}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "a long, b long, jaccard double")
    assert {tuple(r) for r in jaccard.components(e).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.pairs(df).count() == 0 and jaccard.dedup(df).count() == 0


def test_rows_that_repeat_a_doc_id_are_judged_each(spark):
    base = [f"w{i}" for i in range(40)]
    near, other = " ".join([*base[:-1], "zz"]), " ".join(f"u{i}" for i in range(40))
    rows = [(1, " ".join(base)), (5, near), (5, other), (5, other), (7, other + " more"), (7, None), (8, None), (8, "")]
    df = spark.createDataFrame([(i, x, 3) for i, x in rows], "doc_id long, text string, mark int")
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.dedup(df).collect()), key=str)
    # Of the group of (5, other) and 7 the first stays, with both its rows; the near copy of 1 goes.
    assert got == sorted([(1, " ".join(base)), (5, other), (5, other), (7, None), (8, None), (8, "")], key=str)
    assert sorted((r["other_id"], r["doc_id"]) for r in jaccard.pairs(df).collect()) == [(1, 5), (5, 7)]


def test_cells_windows_and_homes_at_the_defaults():
    """Every member is at home once, windows replicate, and cells hold every pair, with no other settings than the defaults."""
    rng = np.random.default_rng(4)
    bases = [rng.choice(5_000, 60, replace=False) for _ in range(3)]
    members = []
    for k in range(90):
        own = bases[k % 3].copy()
        change = rng.integers(0, 45)
        own[:change] = rng.integers(5_000, 9_000, change)
        members.append(np.unique(own).astype(np.uint64))
    region = jaccard.Region(members)
    homes, replicas = [], 0
    for i, _, _, home, window in jaccard.cells(region, jaccard.THRESHOLD, jaccard.RADII[0] * (1 - jaccard.THRESHOLD)):
        homes += [i, *home.tolist()]
        replicas += len(window)
    assert sorted(homes) == list(range(90)) and 20 < replicas
    got = {}
    for a, b, s in jaccard.within(members, jaccard.THRESHOLD):
        for x, y, z in zip(a.tolist(), b.tolist(), s.tolist()):
            assert x < y and (x, y) not in got
            got[x, y] = z
    want = {(x, y): 1 - jaccard.distance(members[x], members[y]) for x in range(90) for y in range(x + 1, 90)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= jaccard.THRESHOLD})


@pytest.mark.parametrize(("leaf", "few"), [(2000, 16), (3, 16), (2000, 1)])
def test_classes_equal_brute_force(spark, monkeypatch, leaf, few):
    """A row for each row, classes and numbers of links, also with copies, repeats and rows without words."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = made(8)
    rows += [(len(rows) + k, x) for k, (_, x) in enumerate(rows[::4] * 2)]
    rows += [(900, None), (901, ""), (902, "!?"), (903, ""), (904, "one two"), (905, "One, two"), (906, "one two"), (None, rows[0][1])]
    for repeats in ([], [(906, "one two"), (3, "one two"), (901, None)]):
        every = rows + repeats
        texts = sorted({r for r in every if None not in r})
        near = brute(list(enumerate(x for _, x in texts)), 3, 0.5)
        links = {k: sum(k in p for p in near) for k in range(len(texts))}
        least = {k: i for k, (i, _) in enumerate(texts)}
        for _ in texts:
            for a, b in near:
                least[a] = least[b] = min(least[a], least[b])
        want = [(i, least[texts.index((i, x))], links[texts.index((i, x))]) if None not in (i, x) else (i, i, 0) for i, x in every]
        df = spark.createDataFrame([(*r, 1, 2) for r in every], "doc_id long, text string, root int, links int")
        got = [tuple(r) for r in jaccard.classes(df, leaf=leaf).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_out_follow_the_input(spark):
    """Copies aren't expanded into pairs: as many rows as documents."""
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(i, text) for i in range(400)] + [(400, text + " more"), (401, "else")], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.classes(df).collect()}
    assert got == {i: (0, 400) for i in range(401)} | {401: (401, 0)}
    assert jaccard.classes(df.limit(0)).count() == 0


def test_chance_repeats_of_grams_bring_no_regions(spark):
    """Where every gram of a document recurs, but each in another document, no sets are sent to regions."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in part) for _ in range(2) for part in rng.permutation(3_000).reshape(100, 30)]
    df = spark.createDataFrame([*enumerate(texts), (900, texts[0] + " more words")], "doc_id long, text string")
    members = [r["doc"] for r in jaccard._members(df, 1, 0.5, jaccard.LEAF).collect()]
    assert {0, 900} <= {*members} and len(members) < 20
    assert [(r["other_id"], r["doc_id"]) for r in jaccard.pairs(df, 1).collect()] == [(0, 900)]


def test_postings_take_few_bytes():
    """What is sent of each recurring gram, which may be nearly all grams of a large table."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 120)) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7_000_000_000, 7_000_000_600)), "text": texts})
    blocks = pa.Table.from_batches(jaccard._blocks(2, 3)([batch])).sort_by("bucket")
    sent = pa.Table.from_batches(jaccard._recurring(3)(blocks.to_batches())).to_pylist()
    told = [r for r in sent if r["source"] >= 0]
    assert sum(len(v) for r in told for v in r.values() if isinstance(v, bytes)) < 6 * sum(r["n"] for r in told)
    # The documents of every rank are those that hold one gram.
    got = {}
    for r in told:
        for d, x in zip((r["base"] + np.cumsum(jaccard._numbers(r["docs"], r["n"]))).tolist(), jaccard._numbers(r["x"], r["n"]).tolist()):
            got.setdefault((r["source"], x), set()).add(d - 7_000_000_000)
    want = {}
    for k, x in enumerate(texts):
        for g in grams(x, 2):
            want.setdefault(g, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize("groups", [1, 3])
def test_large_groups_of_near_copies_are_sent_few_times(spark, groups):
    """Near copies are all in each other's windows, so that no split by pivots parts them; blocks do, and ties need few."""
    r = random.Random(7)
    bases = [[f"b{g}x{k}" for k in range(60)] for g in range(groups)]
    rows = [(i, " ".join(["all of these", *(x if r.random() > 0.05 else f"z{r.randint(0, 10**9)}" for x in bases[i % groups])])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = jaccard._members(df, 3, 0.5, jaccard.LEAF).count()
    # 120 documents are 12 blocks at most, each of which meets 12.
    assert jaccard._members(df, 3, 0.5, 20).count() <= 12 * whole
    assert jaccard._members(df, 3, 0.5, 20, ties=[]).count() <= whole
    near = brute(rows, 3, 0.5)
    linked = {(r["other_id"], r["doc_id"]) for r in jaccard.pairs(df, leaf=20).collect()}
    assert linked == near.keys()
    root = list(range(120))
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in jaccard.dedup(df, leaf=20).collect()} == {i for i in root if root[i] == i}
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.classes(df, leaf=20).collect()}
    assert got == {i: (root[i], sum(i in p for p in near)) for i in range(120)}


@pytest.mark.parametrize("leaf", [2, 5])
def test_one_of_each_group_stays_of_parted_regions(spark, monkeypatch, leaf):
    """Classes are the same where ties to few pivots and blocks of the others stand for all pairs."""
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rows = made(9, copies=16)
    root = list(range(len(rows)))
    near = brute(rows, 3, 0.5)
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in jaccard.dedup(df, leaf=leaf).collect()} == {i for i in range(len(rows)) if root[i] == i}


def test_a_region_of_near_copies_lists_what_they_lack():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    members = []
    for _ in range(120):
        copy = base.copy()
        copy[rng.integers(0, 200, 8)] = rng.integers(0, 1 << 60, 8)
        members.append(np.unique(copy))
    members += [np.unique(rng.integers(0, 1 << 60, 5).astype(np.uint64)) for _ in range(9)] + [np.zeros(0, np.uint64), base[:90].copy()]
    members[-1].sort()
    region = jaccard.Region(members)
    for i in range(len(members)):
        want = np.array([len(np.intersect1d(members[i], x)) for x in members])
        assert (region.overlaps(i) == want).all()
        assert (region.overlaps(i, later=True) == np.where(np.arange(len(members)) > i, want, 0)).all()
    # Not the 24,000 places of the grams themselves.
    assert len(region.owner) < 6_000
    want = {(i, j) for i in range(len(members)) for j in range(i) if jaccard.distance(members[i], members[j]) <= 0.5}
    got = [(int(b), int(a)) for i, j, _ in jaccard.within(members, 0.5) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and {p for p in got if len(members[p[0]]) and len(members[p[1]])} == {p for p in want if len(members[p[0]]) and len(members[p[1]])}
