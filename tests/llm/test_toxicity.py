import random

import numpy as np
import pyarrow as pa

from grafwerk.llm import toxicity
from grafwerk.llm.common import strings


def features(texts):
    data, at = strings(pa.array(texts))
    owner, ids = toxicity.features(data, at)
    return [np.unique(ids[owner == k]) for k in range(len(texts))]


def made(n, seed, biased=0.0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubdlnrst") for _ in range(r.randint(3, 9))) for _ in range(400)]
    texts, toxic = [], []
    for _ in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.3
        if bad and r.random() > biased:
            w[r.randrange(len(w))] = r.choice(("scumbag", "idiotic", "worthless"))
        if r.random() < (0.8 if bad else 0.05) and biased:
            w.insert(r.randrange(len(w)), "muslim")
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def scores(model, texts):
    data, at = strings(pa.array(texts))
    return toxicity.logits(data, at, model.dense(), model.bias)


def test_held_out_accuracy():
    texts, toxic = made(1500, 1)
    model = toxicity.fit(features(texts[:1000]), toxic[:1000])
    right = (scores(model, texts[1000:]) >= model.limit) == toxic[1000:]
    assert right.mean() > 0.97


def test_pairing_keeps_identity_terms_neutral():
    texts, toxic = made(1500, 2, biased=0.1)
    neutral = [t + " muslim" for t, y in zip(*made(300, 3)) if not y]
    plain = toxicity.fit(features(texts), toxic, pairing=0.0)
    paired = toxicity.fit(features(texts), toxic, pairing=20.0)
    shift = [scores(m, ["muslim"])[0] - m.bias for m in (plain, paired)]
    wrong = [(scores(m, neutral) >= m.limit).mean() for m in (plain, paired)]
    assert shift[1] < shift[0] / 2
    assert wrong[1] <= wrong[0]


def test_operator_on_odd_rows(spark):
    texts, toxic = made(400, 4)
    rows = [(i, t, 9.0) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame([*rows, (None, "you idiotic scumbag", 1.0), (1000, None, 1.0), (1001, "", 1.0), (1002, "worthless " * 20_000, 1.0)], "doc_id long, text string, score double")
    found = {r["doc_id"] for r in toxicity.toxic(df, labels).collect()}
    assert None in found and 1002 in found and not found & {1000, 1001}
    kept = toxicity.clean(df, labels)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in df.collect()} - found
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.toxic(df, one).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxic(df, none).count() == 0 and toxicity.clean(df.limit(0), labels).count() == 0


def test_gradient_equals_finite_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [rng.choice(12, 5, replace=False) for _ in range(6)]
    twins = [(np.array([1, 2]), np.array([3])), (np.zeros(0, int), np.array([4, 5])), *[(np.zeros(0, int), np.zeros(0, int))] * 4]
    y, weight, w, bias = np.array([1, 0, 1, 0, 0, 1]), rng.uniform(1, 2, 6), rng.normal(size=12), 0.3

    def loss(w, bias):
        z = np.array([bias + w[r].sum() for r in rows])
        return (weight * (np.log1p(np.exp(z)) - y * z)).sum() + 2.5 * sum((w[c].sum() - w[g].sum()) ** 2 for g, c in twins)

    ids, g, of_bias = toxicity.gradient(w, bias, rows, y, weight, twins, 2.5)
    total = np.bincount(ids, weights=g, minlength=12)
    for k in range(12):
        e = np.eye(12)[k] * 1e-6
        assert abs((loss(w + e, bias) - loss(w - e, bias)) / 2e-6 - total[k]) < 1e-5
    assert abs((loss(w, bias + 1e-6) - loss(w, bias - 1e-6)) / 2e-6 - of_bias) < 1e-5


def test_twins_swap_every_term():
    import numpy as np

    def ids(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return np.unique(toxicity.features(raw, np.array([0, len(raw)]))[1])

    gone, come = toxicity._twins([ids("deaf muslim women sang")], 1)[0]
    for term in ("deaf", "muslim", "women"):
        assert int(ids(term)[0]) in gone.tolist() or not set(ids(term).tolist()).isdisjoint(gone.tolist())
    assert len(come) >= 3 and not set(gone.tolist()) & set(come.tolist())
    gone, come = toxicity._twins([ids("nobody here")], 1)[0]
    assert len(gone) == 0 and len(come) >= 1
