"""Toxicity by a classifier with counterfactual regularisation.

A logistic model over hashed words and word beginnings is fitted to labelled documents. Each labelled text has
a counterfactual twin, in which every identity term is swapped for another one of its kind (or, where it has none, one is put in);
the squared change of the score between the two is penalised, so that a mere mention of a group moves no score.

The fit uses at most `SAMPLE` labelled rows, those of the smallest id hashes; every document is scored.

Defined cases: a null or empty text has no features and is never rejected. Labels without a document, null
labels and labels of either class alone leave a model that rejects nothing; of labels that repeat a doc_id the
greatest counts. Texts of any length are scored whole. Rows that repeat score alike, and a text at the limit itself
is rejected. Columns other than doc_id, text and toxic may have any names and stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import cut, slices, strings, thin
from grafwerk.llm.words import PLAIN, span_hash, split, sums

#: Labelled rows that the fit uses at most.
SAMPLE = 6_000
BITS = 20
BEGINNINGS = (4, 5, 6)
#: Weight of the squared score change between a text and its twin.
PAIRING = 5.0
#: Features in fewer sampled texts than this have no weight.
LEAST_DF = 4

#: Identity terms; a term is swapped for another of its row.
IDENTITIES = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "african", "european", "american", "latino", "arab", "indian", "chinese"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "native", "migrant"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("mexican", "german", "french", "spanish", "russian", "turkish", "polish", "nigerian"),
)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each word and each of its beginnings."""
    start, end, seen, words = split(data, at, PLAIN)
    prefix = sums(seen)
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(words))
    shift = np.uint64(64 - BITS)
    owners, ids = [text], [span_hash(prefix, start, end) >> shift]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        owners.append(text[long])
        ids.append((span_hash(prefix, start[long], start[long] + n) ^ np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> shift)
    return np.concatenate(owners), np.concatenate(ids).astype(np.int64)


def term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[1])


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        data, at = strings(part.column("text"))
        owner, ids = features(data, at)
        both = np.unique(owner << BITS | ids)
        owner, ids = both >> BITS, (both & ((1 << BITS) - 1)).astype(np.uint32)
        ends = np.searchsorted(owner, np.arange(len(at)))
        rows = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(rows, pa.binary())], ["toxic", "ids"])


@dataclass
class Model:
    """Weights by feature, the bias, and the logit from which a text is rejected."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    limit: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out


def _twins(rows: list[np.ndarray], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the features that its twin lacks and those that it has besides."""
    rng = np.random.default_rng(seed)
    families = [[term_features(t) for t in family] for family in IDENTITIES]
    out = []
    for ids in rows:
        have = set(ids.tolist())
        found = [(f, k) for f, family in enumerate(families) for k, t in enumerate(family) if int(t[0]) in have and have.issuperset(t.tolist())]
        gone, come = [], []
        for f, k in found or [(int(rng.integers(len(families))), -1)]:
            others = [t for i, t in enumerate(families[f]) if i != k]
            come.append(others[rng.integers(len(others))])
            if k >= 0:
                gone.append(families[f][k])
        lost, new = (set(np.concatenate(x).tolist()) if x else set() for x in (gone, come))
        out.append(tuple(np.array(sorted(x), np.int64) for x in (lost - new, new - lost - (have - lost))))
    return out


def gradient(w: np.ndarray, bias: float, rows: list, toxic: np.ndarray, weight: np.ndarray, twins: list, pairing: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, what each adds to the gradient, the bias's) of weighted log losses and squared changes between twins."""
    ids = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    logit = bias + np.bincount(owner, weights=w[ids], minlength=len(rows))
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic) * weight
    all_ids, all_g = [ids], [error[owner]]
    for gone, come in twins:
        change = w[come].sum() - w[gone].sum()
        if pairing and change:
            all_ids += [come, gone]
            all_g += [np.full(len(come), 2 * pairing * change), np.full(len(gone), -2 * pairing * change)]
    return np.concatenate(all_ids), np.concatenate(all_g), float(error.sum())


def fit(rows: list[np.ndarray], toxic: np.ndarray, pairing: float = PAIRING, epochs: int = 12, seed: int = 7) -> Model:
    """Fit by FTRL-proximal steps over mini-batches; L1 leaves most weights at zero, and none is negative.

    Only words speak for a rejection and none against it, so that no length of ordinary text hides an insult.

    A fifth of the rows is held out to place the limit where the F1 score is best.
    """
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, np.inf)
    if not len(rows) or toxic.min() == toxic.max():
        return none
    rng = np.random.default_rng(seed)
    df = np.bincount(np.concatenate(rows).astype(np.int64), minlength=1 << BITS)
    usual = (df >= LEAST_DF) & (df <= 0.7 * len(rows) + LEAST_DF)
    twins = _twins(rows, seed)
    for _, come in twins:
        usual[come] |= df[come] >= LEAST_DF
    x = [r[usual[r]].astype(np.int64) for r in rows]
    twins = [(gone[usual[gone]], come[usual[come]]) for gone, come in twins]
    held = rng.random(len(x)) < 0.2
    train = np.flatnonzero(~held)
    weight = np.where(toxic == 1, min(10.0, max(1.0, (toxic == 0).sum() / (toxic == 1).sum())) ** 0.5, 1.0)
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    bias, bias_n = 0.0, 1.0
    alpha, l1, l2 = 0.3, 4.0, 1.0

    def step(ids: np.ndarray, g: np.ndarray) -> None:
        u, inv = np.unique(ids, return_inverse=True)
        g = np.bincount(inv, weights=g)
        s = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / alpha
        z[u] += g - s * w[u]
        n[u] += g * g
        w[u] = np.where(z[u] >= -l1, 0.0, -(z[u] + l1) / ((1.0 + np.sqrt(n[u])) / alpha + l2))

    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 32):
            batch = train[k : k + 32]
            ids, g, of_bias = gradient(w, bias, [x[i] for i in batch], toxic[batch], weight[batch], [twins[i] for i in batch], pairing)
            bias_n += of_bias * of_bias
            bias -= 0.3 / np.sqrt(bias_n) * of_bias
            step(ids, g)
    logits = np.array([bias + w[r].sum() for r in x])
    at = held if 0 < toxic[held].sum() < held.sum() else np.ones(len(x), bool)
    order = np.argsort(-logits[at], kind="stable")
    hits = np.cumsum(toxic[at][order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + hits[-1])
    best = int(np.argmax(f1))
    ranked = logits[at][order]
    limit = (ranked[best] + (ranked[best + 1] if best + 1 < len(ranked) else ranked[best] - 1)) / 2
    used = np.flatnonzero(w)
    return Model(used, w[used].astype(np.float32), float(bias), float(max(limit, bias + 1e-6)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairing: float = PAIRING) -> Model:
    """Fit a model to `labels` (doc_id, toxic) of `docs`."""
    some = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = cut(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most `sample` rows of two numbers: the bound is the parameter's, not the table's.
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
    got = rows.mapInArrow(_distinct, "toxic int, ids binary").toArrow()
    ids = [np.frombuffer(x, np.uint32).astype(np.int64) for x in got.column("ids").to_pylist()]
    toxic = np.array(got.column("toxic").to_pylist(), np.int64)
    order = sorted(range(len(ids)), key=lambda i: (len(ids[i]), ids[i][:8].tolist(), int(toxic[i])))
    return fit([ids[i] for i in order], toxic[order] if len(order) else toxic, pairing)


_loaded: dict[int, np.ndarray] = {}


def logits(data: np.ndarray, at: np.ndarray, dense: np.ndarray, bias: float) -> np.ndarray:
    owner, ids = features(data, at)
    used = np.flatnonzero(dense[ids])
    both = np.unique(owner[used] << BITS | ids[used])
    return bias + np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=len(at) - 1)


def _scored(model: Model, names: list[str], reject: bool):
    """Rows that are rejected, with the score, or the rows that stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for part in slices(batches, "text"):
            data, at = strings(part.column("text"))
            logit = logits(data, at, dense, model.bias)
            toxic = logit >= model.limit
            if reject:
                score = 1 / (1 + np.exp(-np.clip(logit[toxic], -60, 60)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).filter(pa.array(toxic)), pa.array(score)], ["doc_id", "score"])
            else:
                yield part.filter(pa.array(~toxic))

    return run


def toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for each row that is rejected."""
    model = train(docs, labels, sample)
    return thin(docs).select("doc_id", "text").mapInArrow(_scored(model, [], True), "doc_id long, score double")


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that aren't rejected, with all their columns."""
    model = train(docs, labels, sample)
    return thin(docs).mapInArrow(_scored(model, docs.columns, False), docs.schema)
