"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words (lower-cased, outer ASCII punctuation taken off), pairs of
neighbours, and pairs with one word between, each hashed to one of ``BUCKETS`` and
counted once a document.  Rates are per coordinate, L1 leaves most weights at zero,
so the model is a short list of buckets and weights.

Cases: null and empty texts score the model's bias alone; without training labels of
both classes every score is the training labels' mean, or 0 without any; repeated rows,
and ties, score alike; a score at the cut counts as 1; a very long text is one row of
features, some 100 bytes a word; an empty table gives an empty table; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from . import classify, common

BUCKETS = 1 << 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.1, 8
CUT = 0.3
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_codes = classify.WordCodes(lambda w: xxhash.xxh64_intdigest(w.strip(_EDGE), 7))
common.remembers("classify", _codes.clear)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each feature of some texts, repeats included."""
    words = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), n)
    codes = _codes.of([w for ws in words for w in ws])
    buckets, owners = [codes >> np.uint64(44)], [owner]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        inside = owner[gap:] == owner[:-gap]
        pair = common.mix64(codes[:-gap] * np.uint64(salt) + codes[gap:])[inside]
        buckets.append(pair >> np.uint64(44))
        owners.append(owner[gap:][inside])
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


class Model:
    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray):
        self.bias, self.buckets, self.weights = bias, buckets, weights
        self._dense = None

    def __getstate__(self):
        return {"bias": self.bias, "buckets": self.buckets, "weights": self.weights, "_dense": None}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(BUCKETS, np.float32)
            self._dense[self.buckets] = self.weights
        owner, bucket = features(texts)
        heavy = self._dense[bucket] != 0
        once = np.unique(owner[heavy] * BUCKETS + bucket[heavy])
        margin = np.bincount(once // BUCKETS, self._dense[once % BUCKETS], minlength=len(texts))
        return classify.sigmoid(self.bias + margin)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """FTRL-proximal over the texts, ``EPOCHS`` times, in a fixed shuffled order; the last bucket is the bias, free of L1."""
    rows = []
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        owner, bucket = features(part)
        once = np.unique(owner * BUCKETS + bucket)
        cuts = np.searchsorted(once, np.arange(1, len(part)) * BUCKETS)
        rows += [np.append(x % BUCKETS, BUCKETS).astype(np.int32) for x in np.split(once, cuts)]
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    l1 = np.full(BUCKETS + 1, L1)
    l1[-1] = 0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - labels[k]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    w = weights(np.arange(BUCKETS + 1))
    used = np.flatnonzero(w[:-1])
    return Model(float(w[-1]), used.astype(np.int32), w[used].astype(np.float32))


def judged(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limit: int = classify.TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    sample = classify.sample(docs, labels, label, limit, id_col, text_col)
    model = classify.fitted(sample, fit) or _constant(classify.share(labels, label, id_col))
    return classify.scored(docs, model.score, CUT, id_col, text_col)


def _constant(share: float) -> Model:
    return Model(float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))), np.zeros(0, np.int32), np.zeros(0, np.float32))
