"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the classes' log-count ratios, and a linear
hinge-loss model is fitted to them by dual coordinate descent; a logistic curve
through margins of rows left out of that fit turns margins into probabilities.

The n-grams: bytes (2 to 4), words, and one to three word shapes in a row, where a
shape tells case, digits, outer marks, and whether the word repeats the one before.
All are hashed to ``BUCKETS`` and counted once a document.

Cases: null and empty texts have no n-gram and score by the bias; without training
labels of both classes every score is the training labels' mean, or 0 without any;
repeated rows, and ties, score alike; a score at the cut counts as 1; a very long text is
worked through in parts of ``PART`` bytes; an empty table gives an empty table; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from . import classify, common

BUCKETS = 1 << 18
SMOOTH, COST, EPOCHS = 1.0, 1.0, 12
CUT = 0.7
#: Every so many rows of the sample calibrate instead of training.
CALIBRATE = 5
_SHIFT = np.uint64(46)
#: Bytes of a text whose n-grams are made at once.
PART = 1 << 20


def _shape(word: bytes) -> int:
    """Low byte: the word's shape; the rest: its hash."""
    first, last = word[0], word[-1]
    body = word.strip(b".,;:!?'\"()-")
    shape = 1 * (65 <= first <= 90) + 2 * (len(body) > 1 and body.isupper()) + 4 * any(48 <= c <= 57 for c in word)
    shape += 8 * (b".,;:!?'\"".find(last) + 1 > 0) + 16 * any(c in b"#*$%&|<>{}[]_=~^@\\" for c in word) + 32 * (len(word) - len(body) > 1) + 64 * (not body)
    return (xxhash.xxh64_intdigest(word, 9) & ~0xFF) | shape


_codes = classify.WordCodes(_shape)
common.remembers("classify", _codes.clear)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The buckets of a text, each once; ``seen`` is a scratch mask of ``BUCKETS`` that comes back clear."""
    for at in range(0, len(text), PART):
        data = np.frombuffer(text[at : at + PART + 3], np.uint8).astype(np.uint64)
        gram = data.copy()
        for order in (2, 3, 4):
            if len(data) < order:
                break
            gram = gram[:-1] << np.uint64(8) | data[order - 1 :]
            seen[(gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order << 48)) >> _SHIFT] = True
    before: list[bytes] = []  # the last words of the part before: shapes reach over parts
    for part in common.parts(text, PART):
        words = before + part.split()
        if not words:
            continue
        codes = _codes.of(words)
        seen[common.mix64(codes) >> _SHIFT] = True
        shapes = (codes & np.uint64(127)) + np.uint64(1)
        shapes[1:] += np.uint64(128) * (codes[1:] == codes[:-1])
        gram = shapes = shapes[1 if len(before) == 3 else 0 :]  # the first one's own predecessor is gone
        for order in (1, 2, 3):
            if order > 1:
                if len(shapes) < order:
                    break
                gram = gram[:-1] << np.uint64(9) | shapes[order - 1 :]
            seen[common.mix64(gram + np.uint64(order << 40)) >> _SHIFT] = True
        before = words[-3:]
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class Model:
    """``weights`` already carry the log-count ratios; a margin is their mean over the root of the features, plus a bias."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.ratio, self.weights, self.bias, self.slope, self.offset = ratio, weights, bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        r = self.ratio[found]
        return float(self.weights[found] @ r / max(np.sqrt(r @ r), 1e-9)) + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        seen = np.zeros(BUCKETS, bool)
        return classify.sigmoid(self.slope * np.array([self.margin(features(t, seen)) for t in texts]) + self.offset)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    seen = np.zeros(BUCKETS, bool)
    rows = [features(t, seen).astype(np.int32) for t in texts]
    y = np.where(labels == 1, 1.0, -1.0)
    training = [k for k in range(len(rows)) if k % CALIBRATE]
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for k in training:
        (p if y[k] > 0 else q)[rows[k]] += 1
    ratio = np.log(p / p.sum() / (q / q.sum())).astype(np.float32)
    scale = {k: 1 / max(np.sqrt(np.square(ratio[rows[k]], dtype=np.float64).sum()), 1e-9) for k in training}
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    positive = max(1, int((labels == 1).sum()))
    cost = {1.0: COST, -1.0: COST * max(1.0, positive / max(1, len(rows) - positive))}
    rng = np.random.default_rng(13)
    for _ in range(EPOCHS):
        moved = 0.0
        for k in rng.permutation(training):
            x = ratio[rows[k]] * scale[k]
            gradient = y[k] * (w[rows[k]] @ x + bias) - 1
            new = min(max(alpha[k] - gradient / 2.0, 0.0), cost[y[k]])  # each row and the bias have norm 1
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[rows[k]] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-3:
            break
    model = Model(ratio, w.astype(np.float32), bias, 1.0, 0.0)
    held = [k for k in range(0, len(rows), CALIBRATE)]
    m, t = np.array([model.margin(rows[k]) for k in held]), (labels[held] == 1).astype(float)
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's steps for the logistic curve
        s = classify.sigmoid(a * m + b)
        d, h = s - t, s * (1 - s) + 1e-9
        grad = np.array([d @ m + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[h @ (m * m) + 1e-3, h @ m], [h @ m, h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(a, 1e-3)), float(b)
    return model


class _Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = classify.TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = classify.fitted(classify.sample(docs, labels, label, limit, id_col, text_col), fit)
    return classify.scored(docs, (model or _Constant(classify.share(labels, label, id_col))).score, CUT, id_col, text_col)
