import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from fixtures import documents, plain

from lakeloom.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = WORD.findall(text.encode().lower())
    runs = words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]
    return len(words), [crc32(x) % 10000 for x in runs]


def brute(rows, targets):
    found = [brute_features(t) for _, t, _ in rows]
    s = Counter(b for _, fs in found for b in fs)
    t = Counter(b for x in targets for b in brute_features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for (i, _, _), (n, fs) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    order = {id(x): k + 1 for k, x in enumerate(able[: 25 * len(able) // 100])}
    return [(*x[:4], order.get(id(x))) for x in out]


@pytest.mark.parametrize("size", [resample.SLICE, 64])
def test_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(resample, "SLICE", size)  # 64: every text is hashed in many parts
    monkeypatch.setattr(resample, "SORTED", 1000)
    docs = documents(spark)
    target = spark.createDataFrame([("some words of a benchmark",), (None,), ("",), (plain(docs)[4][1],)], "text string")
    want = brute(plain(docs), [r.text or "" for r in target.collect()])
    got = list(map(tuple, resample.ranked(docs, target).collect()))
    assert Counter(got) == Counter(want) and sum(r[4] is not None for r in got) > 5


def test_no_rows_and_no_target(spark):
    docs = documents(spark)
    target = docs.select("text").limit(0)
    assert resample.ranked(docs.limit(0), docs).count() == 0
    got = list(map(tuple, resample.ranked(docs, target).collect()))
    assert Counter(got) == Counter(brute(plain(docs), []))


def test_drawn_rows_keep_all_columns(spark):
    docs = documents(spark)
    ids = {r.doc_id for r in resample.ranked(docs, docs.limit(3)).collect() if r.rank}
    out = resample.resampled(docs, docs.limit(3))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= ids | {None}


def test_runs_and_means():
    bucket, n = resample.runs(np.array([3, 1, 3, 3, 0], np.uint16))
    assert bucket.tolist() == [0, 1, 3] and n.tolist() == [1, 1, 3]
    gain = np.array([-3, 5, 0, 0])
    assert resample.weights(gain, np.array([0, 0, 1, 0], np.uint16), np.array([0, 2, 0, 2, 0])).tolist() == [0, -3, 0, 1, 0]
    assert resample.weights(gain, np.array([0, 2], np.uint16), np.array([2])).tolist() == [-2]  # floors go down


def test_text_of_many_megabytes(spark):
    text = "Some words that come again and again " * 330_000
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r.n_features for r in resample.ranked(docs, docs.filter("doc_id = 2")).collect()}
    assert got == {1: 2 * 7 * 330_000 - 1, 2: 1}
