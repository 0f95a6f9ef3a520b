import math
import zlib

import numpy as np
import pytest
import xxhash
from fixtures import documents

from lakeloom.llm import classify, common, quality, toxicity
from lakeloom.llm.queries import op4_toxicity, op9_quality


def corpus(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in "lmnst"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = rng.choice(words, rng.integers(20, 80)).tolist()
        if bad:
            text[3] = ["Nastyword,", "VILETERM!!", "#### $$$$"][i % 3]
            text[9] = "%%%% ||"
        rows.append((3 * i, " ".join(text)))
        labels.append((3 * i, int(not bad), int(bad)))
    base = documents(spark, [t for _, t in rows])
    return base, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("module", "label"), [(toxicity, 2), (quality, 1)])
def test_held_out_accuracy(spark, module, label):
    docs, labels, rows = corpus(spark)
    truth = {r[0]: r[label] for r in rows}
    got = module.judged(docs, labels).collect()
    assert len(got) == len(rows)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert sum(right) / len(right) > 0.97 and len(right) > 100
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= module.CUT)
    again = {r.doc_id: r.score for r in module.judged(docs.repartition(7), labels).collect()}
    assert again == {r.doc_id: r.score for r in got}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_inputs(spark, module):
    docs, labels, _ = corpus(spark, n=80)
    odd = documents(spark)
    assert module.judged(odd, labels).count() == odd.count()
    assert module.judged(odd.limit(0), labels).count() == 0
    assert module.judged(docs, labels.limit(0)).count() == 80
    one_class = labels.selectExpr("doc_id", "1 as quality", "1 as toxic")
    assert {r.predicted for r in module.judged(docs, one_class).collect()} == {1}
    gaps = labels.selectExpr("nullif(doc_id, 3) as doc_id", "nullif(quality, 9) as quality", "if(doc_id = 6, null, toxic) as toxic").union(labels.limit(5))
    assert module.judged(docs, gaps).count() == 80


@pytest.mark.parametrize("query", [op4_toxicity, op9_quality])
def test_queries(spark, sf_dir, query):
    assert query(spark, sf_dir).count() == 200


def test_constant_scores_come_from_training_labels_only(spark):
    """One class among the rows to learn from, the other among those held out: the latter are never looked at."""
    ids = range(0, 400)
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in held), int(i in held)) for i in ids], "doc_id long, quality int, toxic int")
    assert len(held) > 50
    for module in (toxicity, quality):
        assert {round(r.score, 9) for r in module.judged(docs, labels).collect()} == {0.0}


def test_sample_is_bounded_before_it_is_gathered(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "two"), (3, "three")] + [(5, "again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 3, 5, 7)], "doc_id long, toxic int")
    want = {(i, t) for i, t in [(1, "one"), (1, "two"), (3, "three"), (5, "again")] if zlib.crc32(str(i).encode()) % 4 != 2}
    got = classify.sample(docs, labels, "toxic").collect()
    assert {(r._id, r._text) for r in got} == want and len(got) == len(want)
    assert classify.sample(docs, labels, "toxic", limit=2).count() == 2


def mix(x):
    return int(common.mix64(np.array([x % 2**64], np.uint64))[0])


def plain_toxic_features(text):
    """Words, pairs of neighbours, pairs with one word between, each hashed to a bucket."""
    codes = [xxhash.xxh64_intdigest(w.strip(toxicity._EDGE), 7) for w in text.lower().split()]
    out = {c >> 44 for c in codes}
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        out |= {mix(a * salt + b) >> 44 for a, b in zip(codes, codes[gap:], strict=False)}
    return out


def texts_and_labels(n=150):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    labels = (rng.random(n) < 0.3).astype(np.int64)
    texts = [" ".join([*rng.choice(words, int(rng.integers(3, 25))), *(["Vile,"] if y and rng.random() < 0.9 else []), *(["x1 Y2"] if rng.random() < 0.2 else [])]).encode() for y in labels]
    return texts, labels


def test_ftrl_against_a_plain_loop():
    """Every coordinate's z and n in dictionaries, one at a time."""
    texts, labels = texts_and_labels()
    z, n = {}, {}

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == "bias" else toxicity.L1
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    rng = np.random.default_rng(11)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(texts)):
            used = [*plain_toxic_features(texts[k]), "bias"]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i in used:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    model = toxicity.fit(texts, labels)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert want and model.buckets.tolist() == sorted(want) and np.allclose(model.weights, [want[i] for i in sorted(want)], atol=1e-5)
    assert abs(model.bias - weight("bias")) < 1e-9
    plain = [1 / (1 + math.exp(-weight("bias") - sum(want.get(i, 0.0) for i in plain_toxic_features(t)))) for t in texts]
    assert np.allclose(model.score(texts), plain, atol=1e-6)


def plain_quality_features(text):
    out = set()
    for order in (2, 3, 4):
        for i in range(len(text) - order + 1):
            gram = int.from_bytes(text[i : i + order], "big")
            out.add((gram * 0x9E3779B97F4A7C15 + (order << 48)) % 2**64 >> 46)
    words = text.split()
    codes = [quality._shape(w) for w in words]
    out |= {mix(c) >> 46 for c in codes}
    shapes = [(c & 127) + 1 + 128 * (k > 0 and c == codes[k - 1]) for k, c in enumerate(codes)]
    for order in (1, 2, 3):
        for i in range(len(shapes) - order + 1):
            gram = 0
            for s in shapes[i : i + order]:
                gram = gram << 9 | s
            out.add(mix(gram + (order << 40)) >> 46)
    return sorted(out)


@pytest.mark.parametrize("part", [7, 50, 1 << 20])
def test_quality_features_in_parts(monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)
    for text in [*texts_and_labels(20)[0], b"", b" ", b"one", b"a a a b b!! 12 #$% (x) " * 3]:
        assert quality.features(text, np.zeros(quality.BUCKETS, bool)).tolist() == plain_quality_features(text)


def test_dual_coordinate_descent_against_a_plain_loop():
    """Weights of a plain loop over dictionaries, and a small duality gap."""
    texts, labels = texts_and_labels()
    rows, y = [plain_quality_features(t) for t in texts], [1.0 if c == 1 else -1.0 for c in labels]
    training = [k for k in range(len(rows)) if k % quality.CALIBRATE]
    counts = {1.0: {}, -1.0: {}}
    for k in training:
        for i in rows[k]:
            counts[y[k]][i] = counts[y[k]].get(i, 0) + 1
    total = {s: sum(c.values()) + quality.SMOOTH * quality.BUCKETS for s, c in counts.items()}
    ratio = {i: math.log((counts[1.0].get(i, 0) + quality.SMOOTH) / total[1.0] / ((counts[-1.0].get(i, 0) + quality.SMOOTH) / total[-1.0])) for r in rows for i in r}
    x = {}
    for k in training:
        norm = math.sqrt(sum(ratio[i] ** 2 for i in rows[k]))
        x[k] = {i: ratio[i] / norm for i in rows[k]}
    positive = sum(c == 1 for c in labels)
    cost = {1.0: quality.COST, -1.0: quality.COST * max(1.0, positive / (len(rows) - positive))}
    w, bias, alpha = {}, 0.0, dict.fromkeys(training, 0.0)
    rng = np.random.default_rng(13)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for k in rng.permutation(training):
            slope = y[k] * (sum(w.get(i, 0.0) * v for i, v in x[k].items()) + bias) - 1
            new = min(max(alpha[k] - slope / 2, 0.0), cost[y[k]])
            for i, v in x[k].items():
                w[i] = w.get(i, 0.0) + (new - alpha[k]) * y[k] * v
            bias += (new - alpha[k]) * y[k]
            moved, alpha[k] = max(moved, abs(new - alpha[k])), new
        if moved < 1e-3:
            break
    model = quality.fit(texts, labels)
    assert np.allclose([model.weights[i] for i in w], list(w.values()), atol=1e-4) and abs(model.bias - bias) < 1e-4
    norm = sum(v * v for v in w.values()) + bias * bias
    primal = norm / 2 + sum(cost[y[k]] * max(0.0, 1 - y[k] * (sum(w[i] * v for i, v in x[k].items()) + bias)) for k in training)
    dual = sum(alpha.values()) - norm / 2
    assert 0 <= primal - dual + 1e-9 and (primal - dual) / primal < 0.05


@pytest.mark.parametrize("module", [toxicity, quality])
def test_text_of_many_megabytes(spark, module):
    docs, labels, _ = corpus(spark, n=60)
    long = spark.createDataFrame([(-1, "Some words, and more of them! " * 400_000)], "doc_id long, text string")
    got = module.judged(docs.select("doc_id", "text").union(long), labels).filter("doc_id = -1").first()
    assert 0 <= got.score <= 1
