import hashlib
import random
from collections import Counter

import pytest
from fixtures import documents, plain, texts

from lakeloom.llm import repeats, suffixsort


def brute(rows, length=200):
    starts = Counter()
    for _, text, _ in rows:
        data = text.encode()
        for i in range(len(data) - length + 1):
            starts[data[i : i + length]] += 1
    out = Counter()
    for doc, text, _ in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if starts[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    fill = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    shared = word() * 2 + word() + word()
    rows = [fill(rng.randint(0, 300)) + shared[rng.randint(0, 20) : len(shared) - rng.randint(0, 40)] + fill(rng.randint(0, 300)) for _ in range(40)]
    line = word() + word() + word()  # 180 bytes: shared, but too short on its own
    rows += [fill(100) + line + fill(100) for _ in range(20)]
    rows += [fill(50) + "é" + line + rng.choice("xyz") * 25 + fill(40) for _ in range(20)]
    rows += ["ab" * 300, "z" * 199, "y" * 200, "y" * 201]
    return rows + texts()[:60]


@pytest.mark.parametrize("group", [repeats.GROUP, 5])
def test_brute_force(spark, group):
    docs = documents(spark, passages())
    assert Counter(map(tuple, repeats.digests(docs, group=group).collect())) == brute(plain(docs))


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUFFER", 1000)
    docs = documents(spark)
    assert Counter(map(tuple, repeats.digests(docs).collect())) == brute(plain(docs))
    assert repeats.digests(docs.limit(0)).count() == 0


def test_text_of_many_megabytes(spark):
    rng = random.Random(6)
    noise = rng.randbytes(6_000_000).hex()
    passage = noise[:5000]
    long = noise[5000:] + passage
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.digests(spark.createDataFrame([(1, long), (2, passage + "z" * 150), (3, long[:100])], "doc_id long, text string")).collect()}
    assert got == {1: (len(long), 5000, 1), 2: (5150, 5000, 1), 3: (100, 0, 0)}


def test_many_rows_of_one_document(spark):
    """They stand for their contexts once, and all lose what repeats."""
    docs = documents(spark, passages()[:30])
    rows = docs.unionByName(docs.filter("doc_id < 30")).unionByName(docs.filter("doc_id < 30"))
    for group in (repeats.GROUP, 5):
        assert Counter(map(tuple, repeats.digests(rows, group=group).collect())) == brute(plain(rows))


def test_anchors_do_not_depend_on_the_batch():
    rng = random.Random(7)
    text = "".join(rng.choice("ab") for _ in range(3000)).encode()  # hashes agree in their first bits now and then
    import numpy as np

    one = repeats._anchors(next(repeats._segments([text])), np.array([len(text)]))[1]
    many = [rng.randbytes(150_000).hex().encode() for _ in range(3)]
    both = repeats._anchors(next(repeats._segments([*many, text])), np.array([len(x) for x in [*many, text]]))
    assert both[1][both[0] == 3].tolist() == one.tolist()


def test_spans_and_bytes(spark):
    docs = documents(spark, ["q" + "0123456789" * 25 + "XY"[i] * 5 for i in range(2)])
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in repeats.deduplicated(docs).collect()}
    assert got == {0: (b"XXXXX", [(0, 251)]), 3: (b"YYYYY", [(0, 251)])}


def test_sorting():
    rng = random.Random(4)
    import numpy as np

    for _ in range(150):
        base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 70))) for _ in range(5)]
        strings = []
        for _ in range(rng.randint(0, 40)):
            b = rng.choice(base)
            k = rng.randint(0, len(b))
            strings.append(rng.choice([b, b[:k], b[:k] + b"a" * rng.randint(0, 60), b[k:] + b"\0" * rng.randint(0, 5)]))
        groups = np.array([rng.randint(0, 3) for _ in strings], np.int64)
        order, shared = suffixsort.sort(strings, groups, 16)
        key = lambda i: (groups[i], strings[i])  # noqa: B023, E731
        assert [key(i) for i in order] == sorted(map(key, range(len(strings))))
        for k in range(len(strings)):
            same = k and groups[order[k]] == groups[order[k - 1]]
            assert shared[k] == (suffixsort.common_prefix(strings[order[k - 1]], strings[order[k]]) if same else -1)
