from collections import Counter, defaultdict

import numpy as np
from fixtures import documents, plain

from lakeloom.llm import mixing


def brute_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], 1.5 * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        parts = {i: left * weights[i] / total for i in free}
        over = [i for i in free if parts[i] > 2 * sizes[i]]
        if not over:
            for i in free:
                out[i] = parts[i]
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
            left -= out[i]
            free.remove(i)
    return out


def words(text):
    return len(text.encode().split())


def check(rows, docs):
    own = plain(docs)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, words(t)) for i, t, _ in own)
    size = defaultdict(int)
    for _, t, s in own:
        size[s] += words(t)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute_targets([size[s] for s in names]), strict=True))
    taken = defaultdict(int)
    source = {i: s for i, _, s in own}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == size[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_targets_and_takes(spark):
    docs = documents(spark)
    rows = mixing.report(docs).collect()
    check(rows, docs)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.report(docs.repartition(3)).collect()))
    check(mixing.report(docs, block=7).collect(), docs)


def test_every_slot_once(spark):
    docs = documents(spark)
    p = mixing.plan(mixing.placed(docs), block=16)
    got = mixing.slot_table(spark, p, slots=50).collect()
    slots = Counter((r.s, r.slot) for r in got)
    assert slots == Counter((s, j) for s in range(len(p.names)) for j in range(p.slots[s]))
    assert Counter(r.shard for r in got).most_common()[0][1] <= 50
    blocks = Counter((r.s, r["pass"], r.block) for r in got)
    assert max(blocks.values()) == 1


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 7).tolist()) == list(range(n))


def test_texts_of_the_mix(spark):
    docs = documents(spark)
    report = Counter()
    for r in mixing.report(docs, block=8).collect():
        report[r.doc_id] += r.taken
    out = mixing.resampled(docs, block=8)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text)
    assert got == +report
    empty = docs.limit(0)
    assert mixing.report(empty).count() == 0 and mixing.resampled(empty).count() == 0


def test_words_taken_against_plain_python(spark):
    """Every slot's block laid out word by word over its source's run of documents."""
    docs = documents(spark)
    for block in (8, 128):
        sizes = mixing.placed(docs)
        p = mixing.plan(sizes, block=block)
        rows = [r for r in mixing.offsets(sizes, p).collect()]
        run = defaultdict(dict)  # source: word of the run -> (document, word of the document)
        for r in rows:
            for k in range(r["size"]):
                assert r.off + k not in run[r.s]
                run[r.s][r.off + k] = (r["_id"], r["_tid"], r.off, k)
        assert all(sorted(x) == list(range(p.sizes[s])) for s, x in run.items())
        want, words_of = Counter(), defaultdict(Counter)
        for r in mixing.slot_table(spark, p).collect():
            for k in range(r.words):
                doc = run[r.s][r.block * block + k]
                want[r.s, doc[2], doc[0]] += 1
                words_of[doc[0], doc[1]][doc[3]] += 1
        taken = mixing.mixed(docs, block=block)[1].groupBy("s", "off", "_id").sum("taken").collect()
        assert Counter({(r.s, r.off, r["_id"]): r["sum(taken)"] for r in taken}) == want
        got = Counter()
        for r in mixing.resampled(docs, block=block).collect():
            got.update((r.doc_id, w) for w in r.text.encode().split())
        text = {(r["_id"], r["_tid"]): r["_text"].encode().split() for r in docs.selectExpr("doc_id as _id", "xxhash64(coalesce(text, '')) as _tid", "coalesce(text, '') as _text").collect()}
        plainly = Counter()
        for key, places in words_of.items():
            for k, n in places.items():
                plainly[key[0], text[key][k]] += n
        assert got == plainly


def test_prefix_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 3)
    rows = [(s, k, (7 * k + s) % 5) for s in (0, 4) for k in range(0, 40, s // 4 + 1)]
    got = {(r.s, r.k): r.base for r in mixing.before(spark.createDataFrame(rows, "s int, k long, n long"), "k", "n").collect()}
    assert got == {(s, k): sum(n for s2, k2, n in rows if s2 == s and k2 < k) for s, k, _ in rows}


def test_text_of_many_megabytes(spark):
    docs = spark.createDataFrame([(1, "a few words " * 1_000_000, "x"), (2, "others " * 50, "y")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.report(docs).collect()}
    assert got[1]["size"] == 3_000_000 and abs(got[1].taken - got[1].target) <= 1
    assert sum(len(r.text.split()) for r in mixing.resampled(docs).collect()) == sum(r.taken for r in got.values())
