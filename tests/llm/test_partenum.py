from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, plain

from lakeloom.llm import partenum


def brute_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows, least=85):
    """Components, all pairs compared."""
    found = [brute_set(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(found[a] & found[b])
            if found[a] and found[b] and 100 * both >= least * len(found[a] | found[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    low = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        low[g] = min(low.get(g, 2**70), 2**63 if i is None else i)
    return Counter((i, len(f), None if low[g] == 2**63 else low[g]) for (i, _, _), f, g in zip(rows, found, group, strict=True))


def edited(rng, base, n):
    words = list(base)
    for at in rng.integers(0, len(words), n):
        words[at] = f"z{rng.integers(10**6)}"
    return words


def families(seed):
    """Texts with copies at similarities around the limit, and texts that share a long passage."""
    rng = np.random.default_rng(seed)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    rows = []
    for size in (4, 5, 7, 9, 10, 12, 20, 33, 60, 110, 250, 700):
        base = draw(size)
        rows += [" ".join(base), " ".join(base).upper(), " ".join(base[1:]), " ".join(base[:-1]), " ".join(base + draw(max(1, size // 8)))]
        rows += [" ".join(edited(rng, base, max(1, size * k // 200))) for k in range(1, 8)]
    passage = draw(100)
    rows += [" ".join(passage + draw(int(n))) for n in rng.integers(5, 60, 40)]
    return [rows[i] for i in rng.permutation(len(rows))]


def got(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("pivots", [partenum.PIVOTS, 2])
def test_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(partenum, "PIVOTS", pivots)
    monkeypatch.setattr(partenum, "PAIRS", 1 << 23 if pivots > 2 else 0)
    monkeypatch.setattr(partenum, "PART", 100)
    monkeypatch.setattr(partenum, "MEMBERS", partenum.MEMBERS if pivots > 2 else 5)  # groups of several parts
    docs = documents(spark)
    if pivots > 2:
        assert got(partenum.joined(docs)) == brute(plain(docs))
    docs = documents(spark, families(3))
    want, found = brute(plain(docs)), partenum.joined(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and got(found) == want
    sizes = Counter(c for _, _, c in want.elements())
    assert max(sizes.values()) > 5 and sum(n == 1 for n in sizes.values()) > 20


def test_frequent_signatures_are_dealt_out_by_class(spark, monkeypatch):
    monkeypatch.setattr(partenum, "FREQUENT", 2)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(80)]
    rows = [" ".join(edited(rng, base, 1)) for _ in range(150)] + [" ".join(edited(rng, base, 12)) for _ in range(50)]
    docs = documents(spark, rows)
    assert got(partenum.joined(docs)) == brute(plain(docs))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for n in [*range(1, 40), 77, 150, 400, 1501]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            # the most elements that may differ, split at random into taken out and put in
            out = int(rng.integers(0, len(a)))
            while out and 100 * (len(a) - out) < 85 * len(a):
                out -= 1
            put = int(100 * (len(a) - out) / 85 - len(a))
            b = np.unique(np.concatenate((rng.permutation(a)[: len(a) - out], rng.integers(0, 2**64, max(0, put), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(partenum.signatures(a), partenum.signatures(b)))


def test_a_sketch_never_rules_out_similar_sets():
    rng = np.random.default_rng(9)
    for n in [1, 3, 7, 16, 31, 64, 200, 3000]:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n * 7 // 100 :], rng.integers(0, 2**64, n * 7 // 100, dtype=np.uint64))))
        c = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert partenum.within(partenum.sketch(a), partenum.sketch(b)) and (n < 16 or not partenum.within(partenum.sketch(a), partenum.sketch(c)))
    many = np.zeros(400, np.uint64)
    assert partenum.within(partenum.sketch(many), partenum.sketch(c))


@pytest.mark.parametrize("members", [1, 40, 10**6])
def test_groups_are_compared_in_blocks(monkeypatch, members):
    monkeypatch.setattr(partenum, "MEMBERS", members)
    rng = np.random.default_rng(11)
    rows = []
    for sig in range(12):
        base = np.unique(rng.integers(0, 2**64, int(rng.choice([1, 6, 15, 17, 120, 2500])), dtype=np.uint64))
        for part in range(2):
            for k in range(int(rng.integers(1, 30))):
                other = np.unique(np.concatenate((base[len(base) * k // 60 :], rng.integers(0, 2**64, len(base) * k // 60, dtype=np.uint64))))
                sketch = [b"", b"\xff" * 4, partenum.sketch(other)][min(2, int(rng.integers(0, 20)))]
                rows.append({"sig": sig, "part": part, "cls": len(rows), "label": int(rng.integers(0, 5)), "pivot": bool(rng.integers(0, 3) == 0), "sketch": sketch})
    want = set()
    for x in rows:
        for y in rows:
            if (x["sig"], x["part"]) == (y["sig"], y["part"]) and x["cls"] < y["cls"] and x["label"] != y["label"] and x["pivot"] + y["pivot"] > (x["part"] > 0 and x["pivot"] and y["pivot"]) * 2:
                if not x["sketch"] or not y["sketch"] or partenum.within(x["sketch"], y["sketch"]):
                    want.add((x["cls"], y["cls"]))
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    found = [p for b in partenum._near(85)(iter(batches)) for p in zip(*b.to_pydict().values(), strict=True)]
    assert len(found) == len(set(found)) and want <= set(found) and len(want) > 100
    # longer sketches are compared by fewer counts here, which allow more; the rest exactly
    assert {p for p in found if max(len(rows[c]["sketch"]) for c in p) <= partenum.COUNTS} <= want


def test_a_large_group_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(17)
    base = [f"w{x}" for x in rng.integers(0, 4000, 300)]
    docs = documents(spark, [" ".join(edited(rng, base, int(n))) for n in rng.integers(1, 8, 400)])
    compared, written = [], partenum.common.written

    def counted(df, name, *deal):
        out = written(df, name, *deal)
        if name == "bounded":
            compared.append(out.count())
        return out

    monkeypatch.setattr(partenum.common, "written", counted)
    assert got(partenum.joined(docs)) == brute(plain(docs))
    assert sum(compared) <= 20 * 400


def test_of_each_class_the_pair_most_alike_is_tried():
    base = np.unique(np.random.default_rng(19).integers(0, 2**64, 200, dtype=np.uint64))
    sets = [base, base[:-9], base[:-3], base[:-12]]  # two pivots, and two others that the second and the first are nearest to
    pivot = [True, True, False, False]
    rows = [{"sig": 1, "part": 0, "cls": k, "label": k, "pivot": p, "sketch": partenum.sketch(s)} for k, (s, p) in enumerate(zip(sets, pivot, strict=True))]
    batches = pa.Table.from_pylist(rows).to_batches()
    found = {(x["u"], x["v"]) for b in partenum._near(85, best=True)(iter(batches)) for x in b.to_pylist()}
    assert found == {(0, 1), (0, 2), (1, 3)}


def test_no_rows(spark):
    assert partenum.joined(documents(spark).limit(0)).count() == 0
    assert got(partenum.joined(documents(spark, [None, "", " \n"]))) == Counter({(0, 0, 0): 1, (3, 0, 3): 1, (6, 0, 6): 1})


def test_text_of_many_megabytes(spark):
    text = " ".join(map(str, range(1_500_000)))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text[: len(text) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in partenum.joined(docs).collect()} == {1: 1, 2: 1, 3: 3}
