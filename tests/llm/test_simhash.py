from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import documents, plain

from lakeloom.llm import simhash
from lakeloom.llm.components import components


def brute_fp(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(fps):
    """Component label (least index) of each fingerprint, all pairs compared."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("homes", [simhash.HOMES, 2])
def test_brute_force(spark, monkeypatch, homes):
    monkeypatch.setattr(simhash, "HOMES", homes)  # 2: nearly all anchors with neighbours are split
    docs = documents(spark)
    rows = sorted(plain(docs), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute_fp(t) for _, t, _ in rows]
    want = Counter((r[0], f"{f:016x}", rows[k][0]) for r, f, k in zip(rows, fps, reach(fps), strict=True))
    assert Counter(map(tuple, simhash.digests(docs).collect())) == want
    assert simhash.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("large", [simhash.LARGE, 200])
def test_links_span_what_all_pairs_span(large):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fps = [base]
    for flips in (1, 2, 3):
        x = base[:150].copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)
        fps.append(x)
    fps.append(np.array([int(base[0]) ^ 1 << i ^ 1 << j for i in range(0, 64, 2) for j in range(i)], np.uint64))
    fps = np.unique(np.concatenate(fps))
    rows, anchor, home = simhash.anchors(fps)
    order = np.argsort(anchor, kind="stable")
    edges = simhash.links(anchor[order], fps[rows][order], home[order], 2, large)
    assert len(edges) and (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 2).all()
    at = {int(f): i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        new = list(label)
        for u, v in edges.tolist():
            new[at[u]] = new[at[v]] = min(new[at[u]], new[at[v]])
        if new == label:
            break
        label = new
    assert label == reach([int(f) for f in fps])


def test_split_anchors_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(19)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base} | {base ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for i, j, k in rng.integers(0, 64, (400, 3))})
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    for homes in (simhash.HOMES, 20):
        monkeypatch.setattr(simhash, "HOMES", homes)
        label = {r.node % 2**64: r.label for r in components(simhash.linked(frame)).collect()}
        got = [label.get(f, f) for f in fps]
        want = reach(fps)
        assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_text_of_many_megabytes(spark):
    text = "some words that come again and again " * 330_000
    docs = spark.createDataFrame([(1, text), (2, text + "end")], "doc_id long, text string")
    assert len({r.component_id for r in simhash.digests(docs).collect()}) == 1


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    base = [rng.choice(words, 150).tolist() for _ in range(6)]
    rows = [" ".join(b) for b in base]
    rows += [" ".join(base[0][:-1] + ["other"]), rows[1], rows[1].upper(), " ".join(base[2][:70] + rng.choice(words, 80).tolist()), None, "", "a b", "a b c"]
    docs = documents(spark, rows)
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    # 6 is near 0 and 7, 8 equal 1; 9 shares under half with 2; 11 is as empty as 10
    assert sorted(r.doc_id // 3 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 9, 10, 12, 13]
    assert simhash.deduplicated(docs.limit(0)).count() == 0
    repeated = docs.filter("doc_id < 6").union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 3"))
    assert sorted(r.doc_id for r in simhash.deduplicated(repeated).collect()) == [0, 3]


def test_similarity():
    assert simhash.similarity(b"", b" ") == 1.0 and simhash.similarity(b"a b", b"A b") == 1.0 and simhash.similarity(b"a", b"b") == 0.0
    assert simhash.similarity(b"a b c d e f", b"a b c d e g") == 1 / 3


def near_by_all_pairs(texts):
    """Indices of the texts that stay, all pairs compared; the first of each group."""
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if simhash.similarity(texts[a].encode(), texts[b].encode()) >= 0.8:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return sorted(set(group))


def test_a_failed_pair_hides_no_other(spark):
    """Texts of one set of words: two are near copies, and those before them in other orders are like neither."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    one = [words[i] for i in rng.permutation(60)] * 2
    rows = [" ".join(words[i] for i in rng.permutation(60)) for _ in range(8)]
    rows += [" ".join(one), " ".join(one[:-4] + one[-2:] + one[-4:-2])]
    # of a common start, and so of some shared shingles, each pair of neighbours alone is near
    base = rng.integers(0, 10**6, 120).astype(str).tolist()
    rows += [" ".join(base[:60] + rng.integers(0, 10**6, 60).astype(str).tolist()) for _ in range(6)]
    rows += [r.rsplit(" ", 3)[0] for r in rows[-6:]]
    kept = sorted(r.doc_id // 3 for r in simhash.deduplicated(documents(spark, rows)).collect())
    assert kept == near_by_all_pairs(rows) and len(kept) == 15


def test_block_edits_and_appended_text_are_found(spark):
    rng = np.random.default_rng(13)
    vocabulary = np.array([f"v{i}" for i in range(3000)])
    draw = lambda n: vocabulary[np.minimum(rng.zipf(1.3, n), 3000) - 1].tolist()
    rows = []
    for _ in range(25):
        a = draw(300)
        at = int(rng.integers(0, 260))
        rows += [a, a[:at] + draw(25) + a[at + 25 :]]
        b = draw(300)
        rows += [b, b + draw(int(rng.integers(30, 70)))]
    rows = [" ".join(r) for r in rows]
    want = near_by_all_pairs(rows)
    assert len(want) <= 55  # nearly all are near copies
    assert sorted(r.doc_id // 3 for r in simhash.deduplicated(documents(spark, rows)).collect()) == want


def test_a_text_left_out_has_no_near_duplicate():
    """The claim of ``reach``, in any order of the shingles."""
    rng, near = np.random.default_rng(17), 0
    for _ in range(3000):
        both = int(rng.integers(1, 80))
        pool = np.unique(rng.integers(0, 2**62, both + 30).astype(np.uint64))
        rng.shuffle(pool)
        i, j = (int(x) for x in rng.integers(0, 16, 2))
        a, b = np.sort(pool[: both + i]), np.sort(np.concatenate((pool[:both], pool[both + i : both + i + j])))
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        near += 1
        (own, looked), (_, other) = simhash.reach(len(a), 0.8), simhash.reach(len(b), 0.8)
        alone = ~np.isin(a[:looked], b[:other])
        assert alone[:own].sum() < simhash.prefix_size(len(a), 0.8)
    assert near > 300


def test_permutations_hide_no_pair(spark):
    """Twenty orders of one set of words, and five pairs at 0.966: one of each pair stays, and all others."""
    rng = np.random.default_rng(23)
    words = [f"w{i}" for i in range(300)]
    rows = [" ".join(words[i] for i in rng.permutation(300)) for _ in range(20)]
    for _ in range(5):
        one = [words[i] for i in rng.permutation(300)]
        rows += [" ".join(one), " ".join([*one[:-1], one[0]])]
    kept = sorted(r.doc_id // 3 for r in simhash.deduplicated(documents(spark, rows)).collect())
    assert len(kept) == 25 and kept == near_by_all_pairs(rows)


def test_recall_in_each_band(spark):
    """Of pairs by similarity, from 0.8 on, none is missed, whatever was changed."""
    rng = np.random.default_rng(29)
    rows, bands = [], [0, 0, 0, 0]
    for k in range(120):
        a = [f"x{rng.integers(0, 5000)}" for _ in range(int(rng.integers(60, 400)))]
        b, n = list(a), int(rng.integers(1, len(a) // 5 + 2))
        at = int(rng.integers(0, len(a) - n))
        if k % 3 == 0:
            b[at : at + n] = [f"y{rng.integers(0, 5000)}" for _ in range(n)]  # a block
        elif k % 3 == 1:
            b += [f"z{rng.integers(0, 5000)}" for _ in range(n)]  # appended
        else:
            for i in rng.choice(len(a), max(1, n // 5), replace=False):
                b[i] = "other"  # scattered
        rows += [" ".join(a), " ".join(b)]
        j = simhash.similarity(rows[-2].encode(), rows[-1].encode())
        bands[0 if j < 0.8 else 1 if j < 0.85 else 2 if j < 0.9 else 3] += 1
    assert min(bands) >= 5
    kept = {r.doc_id // 3 for r in simhash.deduplicated(documents(spark, rows)).collect()}
    for k in range(120):
        near = simhash.similarity(rows[2 * k].encode(), rows[2 * k + 1].encode()) >= 0.8
        assert ((2 * k + 1) in kept) != near and 2 * k in kept


def test_texts_of_nothing_but_common_passages(spark, monkeypatch):
    """Where all shingles are listed as frequent, the order is theirs, and still no pair is missed."""
    rng = np.random.default_rng(31)
    passages = [" ".join(f"p{k}_{i}" for i in range(14)) for k in range(24)]
    rows = []
    for _ in range(40):
        a = [passages[i] for i in rng.permutation(24)[: int(rng.integers(8, 20))]]
        b = list(a)
        if rng.random() < 0.7:
            b.insert(int(rng.integers(0, len(b))), "x y z")
        else:
            b.pop()
        rows += [" ".join(a), " ".join(b)]
    rows = list(dict.fromkeys(rows))
    want = near_by_all_pairs(rows)
    for listed in (1 << 18, 100, 0):
        monkeypatch.setattr(simhash, "ORDER_SHINGLES", listed)
        assert sorted(r.doc_id // 3 for r in simhash.deduplicated(documents(spark, rows)).collect()) == want
