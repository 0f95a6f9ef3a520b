import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from fixtures import documents, plain
from pyspark.sql import functions as F

from lakeloom.llm import sketch


def fold(longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
    return seed


def brute_sketch(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    shingles = [h[i : i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else [h] if h else []
    return sorted({fold(s) >> 1 for s in shingles if fold(s) >> 1 < 2**63 // sketch.SCALE})


def brute_likeness(a, b):
    x, y = set(brute_sketch(a)), set(brute_sketch(b))
    return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark):
    docs = documents(spark)
    rows = sorted(((i, t) for i, t, _ in plain(docs) if i is not None), key=lambda r: r[0])
    rows = [(None, t) for i, t, _ in plain(docs) if i is None] + rows
    texts = [t for _, t in rows]
    got = sketch.compared(docs).collect()
    want, errors = Counter(), []
    by_key = {}
    for k, (i, t) in enumerate(rows):
        nxt = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        hexes = lambda s: "".join(f"{x:016x}" for x in brute_sketch(s))
        key = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(t), hexes(edited))
        want[key] += 1
        by_key[key] = (t, edited, nxt)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
    for r in got:
        t, edited, nxt = by_key[r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint]
        assert (r.near_edited, r.near_next) == (brute_likeness(t, edited), brute_likeness(t, nxt))
        if len(shingle_set(t)) >= 40:  # an estimate from a fourth of the shingles
            errors += [abs(r.near_edited - jaccard(shingle_set(t), shingle_set(edited))), abs(r.near_next - jaccard(shingle_set(t), shingle_set(nxt)))]
    assert len(errors) > 40 and sum(errors) / len(errors) < 0.05


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_next_over_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(sketch, "RANGE_ROWS", rows)
    docs = spark.createDataFrame([(i * i - 50, f"text {i}") for i in range(40)], "doc_id long, text string")
    got = {r["_id"]: r["_next"]["_text"] for r in sketch.with_next(docs, {}).select("_id", "_next").collect()}
    assert got == {i * i - 50: f"text {(i + 1) % 40}" for i in range(40)}


def test_containment_and_merging(spark):
    words = [f"w{i}" for i in range(3000)]
    long, short = " ".join(words), " ".join(words[500:900])
    row = spark.createDataFrame([(long, short)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    got = row.select(
        sketch.containment(F.col("b"), F.col("a")).alias("in_long"), sketch.likeness(F.col("a"), F.col("b")).alias("alike"), sketch.merged(F.col("a"), F.col("b")).alias("m"), "a"
    ).first()
    assert got.in_long == 1.0 and abs(got.alike - 396 / 2996) < 0.08 and got.m == got.a


def test_text_of_many_megabytes(spark):
    text = " ".join(f"w{i}" for i in range(1_500_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in sketch.compared(docs).collect()}
    assert len(text) > 11_000_000 and got[1].near_next > 0.999 and abs(len(got[1].fingerprint) / 16 - 1_500_000 / sketch.SCALE) < 5000


def test_empty(spark):
    assert sketch.compared(documents(spark).limit(0)).count() == 0
    one = sketch.compared(documents(spark, [None])).first()
    assert (one.fingerprint, one.near_next, one.near_edited) == ("", 1.0, 1.0)
