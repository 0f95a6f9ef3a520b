import hashlib
from collections import Counter

from fixtures import documents, plain

import corpus_pipeline
from lakeloom.llm import bpe, mixing, qualityrules, simhash
from lakeloom.llm.queries import PATTERN, RANKS


def test_stages_against_plain_python(spark):
    """Each stage on what its predecessor kept, against a one-machine version of it."""
    docs = documents(spark).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_bpe"]

    kept = stages["quality_rules"](spark, docs, "").cache()
    verdict = {r.doc_id: r.kept for r in qualityrules.judged(docs).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _ in plain(docs) if verdict[i])

    lines = stages["line_dedup"](spark, kept, "").cache()
    held: dict = {}
    for i, t, _ in plain(kept):
        for x in t.split("\n"):
            k = x.strip(" \t\n\x0b\x0c\r").lower()
            if len(k) >= 10:
                held[k] = min(held.get(k, i), i)
    want = Counter()
    for i, t, _ in plain(kept):
        left = "\n".join(x for x in t.split("\n") if held.get(x.strip(" \t\n\x0b\x0c\r").lower(), i) == i)
        if left.strip():
            want[i, left] += 1
    assert Counter((i, t) for i, t, _ in plain(lines)) == want

    near = stages["near_dedup"](spark, lines, "").cache()
    rows = sorted({(i, t) for i, t, _ in plain(lines)})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if simhash.similarity(rows[a][1].encode(), rows[b][1].encode()) >= 0.8:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert sorted(i for i, _, _ in plain(near)) == sorted(rows[g][0] for g in set(group))

    mixed = stages["mixing"](spark, near, "").cache()
    taken = Counter({r.doc_id: r.taken for r in mixing.report(near).collect()})
    got = Counter()
    for i, t, _ in plain(mixed):
        got[i] += len(t.encode().split())
    assert got == +taken and sum(got.values()) > 0

    final = Counter(map(tuple, stages["byte_bpe"](spark, mixed, "").collect()))
    own = bpe.tokenizer(RANKS, PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert final == Counter((i, len(own.encode(t)), sha(own.decimal(own.encode(t)).encode()), sha(t.encode())) for i, t, _ in plain(mixed))
    for name in ("quality_rules", "line_dedup", "near_dedup", "mixing"):
        assert stages[name](spark, docs.limit(0), "").columns == docs.columns
        assert stages[name](spark, docs.limit(0), "").count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.n_tokens > 0 for r in rows)


def test_only_own_scratch_is_ever_deleted(spark, tmp_path):
    from lakeloom.llm import common

    path = str(tmp_path / "lakeloom" / "documents.parquet")
    spark.range(5).write.parquet(path)
    theirs, own = spark.read.parquet(path), common.written(spark.range(7).toDF("n"), "some")
    common.dropped(spark, theirs, own)
    assert spark.read.parquet(path).count() == 5
    import pytest

    with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE|PATH_NOT_FOUND"):
        own.count()
