import re
from collections import Counter

import pytest
from fixtures import SCHEMA, documents, texts

from lakeloom.llm import collocations as co


def brute(rows, least, top, max_n=4, held=80):
    """All phrases counted one by one; lists for each language."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in cand.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                if 100 * a >= held * cand[lang, words[i : i + m]]:
                    gone.add((lang, words[i : i + m]))
    out = []
    for lang in n:
        rows = []
        for (of, words), a in cand.items():
            if of == lang and (of, words) not in gone:
                score, _, l, r = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))  # noqa: E741
                rows.append((-score, -a, " ".join(words).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return out


def labelled(spark):
    langs = ["en", "fr", None, "und", "", "a\nb"]
    more = ["the of the. of the the of, the of\x01x the of\x01x the of"] * 9 + ["New York new\tyork NEW YORK! new york"] * 5
    rows = [(i, t, langs[i % 7 % 6], "s", 1, *["clash"] * 6) for i, t in enumerate([*texts(), *more] * 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.mark.parametrize(("least", "top", "stretch", "part"), [(3, 2000, co.STRETCH, co.PART), (2, 7, 50, 40), (3, 50, 37, 1 << 20), (30, 2000, 1, 1 << 20)])
def test_brute_force(spark, monkeypatch, least, top, stretch, part):
    monkeypatch.setattr(co, "STRETCH", stretch)
    monkeypatch.setattr(co, "PART", part)
    docs = labelled(spark)
    want = brute([(r.lang, r.text) for r in docs.collect()], least, top)
    got = co.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > (20 if least < 30 else 1)


@pytest.mark.parametrize("parts", ["2", "40"])
def test_a_word_that_begins_most_suffixes_is_split(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = [("en", " ".join(f"the w{j % (i + 2)}" for j in range(200))) for i in range(60)]
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
        got = co.phrases(docs, least=3)
        want = Counter()
        for _, text in rows:
            words = text.split()
            want[""] += len(words)
            for k in range(1, 5):
                want.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
        assert {r.phrase: r.f for r in got.collect()} == {p: n for p, n in want.items() if n >= 3 or not p}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_rows_no_words(spark):
    assert co.collocations(documents(spark).limit(0)).count() == 0
    assert co.collocations(spark.createDataFrame([("en", None), ("en", " .,\n"), (None, "")], "lang string, text string")).count() == 0


def test_products_past_64_bits(spark):
    counts = spark.createDataFrame([("en", p, k, f) for p, k, f in (("a", 1, 9 * 10**18), ("b", 1, 3), ("a b", 2, 9 * 10**18), ("", 0, 9 * 10**18))], "lang string, phrase string, k int, f long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(co, "phrases", lambda *_: counts)
        (row,) = co.collocations(counts, "phrase", "lang").collect()
    assert row.score == 2000000 * 9 * 10**18 // (9 * 10**18 + 3)


def test_text_of_many_megabytes(spark):
    docs = spark.createDataFrame([("en", "some words that come again and again, " * 330_000)], "lang string, text string")
    best = {r.phrase: r for r in co.collocations(docs).collect()}
    assert best["some words that come"].a == 330_000 and best["some words that come"].n == 7 * 330_000
