import math
import re
from collections import Counter, defaultdict

import numpy as np
from fixtures import documents, plain

from lakeloom.llm import qualityrules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(repeated) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(repeated), failed


def test_base_against_brute_force(spark):
    docs = documents(spark)
    want = Counter((i, *brute(t)) for i, t, _ in plain(docs))
    got = qualityrules.judged(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_distances():
    ref = np.array([0.5, 0.5, 0.0])
    rows = np.array([[1, 1, 0], [0, 0, 3], [0, 0, 0]])
    assert np.allclose(qualityrules.distances(rows, ref), [0, 1, 0])


def test_junk_goes_prose_stays(spark):
    rng = np.random.default_rng(2)
    words = np.array(["".join(rng.choice(list("abcdefghilmnorstu"), k)) for k in np.repeat([2, 3, 5, 8, 9], [20, 30, 100, 300, 2000])])
    zipf = 1 / np.arange(3, len(words) + 3)
    prose = [" ".join(rng.choice(words, 90, p=zipf / zipf.sum())).capitalize() + "." for _ in range(60)]
    junk = ["|".join(f"{a}#{k}$$" for a in "XYZ") + " " + " ".join(f"{k * j * 7919 % 1000:03d}%%{j}" for j in range(60)) for k in range(3)]
    docs = documents(spark, prose + junk)
    kept = {r.doc_id for r in qualityrules.judged(docs).filter("kept").collect()}
    assert kept >= {3 * i for i in range(len(prose)) if not brute(prose[i])[-1]} and not kept & {3 * (len(prose) + k) for k in range(3)}
    out = qualityrules.filtered(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [None, "", "too short"])
    assert [r.kept for r in qualityrules.judged(docs).collect()] == [False] * 3
    assert qualityrules.judged(docs.limit(0)).count() == 0 and qualityrules.filtered(docs.limit(0)).count() == 0


def plain_classes(text):
    """Code points by class, in the order of the operator's histogram."""
    out = [0] * 7
    for c in text:
        out[0 if c in "abcdefghijklmnopqrstuvwxyz" else 1 if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 2 if c in "0123456789" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:!?'\"()-" else 6 if ord(c) > 127 else 5] += 1
    return out


def plain_distance(p, q):
    """Jensen-Shannon distance of two distributions, as dictionaries."""
    total = 0.0
    for k in {*p, *q}:
        m = (p.get(k, 0) + q.get(k, 0)) / 2
        total += sum(x * math.log2(x / m) for x in (p.get(k, 0), q.get(k, 0)) if x) / 2
    return math.sqrt(min(max(total, 0.0), 1.0))


def share(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()} if total else {}


def plain_verdicts(rows):
    """(class distance, word distance, kept) of each (text, language)."""
    lower = lambda t: [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    classes, words = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        if not brute(text)[-1]:
            classes[lang].update(dict(enumerate(plain_classes(text))))
            words[lang].update(lower(text))
    common = {lang: {w for w, n in c.items() if n >= qualityrules.COMMON * sum(c.values())} for lang, c in words.items()}
    every = set().union(*common.values()) if common else set()
    out = []
    for text, _ in rows:
        mine, known = share(dict(enumerate(plain_classes(text)))), Counter(w if w in every else None for w in lower(text))
        by_class = min((plain_distance(mine, share(classes[k])) for k in common), default=0.0) if text else 0.0
        by_words = 0.0
        if known:
            by_words = min((plain_distance(share(known), share(Counter({w: words[k][w] for w in common[k]} | {None: sum(n for w, n in words[k].items() if w not in common[k])}))) for k in common), default=0.0)
        n, chars = sum(known.values()), len(text)
        limit = lambda near, size: near[0] + near[1] / math.sqrt(max(size, 1))
        fits = (chars < qualityrules.MIN_CHARS or by_class <= limit(qualityrules.NEAR_CLASSES, chars)) and (n < qualityrules.MIN_WORDS or by_words <= limit(qualityrules.NEAR_WORDS, n))
        out.append((by_class, by_words, fits and not brute(text)[-1]))
    return out


def test_verdicts_against_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in docs.select("doc_id", "text", "lang").collect()]
    rows = [(i, t, ("ab"[k % 2] if lang else "")) for k, (i, t, lang) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted((str(i), round(a, 7), round(b, 7), k) for (i, _, _), (a, b, k) in zip(rows, plain_verdicts([r[1:] for r in rows]), strict=True))
    got = sorted((str(r.doc_id), round(r.class_distance, 7), round(r.word_distance, 7), r.kept) for r in qualityrules.judged(frame).collect())
    assert [g[0::3] for g in got] == [w[0::3] for w in want] and len({g[3] for g in got}) == 2
    assert all(abs(g[1] - w[1]) < 1e-6 and abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_many_languages_share_a_reference(spark, monkeypatch):
    monkeypatch.setattr(qualityrules, "LANGUAGES", 2)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 40 + i)), f"l{i % 9}") for i in range(40)]
    known = qualityrules.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(known.names) == 3 and qualityrules.OTHERS in known.names


def test_text_of_many_megabytes(spark):
    text = " ".join(f"w{i % 99991}" for i in range(1_700_000))
    got = qualityrules.judged(spark.createDataFrame([(1, text, "x"), (2, None, None)], "doc_id long, text string, lang string")).filter("doc_id = 1").first()
    assert len(text) > 10_000_000 and (got.n_words, got.word_chars) == (1_700_000, len(text) - 1_699_999)
