"""Quality rules by distribution divergence.

Each document's histogram of character classes, and that of common words, is
compared with those of every language of the corpus by Jensen-Shannon distance
(base 2, so 0 to 1).  A document is kept if some language is near enough in both.
Guards: the classes count from ``MIN_CHARS`` code points on, the common words from
``MIN_WORDS`` words on; below, that comparison passes.  Above, the distance of a
short text from its own language is noisy, so the limit widens with one over the
square root of the length.

References are sums over all documents that pass the base rules, by ``lang``.  The
``LANGUAGES`` with most words have one each, all others share one.  A common word is one
that makes up at least ``COMMON`` of a reference's words, which bounds their number by
1 / COMMON a reference; words of any length are counted.

Cases: null and empty texts have no words and fail the base rules; null languages are
one, of their own; repeated rows get equal verdicts; ties (a distance at its limit)
pass; a very long text is counted like any other, its histogram in parts; an empty
table gives an empty table; with no reference at all (no document passes the base
rules) the comparison passes; other columns, whatever their names, only pass by.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS_BASE, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
MIN_CHARS, MIN_WORDS = 100, 20
#: Largest distances that pass, and what is added to them over the root of the length: classes, common words.
NEAR_CLASSES, NEAR_WORDS = (0.22, 1.0), (0.45, 0.6)
COMMON = 0.002
#: Languages with a reference of their own at most, and the name of the one that all others share.
LANGUAGES, OTHERS = 1_000, "\0others"
#: Bytes of a text whose classes are counted at once; words that a worker counts before it reports them.
PART, HELD_WORDS = 1 << 20, 100_000

CLASSES = 8


def _class_table() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 white space, 4 prose punctuation, 5 other ASCII, 6 beyond ASCII, 7 continuation byte."""
    table = np.full(256, 5, np.uint8)
    table[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
    table[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
    table[np.frombuffer(b"0123456789", np.uint8)] = 2
    table[np.frombuffer(common.SPACES, np.uint8)] = 3
    table[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 4
    table[0xC0:] = 6
    table[0x80:0xC0] = 7
    return table


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Batch:
    """Counts of some documents' texts (bytes), a row for each."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        split = [t.split() for t in texts]
        self.words = split
        self.n_words = np.fromiter(map(len, split), np.int64, n)
        bytes_ = np.zeros((n, 256), np.int64)
        for i, t in enumerate(texts):
            for at in range(0, len(t), PART):
                bytes_[i] += np.bincount(np.frombuffer(t, np.uint8, min(PART, len(t) - at), at), minlength=256)
        self.classes = np.stack([bytes_[:, _CLASS == k].sum(axis=1) for k in range(CLASSES - 1)], axis=1)  # without continuation bytes
        self.word_chars = self.classes.sum(axis=1) - self.classes[:, 3]
        self.n_symbols = bytes_[:, _SYMBOL].sum(axis=1)
        self.n_dup_lines = np.fromiter(map(_dup_lines, texts), np.int64, n)
        self.n_repeat_words = self._repeats()
        self.base_failed = (self.n_words < MIN_WORDS_BASE) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

    def _repeats(self) -> np.ndarray:
        """Words in windows of eight that occur twice or more in their text."""
        n, total = len(self.words), int(self.n_words.sum())
        if total < WINDOW:
            return np.zeros(n, np.int64)
        ids = _Ids()
        of = np.fromiter((ids[w] for words in self.words for w in words), np.uint64, total)
        owner = np.repeat(np.arange(n), self.n_words)
        codes = common.mix64(of + np.uint64(1))
        windows = np.zeros(total - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + codes[k : total - WINDOW + 1 + k]
        whole = np.flatnonzero(owner[: len(windows)] == owner[WINDOW - 1 :])
        keys = common.mix64(windows[whole] ^ common.mix64(owner[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, whole[twice], 1)
        np.add.at(cover, whole[twice] + WINDOW, -1)
        return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(common.SPACES)]
    return len(lines) - len(set(lines))


def distances(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a distribution; rows without counts: 0."""
    total = rows.sum(axis=1, keepdims=True)
    p = rows / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0)


def _limit(near: tuple[float, float], length: np.ndarray) -> np.ndarray:
    return near[0] + near[1] / np.sqrt(np.maximum(length, 1))


class References:
    """By language: character-class distribution, and that of the common words and all others."""

    def __init__(self, classes: dict[str, np.ndarray], words: dict[str, dict[bytes, int]], totals: dict[str, int]):
        self.names = sorted(k for k, n in totals.items() if n)
        self.index = {w: i for i, w in enumerate(sorted({w for k in self.names for w in words.get(k, {})}))}
        self.classes = [classes[k] / classes[k].sum() for k in self.names]
        self.words = []
        for k in self.names:
            row = np.zeros(len(self.index) + 1)
            for w, n in words.get(k, {}).items():
                row[self.index[w]] = n
            row[-1] = totals[k] - row.sum()
            self.words.append(row / totals[k])

    def nearest(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least distance by classes, that by common words, and the verdict."""
        n = len(batch.words)
        if not self.names:
            return np.zeros(n), np.zeros(n), np.ones(n, bool)
        bins, find = len(self.index) + 1, self.index.get
        found = np.fromiter((find(w, bins - 1) for words in batch.words for w in b" ".join(words).lower().split()), np.int64, int(batch.n_words.sum()))
        counts = np.bincount(np.repeat(np.arange(n), batch.n_words) * bins + found, minlength=n * bins).reshape(n, bins)
        by_class = np.min([distances(batch.classes, r) for r in self.classes], axis=0)
        by_words = np.min([distances(counts, r) for r in self.words], axis=0)
        chars, words = batch.classes.sum(axis=1), batch.n_words
        near = (by_class <= _limit(NEAR_CLASSES, chars)) | (chars < MIN_CHARS)
        return by_class, by_words, near & ((by_words <= _limit(NEAR_WORDS, words)) | (words < MIN_WORDS))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): a word's occurrences, lower-cased, in documents that pass the base rules; classes and the number of words under ``what``."""
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64()]

    def out(lang: str, what: str, items: list[bytes], n: list[int]) -> pa.RecordBatch:
        columns = [[lang] * len(items), [what] * len(items), items, n]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "what", "item", "n"])

    words: dict[str, Counter] = defaultdict(Counter)
    classes: dict[str, np.ndarray] = {}
    for batch in common.sliced(batches, "_text"):
        made = Batch(common.blobs(batch.column("_text")))
        for i, lang in enumerate(batch.column("_lang").to_pylist()):
            if not made.base_failed[i]:
                classes[lang] = classes.get(lang, 0) + np.append(made.classes[i], made.n_words[i])
                words[lang].update(b" ".join(made.words[i]).lower().split())
        del made
        if sum(map(len, words.values())) + CLASSES * len(classes) > HELD_WORDS:
            yield from (out(k, "word", list(c), list(c.values())) for k, c in words.items())
            yield from (out(k, "class", [b"%d" % i for i in range(CLASSES)], v.tolist()) for k, v in classes.items())
            words.clear()
            classes.clear()
    yield from (out(k, "word", list(c), list(c.values())) for k, c in words.items())
    yield from (out(k, "class", [b"%d" % i for i in range(CLASSES)], v.tolist()) for k, v in classes.items())


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Reference histograms from all documents that pass the base rules."""
    rows = docs.select(
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("_lang")
    )
    counted = rows.mapInArrow(common.task("rules", _histograms), "lang string, what string, item binary, n long").groupBy("lang", "what", "item").agg(F.sum("n").alias("n"))
    counted = stored = common.written(counted, "histograms")
    sizes = counted.filter((F.col("what") == "class") & (F.col("item").cast("string") == str(CLASSES - 1)))
    large = F.broadcast(sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang"))
    small = counted.join(large, "lang", "left_anti").withColumn("lang", F.lit(OTHERS)).groupBy("lang", "what", "item").agg(F.sum("n").alias("n"))
    counted = counted.join(large, "lang", "left_semi").unionByName(small)
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES))
    for r in counted.filter("what = 'class'").collect():  # so many rows a reference
        classes[r.lang][int(bytes(r["item"]))] = r.n
    totals = {k: int(v[-1]) for k, v in classes.items()}
    of = docs.sparkSession.createDataFrame([(k, COMMON * n) for k, n in totals.items()], "lang string, least double")
    words: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in counted.filter("what = 'word'").join(F.broadcast(of), "lang").filter("n >= least").collect():  # at most 1 / COMMON a reference
        words[r.lang][bytes(r["item"])] = r.n
    common.dropped(docs.sparkSession, stored)
    return References({k: v[:-1] for k, v in classes.items()}, words, totals)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and both distances, for each document."""
    known = references(docs, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "_text"):
            made = Batch(common.blobs(batch.column("_text")))
            by_class, by_words, near = known.nearest(made)
            arrays = [pa.array(getattr(made, c).astype(np.int64)) for c in COLUMNS]
            arrays += [pa.array(made.base_failed), pa.array(near & ~made.base_failed), pa.array(by_class), pa.array(by_words)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *arrays], ["doc_id", *COLUMNS, "base_failed", "kept", "class_distance", "word_distance"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean, class_distance double, word_distance double"
    return common.id_text(docs, id_col, text_col).mapInArrow(common.task("rules", run), schema)


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are; no shuffle, the text is judged in place."""
    known = references(docs, text_col, lang_col)

    def judge(texts: list[bytes], _) -> list[bytes | None]:
        made = Batch(texts)
        return [t if ok else None for t, ok in zip(texts, known.nearest(made)[2] & ~made.base_failed, strict=True)]

    return common.retexted(docs.select(*common.apart(docs, text_col)), docs, text_col, "rules", judge, recount=False)
