"""Phrase collocation mining by Suffix-sigma.

Every word begins a suffix of its piece, cut to ``max_n`` words.  Tasks count equal
suffixes of a stretch of text before anything is shuffled.  Suffixes are dealt out by
language and first word and sorted reverse-lexicographically, so that one stack of open
prefixes counts all phrases of one to ``max_n`` words at once: a prefix is done when a
suffix comes that doesn't begin with it.  A first word with more suffixes than its share
is split by the words that follow; prefixes that are open at a partition's edges go on as
parts, and one sum puts them together.

Phrases that are frequent enough are then joined with their own parts: every cut of a
candidate looks up its first words and its rest, the lowest score counts.  Candidates that
a longer one nearly always holds are dropped, and each language's best are ranked behind
a limit that applies within tasks first.

Where a first word is cut only balances tasks: bounds come from about ``SAMPLE`` documents,
whatever they are, the result is the same.

Cases: null and empty texts have no words; a null language is ``und``, and so is one with
that name; repeated rows count as often as they come; a very long text is cut into parts
that share the words at their edges; an empty table gives an empty table; ids aren't read,
other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of the longest phrase, occurrences of a candidate, rows a language.
MAX_N, LEAST, TOP = 4, 30, 2000
#: Percent of a candidate's occurrences inside a longer one from which on it is dropped.
HELD = 80
#: Score of a phrase whose parts occur nowhere else, twice.
SCALE = 2_000_000
#: Words counted together before the shuffle, bytes in one part of a long text, documents that bounds come from.
STRETCH, PART, SAMPLE = 1 << 20, 1 << 20, 2048
#: What ends a piece of text (fixed values).
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Lower case; a byte that UTF-8 never has for what ends a piece.
_FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * len(BREAKS))
_END = b"\xff"
SUFFIX = "part int, suffix binary, n long"


def tokens(text: bytes) -> list[bytes]:
    """Words and ends of pieces."""
    return text.translate(_FLAT).replace(_END, b" \xff ").split()


class Numbers(defaultdict):
    """Words numbered as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__
        self[_END]

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def suffixes(number: Numbers, streams: dict[str, list[np.ndarray]], max_n: int = MAX_N, unfinished: tuple[str, int] = ("", 0)) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """For each language its distinct suffixes in order, each word followed by a blank, and how many there are of each.

    ``unfinished``: a language of whose last tokens so many begin no suffix here.
    """
    words = [w + b" " for w in number]
    words[0] = b""  # sorts first, so that what ends sorts before what goes on
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    table = pa.array([words[i] for i in order], pa.binary())
    for lang, lists in streams.items():
        found = np.concatenate(lists)
        starts = len(found) - unfinished[1] * (lang == unfinished[0])
        if starts <= 0:
            continue
        found = np.concatenate((rank[found], np.zeros(max_n - 1, np.int32)))
        at = found[:starts] > 0
        columns, alive = [], at
        for k in range(max_n):
            column = np.where(alive, found[k : k + starts], np.int32(0))
            columns.append(column[at])
            alive = column > 0
        # ranks of ever more words: two columns are made one, in their order
        key, back = columns.pop(), []
        while columns:
            seen, key = np.unique(key, return_inverse=True)
            back.append(seen)
            key = columns.pop().astype(np.int64) * len(seen) + key
        seen, n = np.unique(key, return_counts=True)
        names = []
        for below in reversed(back):
            names.append(table.take(pa.array(seen // len(below))))
            seen = below[seen % len(below)]
        names.append(table.take(pa.array(seen)))
        yield lang, pc.binary_join_element_wise(*names, b""), n


def _dealt(bounds: list[bytes], max_n: int):
    """Rows of :data:`SUFFIX` from (lang, text): each key is a language, a line break, and the suffix; ``part`` by the bounds."""

    def rows(number: Numbers, streams: dict, unfinished: tuple[str, int] = ("", 0)) -> Iterator[pa.RecordBatch]:
        for lang, found, n in suffixes(number, streams, max_n, unfinished):
            if not len(n):
                continue
            head = lang.encode() + b"\n"
            # the language's own row counts all its words
            keys = pa.concat_arrays([pa.array([head], pa.binary()), pc.binary_join_element_wise(pa.scalar(head, pa.binary()), found, b"")])
            n = np.append(n.sum(), n)
            first, last = bisect_left(bounds, head), bisect_left(bounds, head + _END)  # words never begin with that byte
            at = [bisect_left(range(len(keys)), b, key=lambda i: keys[i].as_py()) for b in bounds[first:last]]
            part = np.repeat(np.arange(first, last + 1), np.diff([0, *at, len(keys)]))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), keys, pa.array(n.astype(np.int64))], ["part", "suffix", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, streams, size = Numbers(), defaultdict(list), 0
        end = np.zeros(1, np.int32)
        for batch in batches:
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text"), strict=True):
                last: list[bytes] = []
                for part in common.parts(text.as_buffer().to_pybytes(), PART):
                    found = tokens(part)
                    last = (last + found[1 - max_n :])[1 - max_n :] if max_n > 1 else []
                    streams[lang].append(number.of(found))
                    size += len(found)
                    if size >= STRETCH:
                        yield from rows(number, streams, (lang, len(last)))
                        number, streams, size = Numbers(), defaultdict(list), 0
                        streams[lang].append(number.of(last))
                        common.give_back()
                streams[lang].append(end)
        yield from rows(number, streams)

    return run


def _counted(least: int, max_n: int):
    """(lang, phrase, k, f, open) from sorted suffixes: all prefixes by one stack; open ones may go on in another partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Array | None = None  # the suffix before
        stack = [0] * (max_n + 1)  # occurrences so far of its first k words
        opening = [True] * (max_n + 1)  # whether no other prefix of k words came before

        def out(found: list[tuple[bytes, int, int, bool]]) -> pa.RecordBatch:
            split = [(*key.rsplit(b"\n", 1), k, f, o) for key, k, f, o in found]
            columns = list(zip(*split, strict=True)) or [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([made[0].cast(pa.string()), made[1].cast(pa.string()), *made[2:]], ["lang", "phrase", "k", "f", "open"])

        def prefix(key: pa.Scalar, k: int) -> bytes:
            return b" ".join(key.as_py().split(b" ")[:k])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column("suffix"), batch.column("n").to_numpy()
            keys, n = (keys, n) if last is None else (pa.concat_arrays([last, keys]), np.append(0, n))
            split = pc.split_pattern(keys, b" ")
            begin = split.offsets.to_numpy()
            words = np.maximum(np.diff(begin) - 1, 1)  # behind the last blank there is nothing; a language's own row has no blank
            codes = split.flatten().dictionary_encode().indices.to_numpy()
            same, found = np.ones(len(keys), bool), []
            same[0] = False
            for k in range(1, max_n + 1):
                code = np.where(words >= k, codes[np.minimum(begin[:-1] - begin[0] + k - 1, len(codes) - 1)], -1)
                same[1:] &= code[1:] == code[:-1]
                starts = np.flatnonzero(~same)
                total = np.add.reduceat(n, starts)
                total[0] += stack[k]
                true = code[starts] >= 0
                done = np.ones(len(starts), bool)
                done[-1] = False
                edge = np.zeros(len(starts), bool)
                if true.any() and opening[k]:
                    edge[np.argmax(true)] = True  # the partition's first
                    opening[k] = not (true & done).any()
                found += [(prefix(keys[int(starts[i])], k), k, int(total[i]), bool(edge[i])) for i in np.flatnonzero(true & done & (edge | (total >= least)))]
                stack[k] = int(total[-1]) if true[-1] else 0
            last = keys.slice(len(keys) - 1)
            yield out(found)
        if last is not None:
            key = last[0]
            deep = max(1, key.as_py().count(b" "))
            yield out([(prefix(key, k), k, stack[k], True) for k in range(1, deep + 1)])

    return run


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_n: int = MAX_N) -> DataFrame:
    """(lang, phrase, k, f): phrases of ``k`` words, 1 to ``max_n``, with at least ``least`` occurrences; ``k`` is 0 for all words of a language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("_lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = rows.sample(min(1.0, SAMPLE / max(1, rows.count())), 7).mapInArrow(common.task("phrases", _dealt([], max_n)), SUFFIX)
    shares = [F.lit(i / parts) for i in range(1, parts)]
    # of a part's bounds a sorted sample, of bounded size, is drawn by hash
    sample = drawn.orderBy(F.xxhash64("suffix"), "suffix").limit(64 * parts).agg(F.sort_array(F.collect_list("suffix")).alias("s"))
    found = sample.select(F.transform(F.array(*shares), lambda q: F.get("s", F.floor(q * F.size("s")).cast("int"))).alias("b")).first().b
    bounds = sorted({bytes(b) for b in found if b is not None})
    dealt = rows.mapInArrow(common.task("phrases", _dealt(bounds, max_n)), SUFFIX).repartitionById(parts, "part")
    ordered = dealt.select("suffix", "n").sortWithinPartitions(F.desc("suffix"))
    counted = ordered.mapInArrow(common.task("phrases", _counted(least, max_n)), "lang string, phrase string, k int, f long, open boolean")
    total = counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(F.col("k")))
    return total.filter((F.col("f") >= least) | (F.col("k") == 0))


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_n: int = MAX_N, top: int = TOP, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, see the module."""
    counts = common.written(phrases(docs, text_col, lang_col, least, max_n), "phrases")
    words = lambda c: F.split(c, " ")
    own = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    part = counts.filter(F.col("k").between(1, max_n - 1)).select("lang", F.col("phrase").alias("part"), F.col("f").alias("p"))
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("*", F.array_join(F.slice(words("phrase"), F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(words("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "left", "p": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"part": "right", "p": "r"}), ["lang", "right"])
    quotient = F.expr(f"(cast({SCALE} as decimal(8,0)) * cast(a as decimal(20,0))) div cast(cast(l as decimal(20,0)) + cast(r as decimal(20,0)) as decimal(20,0))")
    lowest = F.min(F.struct(quotient.alias("score"), "cut", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words("phrase"), i, m), " "))))
    inside = own.filter("k >= 3").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * _exact(F.col("longest")) < held * _exact(F.col("a"))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place).filter(F.col("rank") <= top)
    every = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
