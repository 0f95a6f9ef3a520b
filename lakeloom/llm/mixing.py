"""Mixing sources to target weights, in fixed-length blocks drawn by index.

1. The documents of a source, in a pseudorandom but fixed order, are one run of
   words, cut into blocks of ``BLOCK`` words (the last one shorter).
2. Targets: the sources share ``SHARE`` times all words by weight; none gets more
   than twice its own, and what that leaves is shared again.
3. The mix is dealt to output shards of ``SLOTS`` slots.  A shard draws how many
   slots each source gets from a multinomial.  Draws over a source's target are
   handed to the sources that came out below theirs, so totals are exact.
4. A source's n-th slot is its block ``permute(n mod blocks)`` of pass
   ``n div blocks``: a keyed Feistel permutation for each source and pass.  The last
   slot is cut to the words that the target still lacks.
5. Slots and blocks join by (source, block index), which spreads a hot source.

Only one row for each *source* (a label, at most ``MAX_SOURCES``) visits the driver.
Everything follows from the rows and ``seed``: reruns agree.

Cases: null source is a source of its own, last in order; null and empty texts
have size 0 and are never taken; repeated rows, and ties in the order of a source
(equal id and text), have ranges of their own; a very long text is many blocks; an
empty table gives an empty table; other columns, whatever their names, only pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BLOCK, SLOTS, SHARE, WEIGHTS, CAP = 128, 8192, 1.5, (5, 2, 1), 2
#: Documents of a source whose sizes one task adds up in order.
RUN = 2_000
#: Runs, or shards, of a source that one task adds up in order.
SPAN = 4_096
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Share ``share * sum(sizes)`` by weight; no target over ``cap`` times its size."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, active, left = np.zeros(len(size)), size > 0, share * size.sum()
    while active.any():
        part = left * weight / weight[active].sum()
        over = active & (part > cap * size)
        if not over.any():
            out[active] = part[active]
            break
        out[over] = cap * size[over]
        left -= out[over].sum()
        active &= ~over
    return out.tolist()


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): a four-round Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = common.mix64(np.arange(1, 5, dtype=np.uint64) + common.mix64(np.array([key], np.uint64)))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (common.mix64(right + k) & mask)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_id, _tid, _source, size) with the word count of each document, written to the shared folder."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("_id"),
        F.xxhash64(text).alias("_tid"),
        docs[source_col].cast("string").alias("_source"),
        F.regexp_count(text, F.lit(common.WORD_RE)).cast("long").alias("size"),
    )
    return common.written(rows, "sizes")


class Plan:
    """Per-source figures, held on the driver and sent with the tasks: one entry a source."""

    def __init__(self, totals: list, weights, share: float, cap: float, block: int, seed: int):
        """``totals``: source, words and documents of each source."""
        totals = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
        if len(totals) > MAX_SOURCES:
            raise ValueError(f"over {MAX_SOURCES} sources")
        self.names = [r[0] for r in totals]
        self.sizes = [int(r[1]) for r in totals]
        self.runs = [max(1, int(r[2]) // RUN) for r in totals]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(totals))], share, cap)
        self.words = np.array([min(round(t), int(cap * s)) for t, s in zip(self.targets, self.sizes, strict=True)], np.int64)
        size = np.array(self.sizes, np.int64)
        self.block, self.seed, self.size = block, seed, size
        self.blocks = -(-size // block)
        full, rest = self.words // np.maximum(size, 1), self.words % np.maximum(size, 1)
        self.slots = full * self.blocks + -(-rest // block)
        self.total = int(self.slots.sum())

    def frame(self, spark) -> DataFrame:
        rows = [(i, n, s, float(t), r) for i, (n, s, t, r) in enumerate(zip(self.names, self.sizes, self.targets, self.runs, strict=True))]
        return spark.createDataFrame(rows, "s int, _name string, source_size long, target double, runs long")

    def locate(self, s: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block index and words taken of a source's slots."""
        blocks, size = int(self.blocks[s]), int(self.size[s])
        turn, at = slot // blocks, slot % blocks
        whole = size // self.block  # blocks of full length are permuted; a shorter one stays last
        index = at.copy()
        for t in np.unique(turn):
            mine = (turn == t) & (at < whole)
            if mine.any():
                index[mine] = permute(at[mine], whole, self.seed * 1_000_003 + s * 1009 + int(t))
        left = self.words[s] - turn * size - at * self.block
        return turn, index, np.minimum(np.minimum(self.block, size - index * self.block), left)


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 42) -> Plan:
    return Plan(sizes.groupBy("_source").agg(F.sum("size"), F.count(F.lit(1))).collect(), weights, share, cap, block, seed)


def before(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``base``, the sum of ``value`` over a source's rows that come before by ``order`` (counted from 0).

    In two levels: within spans of SPAN, and over the spans' sums, so that no task walks all rows of a source.
    """
    rows = rows.withColumn("span", F.expr(f"{order} div {SPAN}"))
    spans = rows.groupBy("s", "span").agg(F.sum(value).alias("in_span"))
    earlier = W.partitionBy("s").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("s", "span", F.coalesce(F.sum("in_span").over(earlier), F.lit(0)).alias("of_spans"))
    within = W.partitionBy("s", "span").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("in_span", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(spans, ["s", "span"]).withColumn("base", F.col("of_spans") + F.col("in_span")).drop("span", "of_spans", "in_span")


def offsets(sizes: DataFrame, p: Plan) -> DataFrame:
    """Adds s, source_size, target and ``off``, the document's first word in its source's run."""
    spark = sizes.sparkSession
    frame = p.frame(spark)
    frame = F.broadcast(frame) if len(p.names) <= 100_000 else frame
    rows = sizes.join(frame, sizes["_source"].eqNullSafe(frame["_name"])).drop("_name")
    rows = rows.withColumn("run", F.pmod(F.xxhash64("_id", "_tid"), F.col("runs")))
    base = before(rows.groupBy("s", "run").agg(F.sum("size").alias("words")), "run", "words").select("s", "run", "base")
    within = W.partitionBy("s", "run").orderBy("_id", "_tid").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(base, ["s", "run"]).select(
        "_id", "_tid", "_source", "size", "s", "source_size", "target", (F.col("base") + F.col("within")).alias("off")
    )


def _draw(p: Plan, slots: int):
    share = p.slots / max(p.total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(slots, p.total - shard * slots)
                counts = np.random.default_rng((p.seed, shard)).multinomial(n, share)
                s = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), shard)), pa.array(s.astype(np.int32)), pa.array(counts[s])], ["shard", "s", "n"]
                )

    return run


def slot_table(spark, p: Plan, slots: int = SLOTS) -> DataFrame:
    """(shard, s, slot, pass, block, words): the whole mix, one row a slot."""
    shards = -(-p.total // slots)
    drawn = spark.range(shards).mapInArrow(common.task("mixing", _draw(p, slots)), "shard long, s int, n long")
    got = np.zeros(len(p.names), np.int64)
    for s, n in drawn.groupBy("s").agg(F.sum("n")).collect():
        got[s] = n
    over, under = np.maximum(got - p.slots, 0), np.maximum(p.slots - got, 0)
    over_base, under_end = np.cumsum(over) - over, np.cumsum(under)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, n, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(base, base + n)
                extra = slot >= p.slots[s]
                place = over_base[s] + slot[extra] - p.slots[s]
                heirs = np.searchsorted(under_end, place, side="right")
                owner = np.full(len(slot), s)
                owner[extra] = heirs
                slot[extra] = got[heirs] + place - (under_end - under)[heirs]
                for o in np.unique(owner):
                    own = slot[owner == o]
                    turn, index, words = p.locate(int(o), own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), shard)), pa.array(np.full(len(own), o, np.int32)), *(pa.array(x) for x in (own, turn, index, words))],
                        ["shard", "s", "slot", "pass", "block", "words"],
                    )

    based = before(drawn, "shard", "n").select("shard", "s", "n", "base")
    return based.repartition(max(1, shards // 16), "shard").mapInArrow(common.task("mixing", run), "shard long, s int, slot long, pass long, block long, words long")


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """Documents cut at block borders: (s, block, _from, _to) within the block, _start the piece's word in the document."""
    cut = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")))
    begin = F.greatest("off", F.col("block") * block)
    return cut.select(
        "s", "block", "off", "_id", "_tid", "_source",
        (begin - F.col("block") * block).alias("_from"),
        (F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block).alias("_to"),
        (begin - F.col("off")).alias("_start"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> tuple[DataFrame, DataFrame]:
    """The documents with their offsets, and one row for each piece of one that the mix takes.

    The second has s, off (which tell the document), _id, _tid, _source, shard, slot, pass, _start and ``taken`` words.
    """
    spark = docs.sparkSession
    sizes = placed(docs, id_col, text_col, source_col)
    p = plan(sizes, **options)
    rows = common.written(offsets(sizes, p), "offsets")
    slots = slot_table(spark, p)
    # the planner takes the slots for a few rows, as it can't see what a shard yields; they grow with the corpus
    taken = pieces(rows, p.block).join(slots.hint("merge"), ["s", "block"]).withColumn("taken", F.least("_to", "words") - F.col("_from"))
    return rows, taken.filter("taken > 0").select("s", "off", "_id", "_tid", "_source", "shard", "slot", "pass", "_start", "taken")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    rows, taken = mixed(docs, id_col, text_col, source_col, **options)
    words = taken.groupBy("s", "off").agg(F.sum("taken").alias("taken")).withColumn("real", F.lit(True))
    out = rows.withColumn("real", F.col("size") > 0).join(words, ["s", "off", "real"], "left")
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_word = regex.compile(rb"[^\x20\x09-\x0D]+")


def resampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: one row for each pass that takes words of a document, with just those words.

    Words taken side by side keep the white space between them; apart, they are
    joined by one line break.  Other columns are the document's, but for
    ``n_chars``, which follows the text.  A document untouched by the mix goes.
    """
    rows, taken = mixed(docs, id_col, text_col, source_col, **options)
    spans = taken.groupBy("_id", "_tid", "_source", "off", "pass").agg(F.collect_list(F.struct("_start", "taken")).alias("spans"))
    inner = docs.select(
        *common.apart(docs, text_col),
        docs[id_col].cast("long").alias("_key"),
        docs[source_col].cast("string").alias("_from"),
        F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_txt"),
    )
    if not rows.groupBy("_id", "_tid", "_source").count().filter("count > 1").isEmpty():
        # rows that repeat a document have the same text: the least of them serves all that was taken of any
        inner = inner.groupBy("_key", "_from", "_txt").agg(F.min_by(F.struct("_rest", "_text"), F.to_json("_rest")).alias("row")).select("_key", "_from", "_txt", "row.*")
    same = inner["_key"].eqNullSafe(spans["_id"]) & (inner["_txt"] == spans["_tid"]) & inner["_from"].eqNullSafe(spans["_source"])
    joined = inner.join(spans, same)
    return common.retexted(joined, docs, text_col, "mixing", lambda texts, taken: [_cut(t, s) for t, s in zip(texts, taken, strict=True)], "spans")


def _cut(text: bytes, spans) -> bytes:
    """The words of ``spans`` (first word, number) of a text."""
    wanted: list[list[int]] = []
    for start, n in sorted((s["_start"], s["taken"]) for s in spans):
        if wanted and wanted[-1][1] == start:
            wanted[-1][1] += n
        else:
            wanted.append([start, start + n])
    out, words, at = [], _word.finditer(text), 0
    for a, b in wanted:  # no word past the last one wanted is looked for
        begin = next(islice(words, a - at, None)).start()
        end = next(islice(words, b - a - 2, None)).end() if b - a > 1 else _word.match(text, begin).end()
        out.append(text[begin:end])
        at = b
    return b"\n".join(out)
