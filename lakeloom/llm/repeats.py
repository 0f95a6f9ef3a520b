"""Suffix-array dedup: every byte covered by a LENGTH-byte string that also starts elsewhere goes.

A suffix array of the whole corpus would hold one suffix a byte.  This one is sparse:
each window of LENGTH bytes is represented by its anchor, the start of its least-hashed
``K``-byte substring (the first, if tied).  Equal windows have equal anchors at the same
offset, so only suffixes at anchors, about one in 77 bytes, are ever compared.

1. One pass finds each document's anchors: the hash of the K bytes, and the hash of the
   context, which is all that windows around the anchor can touch.
2. Anchors whose K bytes occur once are done.  The others are grouped by (K bytes,
   context): a context that occurs twice or more is repeated as a whole, which settles
   copies, thousands of them as one row.
3. Groups with several contexts are sorted by deep-shallow sorting, twice: by the
   suffix from the anchor on, and by the reversed prefix before it.  Common prefixes of
   neighbours give, for every offset, classes of equal left and right parts; a window
   is repeated if it shares both classes with another context.
4. A group of more than ``GROUP`` contexts (one passage, a third of all documents, as
   many different neighbours) is split: windows that start in either half of the
   offsets have a longer core in common, so each half is grouped anew by its own core,
   contexts that now agree collapse, and so on; at one offset the core is the window.

Cases: null and empty texts have 0 bytes; texts under LENGTH bytes lose nothing;
repeated rows are documents of their own, so each is the other's copy, and stand for a
context once; ties of anchors go to the first; a very long text is cut into parts of
BUFFER bytes with margins, and what goes of it is a list of runs, never a mask; an empty
table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, suffixsort

LENGTH, K = 200, 48
REACH = LENGTH - K  # how far before its anchor a window may start
GROUP = 8_000
#: Bytes of text hashed at once, contexts sorted at once.
BUFFER, SORTED = 1 << 20, 40_000
#: Low bits of an anchor's hash that give way to its place, the same in any batch (a batch has under twice BUFFER bytes).
PLACE = 22

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a random number for each byte."""
    ones = np.ones(n, np.uint64)
    ones[1:] = _BASE
    back = np.ones(n, np.uint64)
    back[1:] = pow(_BASE, -1, 1 << 64)
    return np.multiply.accumulate(ones), np.multiply.accumulate(back), common.mix64(np.arange(1, 257, dtype=np.uint64))


common.remembers("repeats", _powers.cache_clear)


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Lists of (row, window starts from, to, offset, bytes) of about BUFFER bytes; a long text is cut with margins."""
    held, size = [], 0
    for row, text in enumerate(texts):
        last = len(text) - LENGTH + 1
        for lo in range(0, max(last, 0), BUFFER):
            hi = min(lo + BUFFER, last)
            a = max(0, lo - REACH)
            part = text[a : hi + REACH + LENGTH]
            held.append((row, lo, hi, a, part))
            size += len(part)
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchors(segments, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, position, hash of the K bytes, hash of the context, of each anchor."""
    data = np.frombuffer(b"".join(s[4] for s in segments), np.uint8)
    n = len(data)
    size = np.array([len(s[4]) for s in segments])
    begin = np.cumsum(size) - size
    powers, back, number = _powers(1 << max(n, 1 << 21).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(number[data] * powers[:n], out=sums[1:])
    grams = common.mix64((sums[K:] - sums[:-K]) * back[: n - K + 1])
    bits = np.uint64(PLACE)  # not by the batch's size: equal windows have equal anchors whatever is around them
    least = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    width, reach = 1, REACH + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    starts = np.concatenate([np.arange(b + s[1] - s[3], b + s[2] - s[3]) for b, s in zip(begin.tolist(), segments, strict=True)])
    at = np.unique((least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    of = np.searchsorted(begin, at, side="right") - 1
    row = np.array([s[0] for s in segments])[of]
    position = at - begin[of] + np.array([s[3] for s in segments])[of]
    left, right = np.minimum(position, REACH), np.minimum(lengths[row] - position, LENGTH)
    context = (sums[at + right] - sums[at - left]) * back[at - left]
    context = common.mix64(context + left.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + right.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return row, position, grams[at], context


def anchors(rows: DataFrame) -> DataFrame:
    """(h, c, doc, pos) of all anchors of ``_doc``, ``_text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "_text"):
            texts = common.blobs(batch.column("_text"))
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            done = (-1, -1)
            for segments in _segments(texts):
                row, pos, h, c = _anchors(segments, lengths)
                new = (row > done[0]) | (pos > done[1])  # the margin of a cut text was seen before
                done = (row[-1], pos[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new].view(np.int64)), pa.array(c[new].view(np.int64)), batch.column("_doc").take(pa.array(row[new])), pa.array(pos[new])],
                    ["h", "c", "doc", "pos"],
                )

    return rows.select("_doc", "_text").mapInArrow(common.task("repeats", run), "h long, c long, doc long, pos long")


def repeated_offsets(groups: np.ndarray, n: np.ndarray, left: list[bytes], right: list[bytes], lo: int = 0, hi: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """For each context the farthest and nearest start before its anchor of a repeated window; -1 if there is none.

    ``groups`` numbers the contexts' groups (equal K bytes), ``n`` how often each occurs.
    Only windows that start lo to hi bytes before the anchor are looked at.
    """
    m = len(groups)
    _, groups = np.unique(groups, return_inverse=True)
    left_order, left_shared = suffixsort.sort([x[::-1] for x in left], groups)
    right_order, right_shared = suffixsort.sort([x[K:] for x in right], groups)
    left_size, right_size = np.fromiter(map(len, left), np.int64, m), np.fromiter(map(len, right), np.int64, m)
    far, near = np.full(m, -1), np.full(m, -1)
    left_class, right_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for start in range(lo, hi + 1):
        whole = np.flatnonzero((left_size >= start) & (right_size >= LENGTH - start))
        if not len(whole):
            continue
        left_class[left_order] = np.cumsum(left_shared < start)
        right_class[right_order] = np.cumsum(right_shared < LENGTH - start - K)
        key = left_class[whole] * (m + 1) + right_class[whole]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = n[whole] > 1
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = whole[again]
        near[hit[near[hit] < 0]] = start
        far[hit] = start
    return far, near


def _sorter(lo: int, hi: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            g, n = batch.column("g").to_numpy(), batch.column("n").to_numpy()
            far, near = repeated_offsets(g, n, common.blobs(batch.column("l")), common.blobs(batch.column("r")), lo, hi)
            hit = far >= 0
            picked = pa.array(np.flatnonzero(hit))
            return pa.RecordBatch.from_arrays([batch.column("g").take(picked), batch.column("c").take(picked), pa.array(far[hit]), pa.array(near[hit])], ["g", "c", "far", "near"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED:
                table = pa.Table.from_batches(held).combine_chunks()
                g = table.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if cut:
                    yield out(table.slice(0, cut).to_batches()[0])
                held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


FOUND = "g long, c long, far long, near long"


def resolved(contexts: DataFrame, lo: int = 0, hi: int = REACH, group: int = GROUP) -> DataFrame:
    """(g, c, far, near) of the contexts (g, c, n, l, r) with a window repeated in their group."""
    sort = lambda rows: rows.repartition("g").sortWithinPartitions("g").mapInArrow(common.task("repeats", _sorter(lo, hi)), FOUND)
    hot = common.written(contexts.groupBy("g").count().filter(F.col("count") > group).select("g"), "hot")
    if hot.isEmpty():
        common.dropped(contexts.sparkSession, hot)
        return sort(contexts)
    contexts = common.written(contexts, "contexts", "size")
    parts = [sort(contexts.join(hot, "g", "left_anti"))]
    wide = contexts.join(hot, "g", "left_semi")
    mid = (lo + hi) // 2
    for a, b in [(lo, mid), (mid + 1, hi)] if lo < hi else [(lo, lo)]:
        tail = lambda k: F.expr(f"substring(l, greatest(octet_length(l) - {k} + 1, 1), {k})")
        half = wide.filter(f"octet_length(l) >= {a} and octet_length(r) >= {LENGTH - b}")
        half = half.withColumns({"nl": tail(b), "nr": F.substring("r", 1, LENGTH - a)})
        half = half.withColumn("ng", F.xxhash64("g", tail(a), F.substring("r", 1, LENGTH - b)))
        half = half.withColumn("nc", F.xxhash64("nl", F.lit("|"), "nr"))
        half = common.written(half.select("g", "c", "n", "ng", "nc", "nl", "nr"), "half", "size")
        regrouped = half.groupBy(F.col("ng").alias("g"), F.col("nc").alias("c")).agg(F.sum("n").alias("n"), F.min("nl").alias("l"), F.min("nr").alias("r"))
        if a == b:  # the core is the whole window
            below = regrouped.filter("n > 1").select("g", "c", F.lit(a).cast("long").alias("far"), F.lit(a).cast("long").alias("near"))
        else:
            below = resolved(regrouped, a, b, group)
        below = below.select(F.col("g").alias("ng"), F.col("c").alias("nc"), "far", "near")
        parts.append(half.select("g", "c", "ng", "nc").join(below, ["ng", "nc"]).select("g", "c", "far", "near"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("g", "c").agg(F.max("far").alias("far"), F.min("near").alias("near"))


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, c, n, l, r): the bytes before and from the anchor, for each context that a document stands for.

    Rows that repeat a document come to the same partition, where the first one serves.
    """
    seen: set[int] = set()
    for batch in common.sliced(batches, "_text"):
        g, c, n, left, right = [], [], [], [], []
        for doc, text, wanted in zip(batch.column("_doc").to_pylist(), common.blobs(batch.column("_text")), batch.column("wanted").to_pylist(), strict=True):
            if doc in seen:
                continue
            seen.add(doc)
            for w in wanted:
                p = w["pos"]
                g.append(w["h"])
                c.append(w["c"])
                n.append(w["n"])
                left.append(text[max(0, p - REACH) : p])
                right.append(text[p : p + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["g", "c", "n", "l", "r"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.id_text(docs, id_col, text_col).withColumn("_doc", F.xxhash64("_id", "_text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(doc, spans): for each document, by the XXH64 of id and text, the repeated runs as (pos, far, near) around anchors.

    A run reaches from ``far`` bytes before ``pos`` to LENGTH - ``near`` bytes after; null: all of the context.
    """
    rows = _rows(docs, id_col, text_col)
    every = anchors(rows)
    # written, so that both sides of the join come straight from an exchange and a hot hash can be split
    often = common.written(every.groupBy("h").count().filter("count > 1").select("h"), "often", "size")
    shared = common.written(every.join(often, "h", "left_semi"), "anchors", "size")
    contexts = common.written(shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("at")), "contexts")
    several = common.written(contexts.groupBy("h").count().filter("count > 1").select("h"), "several")  # as above
    wanted = contexts.join(several, "h", "left_semi").groupBy(F.col("at.doc").alias("_doc")).agg(F.collect_list(F.struct("h", "c", "n", F.col("at.pos").alias("pos"))).alias("wanted"))
    # the texts are the large side of both joins: they stream past a hash table of the other, without a sort
    once = rows.select("_doc", "_text").join(wanted.hint("shuffle_hash"), "_doc").mapInArrow(common.task("repeats", _cut_contexts), "g long, c long, n long, l binary, r binary")
    found = common.written(resolved(once, group=group), "repeats")
    whole = contexts.filter("n > 1").select("h", "c", F.lit(None).cast("long").alias("far"), F.lit(None).cast("long").alias("near"))
    part = found.select(F.col("g").alias("h"), "c", "far", "near").join(whole.select("h", "c"), ["h", "c"], "left_anti")
    verdicts = whole.unionByName(part)
    spans = shared.join(verdicts, ["h", "c"]).groupBy("doc").agg(F.collect_list(F.struct("pos", "far", "near")).alias("spans"))
    return spans


def removed(size: int, spans) -> list[tuple[int, int]]:
    """The maximal runs (from, to) of a text's bytes that go."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(
        (s["pos"] - (min(s["pos"], REACH) if s["far"] is None else s["far"]), min(size, s["pos"] + LENGTH) if s["near"] is None else s["pos"] + LENGTH - s["near"]) for s in spans or ()
    ):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What stays of a text."""
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text


def _joined(docs: DataFrame, id_col: str, text_col: str, group: int) -> DataFrame:
    spans = repeats(docs, id_col, text_col, group).withColumnRenamed("doc", "_doc")
    return _rows(docs, id_col, text_col).join(spans.hint("shuffle_hash"), "_doc", "left").select("_id", "_text", "spans")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, ``kept`` (binary: what stays may cut a character) and ``spans`` (removed runs as from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "_text"):
            texts = common.blobs(batch.column("_text"))
            gone = [removed(len(t), x) for t, x in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            left = [kept(t, x) for t, x in zip(texts, gone, strict=True)]
            runs = [[{"from": a, "to": b} for a, b in x] for x in gone]
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(left, pa.binary()), pa.array(runs, kind)], ["doc_id", "kept", "spans"])

    return _joined(docs, id_col, text_col, group).mapInArrow(common.task("repeats", run), "doc_id long, kept binary, spans array<struct<from:long,to:long>>")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "_text"):
            size, lost, runs, sha = [], [], [], []
            for text, spans in zip(common.blobs(batch.column("_text")), batch.column("spans").to_pylist(), strict=True):
                gone = removed(len(text), spans)
                size.append(len(text))
                lost.append(sum(b - a for a, b in gone))
                runs.append(len(gone))
                sha.append(hashlib.sha256(kept(text, gone)).hexdigest())
            ints = [pa.array(x, pa.int64()) for x in (size, lost, runs)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *ints, pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs, id_col, text_col, group).mapInArrow(common.task("repeats", run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
