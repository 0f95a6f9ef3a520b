"""Importance resampling towards a target distribution, by external sort-count.

Features are runs of one to ``max_n`` words, hashed to ``BUCKETS`` buckets.  One pass over
the texts writes them as packed uint16 bucket streams, a row for each slice of documents,
with how many features each document has (its offsets).  Counts come from the streams
alone: pieces of bounded size are sorted, run-length encoded, and the runs are summed by
bucket.  A bucket's gain compares the target's counts with the corpus's; the gains are one
number a bucket, so they go out with the tasks.  A document's weight is the floored mean
of its features' gains, gathered from its stretch of the stream by ``np.add.reduceat``.

A Gumbel draw keyed by the document's id is added, and the largest scores are drawn; ranks
are given out by range, so no task sees all rows.

Cases: null and empty texts have no features and weight 0; equal rows get equal weights,
and consecutive ranks if drawn; ties go to the smaller id; a null doc_id counts as larger
than any other and draws by the text ``null``; a very long text is hashed in parts, its
buckets take four bytes a word; an empty table gives an empty table, an empty target gains
by the corpus alone; other columns, whatever their names, only pass by.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import numbered
from . import common

#: Buckets of features; they have to fit 16 bits.
BUCKETS, MAX_N = 10_000, 2
#: Percent of the documents of at least ``MIN_WORDS`` words that are drawn; key of the draw.
SHARE, MIN_WORDS, SEED = 25, 20, 7
#: Bytes of text in one row of the streams and in one part of a long text; buckets sorted at once.
SLICE, SORTED = 1 << 19, 1 << 22
#: Words: digits, letters and all beyond ASCII (fixed pattern).
_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STREAMS = "ids array<bigint>, words array<bigint>, features array<bigint>, stream binary"


def features(text: bytes, buckets: int = BUCKETS, max_n: int = MAX_N) -> tuple[int, bytes]:
    """Number of words, and the buckets of all features as packed uint16."""
    total, packed, before = 0, [], []  # before: the last words of the part before
    for part in common.parts(text.lower(), SLICE):
        words = _words.findall(part)
        total += len(words)
        sums = list(map(crc32, words))
        found = [sums]
        tail = [b" " + w for w in words]
        row, sums = before + words, list(map(crc32, before)) + sums
        spaced = [b" " + w for w in before] + tail
        for n in range(2, max_n + 1):
            sums = list(map(crc32, spaced[n - 1 :], sums))  # a run's checksum goes on from the run without its last word
            found.append(sums[max(0, len(before) - n + 1) :])
        packed += [(np.array(x, np.uint32) % buckets).astype(np.uint16).tobytes() for x in found]
        before = row[-(max_n - 1) :] if max_n > 1 else []
    return total, b"".join(packed)


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """A row for each slice of documents: ids, numbers of words and features, and the stream of buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets have to fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "_text", SLICE):
            made = [features(t, buckets, max_n) for t in common.blobs(batch.column("_text"))]
            lists = [batch.column("_id").to_pylist(), [n for n, _ in made], [len(s) // 2 for _, s in made]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.list_(pa.int64())) for x in lists), pa.array([b"".join(s for _, s in made)], pa.binary())], ["ids", "words", "features", "stream"]
            )

    return common.id_text(docs, id_col, text_col).mapInArrow(common.task("resample", run), STREAMS)


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stream sorted and run-length encoded: buckets, counts."""
    stream = np.sort(stream, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], stream[1:] != stream[:-1])))
    return stream[first], np.diff(np.append(first, len(stream)))


def counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all :func:`streams`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            bucket, n = runs(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])

        held, size = [], 0
        for batch in batches:
            for stream in common.blobs(batch.column("stream")):
                found = np.frombuffer(stream, np.uint16)
                for at in range(0, len(found), SORTED):
                    held.append(found[at : at + SORTED])
                    size += len(held[-1])
                    if size >= SORTED:
                        yield out()
                        held, size = [], 0
        if size:
            yield out()

    return rows.select("stream").mapInArrow(common.task("resample", run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's smoothed shares, for each bucket."""
    all_s, all_t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: float(target.get(b, 0) + 1) * all_s / (float(source.get(b, 0) + 1) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int32)


def weights(gain: np.ndarray, stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The floored mean gain of each document's stretch of the stream."""
    out = np.zeros(len(sizes), np.int64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(gain[stream], starts, dtype=np.int64) // sizes[full]
    return out


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document of :func:`streams`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, sizes, stream in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                n = np.array(sizes, np.int64)
                found = weights(gain, np.frombuffer(stream, np.uint16), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(n), pa.array(found)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(common.task("resample", run), "doc_id long, n_words long, n_features long, weight long")


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document.

    ``share`` percent of the documents of at least ``min_words`` words are drawn, the
    highest scores first.
    """
    spark = docs.sparkSession
    rows = common.written(streams(docs, id_col, text_col), "streams", "none")
    wanted = target.select(F.lit(0).alias("_none"), target[target_col].alias("_target"))
    source, goal = ({r.bucket: r.n for r in counts(x).collect()} for x in (rows, streams(wanted, "_none", "_target")))  # at most BUCKETS rows each
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = common.written(weighed(rows, gains(source, goal)).withColumn("score", F.col("weight") + gumbel), "scores")
    common.dropped(spark, rows)
    able = F.col("n_words") >= min_words
    most = share * scored.filter(able).count() // 100
    least_first = {"_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit(2**63 - 1))}
    drawn = numbered(scored.filter(able).withColumns(least_first), ["_down", "_id"], "_rank")
    rest = scored.filter(~able).withColumn("_rank", F.lit(None).cast("long"))
    rank = F.when(F.col("_rank") <= most, F.col("_rank")).alias("rank")
    return drawn.select(*rest.columns).unionByName(rest).select("doc_id", "n_features", "weight", "score", rank)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns; rows that share an id go or stay together if any is drawn."""
    drawn = ranked(docs, target, id_col, text_col, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(drawn, docs[id_col].cast("long").eqNullSafe(drawn["_drawn_id"]), "left_semi")
