"""Line dedup: a line survives only in the smallest document that holds it.

Hashes of the lines' keys are range-partitioned by (hash, document, position), so
that a line which a third of all documents share spreads over many partitions.
Each partition is then streamed in order: the first document of a run of equal
hashes is its first occurrence, every other row of the run is dropped.  A run may
begin in an earlier partition; rows kept in a partition's first run are therefore
reported apart, and the heads of boundary runs (one row a partition) settle them.
The result is one zlib-compressed bitmap of dropped lines a document, not text.

Cases: null and empty texts are one empty line; rows that share a doc_id are one
document, and rows equal to each other get equal verdicts; a null doc_id sorts
before all others; an empty table gives an empty table; lines whose key is short
always stay; a very long text is split into its lines by itself; other columns,
whatever their names, only pass by.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points from which on a line's key counts.
MIN_KEY = 10
VERDICT = "kind int, h1 long, h2 long, key long, tid long, pos int"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = common.id_text(docs, id_col, text_col)
    return rows.select("_id", F.coalesce("_id", F.lit(-(2**63))).alias("_key"), F.xxhash64("_text").alias("_tid"), "_text")


def line_hashes(rows: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(h1, h2, key, tid, pos) for each line of ``_keyed`` rows whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in common.sliced(batches, "_text"):
            hashes, owner, place = [], [], []
            for row, text in enumerate(common.blobs(batch.column("_text"))):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip(common.SPACES).lower()
                    if len(key) >= min_key and (key.isascii() or len(key.decode()) >= min_key):
                        hashes.append(digest(key))
                        owner.append(row)
                        place.append(pos)
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("_key").take(owner), batch.column("_tid").take(owner), pa.array(place, pa.int32())],
                ["h1", "h2", "key", "tid", "pos"],
            )

    return rows.select("_key", "_tid", "_text").mapInArrow(common.task("lines", run), "h1 long, h2 long, key long, tid long, pos int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of one sorted partition: kind 0 dropped, 1 kept in the partition's first run, 2 head of its last run."""
    last = None  # hash and first document of the run that is open
    opening = None  # the hash of the partition's first run
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, key, tid, pos = (batch.column(i).to_numpy() for i in range(5))
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh[0] = last is None or (h1[0], h2[0]) != last[0]
        heads = np.append(last[1] if last else 0, key[fresh])  # before them the head of the open run
        first = heads[np.cumsum(fresh)]
        opening = opening or (h1[0], h2[0])
        drop = key != first
        edge = ~drop & (h1 == opening[0]) & (h2 == opening[1])
        out = drop | edge
        last = (h1[-1], h2[-1]), first[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(drop, 0, 1)[out].astype(np.int32)), *(pa.array(x[out]) for x in (h1, h2, key, tid, pos))],
            ["kind", "h1", "h2", "key", "tid", "pos"],
        )
    if last:
        yield pa.RecordBatch.from_pydict(
            {"kind": [2], "h1": [last[0][0]], "h2": [last[0][1]], "key": [last[1]], "tid": [0], "pos": [-1]},
            pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32())]),
        )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for positions in batch.column("positions").to_pylist():
            bits = np.zeros(max(positions) + 1, bool)
            bits[positions] = True
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tid"), pa.array(maps, pa.binary())], ["key", "tid", "gone"])


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(key, tid, gone): a compressed bitmap of the lines to drop, for each document that loses any.

    ``key`` is the doc_id (the least long for null) and ``tid`` the XXH64 of the text.
    """
    spark = docs.sparkSession
    lines = line_hashes(_keyed(docs, id_col, text_col), min_key)
    order = ["h1", "h2", "key", "pos"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    verdicts = common.written(
        lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(common.task("lines", _stream), VERDICT), "lines", "size"
    )
    heads = verdicts.filter("kind >= 1").groupBy("h1", "h2").agg(F.min("key").alias("head"))
    late = verdicts.filter("kind = 1").join(heads, ["h1", "h2"]).filter("key <> head")
    gone = verdicts.filter("kind = 0").select("key", "tid", "pos").unionByName(late.select("key", "tid", "pos"))
    grouped = gone.groupBy("key", "tid").agg(F.collect_set("pos").alias("positions"))
    return grouped.mapInArrow(common.task("lines", _bitmaps), "key long, tid long, gone binary")


def kept_lines(text: bytes, gone: bytes | None) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were."""
    lines = text.split(b"\n")
    if gone is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(gone), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or not bits[i]], len(lines)


def joined(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_text`` and ``gone`` (null where nothing goes)."""
    rows = _keyed(docs, id_col, text_col)
    bits = bitmaps.select(bitmaps.key.alias("_key"), bitmaps.tid.alias("_tid"), "gone")
    return rows.join(bits.hint("shuffle_hash"), ["_key", "_tid"], "left").select("_id", "_text", "gone")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost, sha = [], [], []
            for text, gone in zip(common.blobs(batch.column("_text")), batch.column("gone").to_pylist(), strict=True):
                lines, total = kept_lines(text, gone)
                n.append(total)
                lost.append(total - len(lines))
                sha.append(hashlib.sha256(b"\n".join(lines)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = joined(docs, drop_bitmaps(docs, id_col, text_col, min_key), id_col, text_col)
    return rows.mapInArrow(common.task("lines", run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with the dropped lines taken out of its text; documents that lose lines and of which only white space is left go.

    Other columns stay as they are, but for ``n_chars``, which follows the text; a null text becomes empty.
    """
    inner = docs.select(*common.apart(docs, text_col), F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))).alias("_key"))
    inner = inner.withColumn("_tid", F.xxhash64(F.coalesce("_text", F.lit(""))))
    bits = drop_bitmaps(docs, id_col, text_col, min_key)
    bits = bits.select(bits.key.alias("_key"), bits.tid.alias("_tid"), "gone")

    def cut(text: bytes, gone: bytes | None) -> bytes | None:
        kept = text if gone is None else b"\n".join(kept_lines(text, gone)[0])
        return kept if gone is None or kept.strip(common.SPACES) else None

    rows = inner.join(bits.hint("shuffle_hash"), ["_key", "_tid"], "left")
    return common.retexted(rows, docs, text_col, "lines", lambda texts, gone: [cut(t, g) for t, g in zip(texts, gone, strict=True)], "gone")
