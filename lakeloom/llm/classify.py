"""What the two text classifiers share: the training sample, the single training task, the scoring pass.

Training takes a bounded, deterministic sample of the labelled rows (``limit``, those
with the least hash of doc_id).  Only ids and labels are sorted for it; the join with
the texts broadcasts that bounded list, so no text is shuffled but the sample's own,
and of those at most ``limit``, repeated rows once, reach the one task that fits.  It makes the model and returns its weights; these, bounded by the number of hash
buckets, go out with the scoring tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a fit uses at most.
TRAIN_ROWS = 16_000
#: A row is held out, never learned from, if crc32 of its id as text leaves this remainder.
FOLDS, HELD_OUT = 4, 2
#: Words that a worker remembers the code of.
WORD_CACHE = 400_000


def held_out(id_col) -> F.Column:
    """Null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class WordCodes(dict):
    """64-bit codes of words, remembered up to a bound."""

    def __init__(self, code: Callable[[bytes], int]):
        super().__init__()
        self.code = code

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = n = self.code(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``limit`` labelled rows that aren't held out.

    Rows without a label or an id are left out; an id labelled twice counts once, by
    its larger label; an id with several texts trains on each of them up to the limit,
    on equal ones once.
    """
    ids = training_labels(labels, label, id_col)
    ids = ids.groupBy(F.col(id_col).cast("long").alias("_lid")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    ids = ids.orderBy(F.xxhash64("_lid"), "_lid").limit(limit)
    rows = common.id_text(docs, id_col, text_col)
    rows = rows.join(F.broadcast(ids), rows["_id"] == ids["_lid"]).withColumn("_tid", F.xxhash64("_text"))
    once = rows.groupBy("_id", "_tid").agg(F.first("_text").alias("_text"), F.first("_label").alias("_label"))
    return once.orderBy(F.xxhash64("_tid", "_id"), "_tid", "_id").limit(limit).select("_id", "_text", "_label")


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``labels`` that may be learned from."""
    return labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))


def share(labels: DataFrame, label: str, id_col: str = "doc_id") -> float:
    """The mean of the labels that may be learned from; 0 without any."""
    return float(training_labels(labels, label, id_col).agg(F.avg(F.col(label).cast("int"))).first()[0] or 0.0)


def fitted(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], object]):
    """The model that ``fit`` makes of the sample, in one task; None if there are no two classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(i, t, y) for b in batches for i, t, y in zip(b.column("_id").to_pylist(), common.blobs(b.column("_text")), b.column("_label").to_pylist(), strict=True)]
        got.sort(key=lambda r: xxhash.xxh64_intdigest(r[1], r[0] & 0xFFFFFFFF))
        y = np.array([r[2] for r in got], np.int64)
        model = fit([r[1] for r in got], y) if len(set(y.tolist())) == 2 else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(common.task("classify", run), "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else None


def scored(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], cut: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``cut`` on) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "_text"):
            p = np.clip(score(common.blobs(batch.column("_text"))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = common.id_text(docs, id_col, text_col).withColumn("_held", held_out(F.col("_id")))
    return rows.mapInArrow(common.task("classify", run), "doc_id long, held_out boolean, score double, predicted int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
