"""Shared helpers: inputs, the shared scratch folder, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java/SQL regular expression of one word; white space is these six ASCII characters only.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
_white = re.compile(rb"[ \t\n\x0b\x0c\r]")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``_id`` (long) and ``_text`` (string, null as empty), whatever else ``docs`` has."""
    return docs.select(
        docs[id_col].cast("long").alias("_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"),
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lakeloom-")
        sc.setCheckpointDir(root)
        sc._jsc.sc().conf().set("spark.checkpoint.dir", root)
    return root


def few_files(df: DataFrame) -> DataFrame:
    """Narrow rows, at most a few a document, dealt out evenly to one task a core: no file for each split or empty partition."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))


def written(df: DataFrame, name: str, deal: str | int = "few") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage is cut, executors may be lost.

    ``deal``: "few" files for narrow tables of at most some rows a document; "size" for
    larger ones, files of the session's advisory size; "none": as the partitions are; or
    just so many files, where the number of rows is known.
    """
    spark = df.sparkSession
    if isinstance(deal, int):
        df = df.repartition(deal)
    else:
        df = few_files(df) if deal == "few" else df.hint("rebalance") if deal == "size" else df
    folder = f"{name}-{uuid.uuid4().hex}"
    path = f"{scratch_root(spark).rstrip('/')}/lakeloom/{folder}"
    _made.add(folder)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that :func:`written` made in this process; no other is ever deleted.
_made: set[str] = set()


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete scratch tables made by :func:`written` that nothing lazily refers to any more; other tables are left alone."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if folder.rsplit("/", 1)[-1] in _made:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, so that executors delete their files now and not some day."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blobs(column: pa.Array) -> list[bytes]:
    """A string or binary Arrow column as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut before white space, so that no word is torn."""
    at = 0
    while len(text) - at > size:
        end = at + size
        found = _white.search(text, end)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that vectors over a batch stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(col.cast(pa.large_binary())).to_numpy(zero_copy_only=False), dtype="float64")))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, base + most, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def apart(docs: DataFrame, text_col: str) -> list[Column]:
    """``_rest``, a struct of all columns but the text, so that no name clashes, and ``_text`` as it is."""
    rest = [docs[c].alias(c) for c in docs.columns if c != text_col]
    return [F.struct(F.lit(0).alias("none"), *rest).alias("_rest"), docs[text_col].cast("string").alias("_text")]


def retexted(rows: DataFrame, docs: DataFrame, text_col: str, name: str, change, extra: str | None = None, recount: bool = True) -> DataFrame:
    """The columns of ``docs`` from ``rows`` (``_rest``, ``_text`` and ``extra``), with ``change``d texts.

    ``change`` gets some texts (bytes, null as empty) and what ``extra`` has for them, and
    returns as many texts; rows with None go.  Texts are worked on in slices of bounded size.
    ``n_chars`` follows the text if ``recount`` says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            more = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
            made = pa.array(change(blobs(batch.column("_text")), more), pa.binary())
            kept = made.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column("_rest").filter(kept), made.filter(kept).cast(pa.string())], ["_rest", "_kept"])

    rows = rows.select("_rest", "_text", *([extra] if extra else []))
    schema = T.StructType([rows.schema["_rest"], T.StructField("_kept", T.StringType())])
    out = rows.mapInArrow(task(name, run), schema)
    new = {text_col: F.col("_kept").cast(docs.schema[text_col].dataType)}
    if recount:
        new["n_chars"] = F.length("_kept").cast("long")
    return out.select(*[(new[c] if c in new else F.col("_rest")[c]).alias(c) for c in docs.columns])


#: Functions that empty an operator's memory in this process, by operator.
_memories: dict[str, list] = {}


def remembers(name: str, forget) -> None:
    """Say how to empty what operator ``name`` keeps between tasks."""
    _memories.setdefault(name, []).append(forget)


def task(name: str, run):
    """``run`` (an iterator of batches to another) as a task of operator ``name``.

    Worker processes serve many operators.  What others remember is dropped first, and
    memory that the task has freed goes back to the system at its end.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def begin(name: str) -> None:
    """Drop what operators other than ``name`` remember in this process."""
    for other, forgets in _memories.items():
        if other != name:
            for forget in forgets:
                forget()


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
