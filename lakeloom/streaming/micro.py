"""Structured Streaming: incremental ingest, micro-batch counts with logs, windows and sessions with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import VersionedTable


def new_files(spark: SparkSession, path: str, schema, kind: str = "parquet", most_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", most_files).load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Everything not yet ingested, then stop; a rerun takes up only what is new."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_table(stream: DataFrame, table: VersionedTable, checkpoint: str, name: str, branch: str = "main", tries: int = 5) -> StreamingQuery:
    """Each micro-batch is one commit of a versioned table, exactly once.

    The commit carries the stream's ``name`` and the batch's number; a batch that comes
    again after a crash between commit and checkpoint is passed over.  If another writer
    moved the branch meanwhile, the batch is appended anew.
    """

    def work(df: DataFrame, batch: int) -> None:
        for left in reversed(range(tries)):
            try:
                table.append(df, branch, (name, batch))
                return
            except RuntimeError:
                if not left:
                    raise

    return each_batch(stream, work, checkpoint)


def batch_counter(key: str, condition, log: Callable[[int, dict], None], every: int = 10) -> Callable[[DataFrame, int], None]:
    """Filter, group, count each micro-batch; every so many batches are logged, with the rows and batches since."""
    since = {"batches": 0, "rows": 0}

    def work(df: DataFrame, batch: int) -> None:
        counts = df.filter(condition).groupBy(key).count()
        found = counts.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first().asDict()
        since["batches"] += 1
        since["rows"] += found["rows"]
        if batch % every == 0:
            log(batch, found | {"batches_since": since["batches"], "rows_since": since["rows"]})
            since.update(batches=0, rows=0)

    return work


def windowed_counts(df: DataFrame, moment: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and key; with a stream, state older than ``late`` is let go."""
    rows = df.withWatermark(moment, late) if df.isStreaming else df
    counts = rows.groupBy(F.window(moment, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def _late(df: DataFrame, moment: str, late: str) -> DataFrame:
    return df.withWatermark(moment, late) if df.isStreaming else df


def sessions(df: DataFrame, moment: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): a key's rows that follow one another within ``gap``.

    A stream's session is out, and its state let go, once the watermark has passed its end.
    """
    found = _late(df, moment, late).groupBy(F.session_window(moment, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def without_duplicates(df: DataFrame, keys: list[str], moment: str, late: str = "10 minutes") -> DataFrame:
    """One row for each value of ``keys``; a stream forgets a value once the watermark has passed it, so its state is bounded by ``late``."""
    return _late(df, moment, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
