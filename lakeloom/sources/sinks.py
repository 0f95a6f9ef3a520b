"""Sinks.  A failed write raises; row counts come from the write itself by an Observation, not from a second run."""

from __future__ import annotations

import time
from enum import Enum
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.physical import settings


class Write(Enum):
    OVERWRITE = "overwrite"
    APPEND = "append"
    MERGE = "merge"


def insert(df: DataFrame, table: str, mode: Write = Write.APPEND) -> dict:
    """Rows into an existing table: append, or overwrite of just the partitions that the rows touch.

    Merging needs versions: use ``versions.VersionedTable.merge``.
    """
    if mode is Write.MERGE:
        raise ValueError("MERGE needs a versioned table")
    spark = df.sparkSession
    seen, began = Observation(f"rows-{uuid4().hex[:8]}"), time.time()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n")).select(*spark.table(table).columns)
    if mode is Write.OVERWRITE:
        # inserts into catalog tables ignore the writer's option of this name, so it is a setting for just this write
        with settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
            counted.write.insertInto(table, overwrite=True)
    else:
        counted.write.insertInto(table)
    n = seen.get["n"]
    return {"total_records": n, "successful_inserts": n, "failed_inserts": 0, "error_codes": {}, "insertion_time_ms": int(1000 * (time.time() - began))}


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", by: list[str] | None = None, **options) -> str:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)
    return path


def replace_table(df: DataFrame, table: str, kind: str = "parquet", properties: dict | None = None, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(kind).options(**(properties or {}))
    (writer.partitionBy(*by) if by else writer).saveAsTable(table)


def bucketed(df: DataFrame, table: str, buckets: int, keys: list[str], order: list[str] | None = None) -> None:
    """A table whose joins and aggregates on ``keys`` need no exchange.

    Rows are dealt by the bucket hash first, so each task writes its own buckets: one file a bucket.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys)
    (writer.sortBy(*(order or keys))).saveAsTable(table)


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, rows that don't or where that is unknown)."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def save_documents(df: DataFrame, path: str, valid: Column, by: list[str]) -> None:
    """Contents as text, metadata as JSON, side by side by partition; invalid rows go to ``quarantine``."""
    good, bad = split_valid(df, valid)
    good.select(F.col("content").alias("value"), *by).write.mode("overwrite").partitionBy(*by).option("lineSep", "\u0000").text(f"{path}/content")
    good.drop("content").write.mode("overwrite").partitionBy(*by).json(f"{path}/metadata")
    bad.write.mode("overwrite").json(f"{path}/quarantine")
