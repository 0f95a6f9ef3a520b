"""Ingest as data: a spec names source, rules, casts, target; one runner does the rest in a single pass."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import require_table
from ..functions import rates
from ..functions.casting import safe_cast_columns
from ..operators.aggregates import lineage
from ..sources.files import DOCUMENT_RULES, PARTITION_RULES, count_files, read_files
from ..sources.sinks import Write, insert


@dataclass(frozen=True)
class IngestSpec:
    target: str
    kind: str = "parquet"
    rules: Mapping[str, str] = field(default_factory=dict)
    casts: Mapping[str, list[str]] = field(default_factory=dict)
    shape: Callable[[DataFrame, str], DataFrame] | None = None
    mode: Write = Write.OVERWRITE
    options: Mapping[str, str] = field(default_factory=dict)


def transformed(spark: SparkSession, spec: IngestSpec, paths: str | list[str], job_id: str) -> DataFrame:
    """Read, path columns, safe casts, job id, target's shape: one lazy projection."""
    df = read_files(spark, paths, spec.kind, spec.rules, **spec.options)
    for kind, columns in spec.casts.items():
        df = safe_cast_columns(df, columns, kind)
    return spec.shape(df, job_id) if spec.shape else df.withColumn("job_id", F.lit(job_id))


def run(spark: SparkSession, spec: IngestSpec, paths: str | list[str], job_id: str) -> dict:
    """Ingest into the target table; returns the job's figures.  Counts come with the write."""
    require_table(spark, spec.target)
    began = time.time()
    df = transformed(spark, spec, paths, job_id)
    files = count_files(spark, paths)
    done = insert(df, spec.target, spec.mode)
    results = [(files, done["total_records"], done["successful_inserts"], done["failed_inserts"], int(1000 * (time.time() - began)))]
    figures = job_metrics(spark.createDataFrame(results, "files long, processed long, inserted long, failed long, ms long")).first().asDict()
    return {"job_id": job_id, "target": spec.target} | figures


def job_metrics(df: DataFrame) -> DataFrame:
    """files, processed, inserted, failed, ms rows with status and ratios: a projection."""
    c = F.col
    return df.withColumns(
        {
            "status": rates.status(c("inserted"), c("failed")),
            "records_missing": rates.missing(c("files"), c("processed")),
            "avg_ms_per_file": rates.average_ms(c("ms"), c("files")),
            "completeness": rates.completeness(c("processed"), c("files")),
            "success_rate": rates.success_rate(c("inserted"), c("processed")),
            "throughput": rates.throughput(c("processed"), c("ms")),
        }
    )


def content_rows(df: DataFrame, job_id: str) -> DataFrame:
    """Whole texts in the shape of the document table; rows without an id go."""
    now = F.current_timestamp()
    return lineage(df).filter(F.col("document_id").isNotNull()).select(
        F.col("document_id").cast("string"), F.col("document_type").cast("string"), F.col("value").cast("string").alias("raw_text"), F.col("file_path").cast("string"),
        F.lit(job_id).alias("job_id"), F.length("value").cast("long").alias("text_length"), now.alias("loaded_at"), now.alias("updated_at"), "spark_partition_id", "task_execution_id",
    )


def metadata_rows(df: DataFrame, job_id: str, value: str = "value", source: str = "document_generator", version: str = "v1") -> DataFrame:
    """Metadata JSON in the shape of its table: parsed once, defaults where a field is missing; rows without an id go."""
    m = F.from_json(F.col(value), "source string, language string, file_size string, method string, generated_at string")
    now = F.current_timestamp()
    rows = lineage(df).withColumn("m", m).filter(F.col("document_id").isNotNull())
    return rows.select(
        F.col("document_id").cast("string"),
        F.col("document_type").cast("string"),
        F.coalesce("m.source", F.lit(source)).alias("source"),
        F.coalesce("m.language", F.lit("en")).alias("language"),
        F.coalesce(F.col("m.file_size").try_cast("long"), F.lit(0)).cast("long").alias("file_size"),
        F.coalesce("m.method", F.lit("spark")).alias("method"),
        F.lit(version).alias("schema_version"),
        F.col("file_path").cast("string").alias("metadata_file_path"),
        F.lit(job_id).alias("job_id"),
        F.coalesce(F.col("m.generated_at").try_cast("timestamp"), now).alias("generated_at"),
        now.alias("loaded_at"),
        now.alias("updated_at"),
        "spark_partition_id",
        "task_execution_id",
    )


def pv_data(db: str) -> IngestSpec:
    whole, moments = ["system_id", "year", "month", "day"], ["measured_on", "utc_measured_on"]
    return IngestSpec(f"{db}.pv_data", rules=PARTITION_RULES, casts={"int": whole, "double": ["value"], "timestamp": moments})


def pv_site(db: str) -> IngestSpec:
    return IngestSpec(f"{db}.pv_site", casts={"double": ["av_pressure", "av_temp", "elevation", "latitude", "longitude"], "int": ["site_id", "system_id"]})


def pv_system(db: str) -> IngestSpec:
    return IngestSpec(f"{db}.pv_system", casts={"double": ["area", "power"], "timestamp": ["ended_on", "started_on"]})


def document_contents(db: str) -> IngestSpec:
    return IngestSpec(f"{db}.docs", kind="wholetext", rules=DOCUMENT_RULES, shape=content_rows, mode=Write.APPEND)


def document_metadata(db: str) -> IngestSpec:
    return IngestSpec(f"{db}.docs_metadata", kind="wholetext", rules=DOCUMENT_RULES, shape=metadata_rows, mode=Write.APPEND)
