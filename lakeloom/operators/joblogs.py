"""Job logs: lines to rows, rows to the job-log table's shape, and summaries of tagged lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rates
from ..functions.text import log_time

#: Fields of a log line's JSON (fixed names); all are read as text and cast where used.
FIELDS = (
    "Event", "timestamp", "job_id", "Job Group", "operation", "Operation", "status", "execution_time_ms", "Execution Time",
    "records_processed", "Result Count", "successful_inserts", "records_inserted", "failed_inserts", "records_failed",
    "target_table", "error_code", "error_message",
)
TAGS = ("CUSTOM_METRICS", "BUSINESS_EVENT", "PERFORMANCE_METRICS", "ERROR", "CUSTOM_COMPLETION")
PAYLOAD = T.MapType(T.StringType(), T.StringType())


def log_files(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """path and class of log files: application, operations, metrics, performance or error, by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    kind = F.lit("application")
    for k in ("error", "performance", "metrics", "operations"):
        kind = F.when(name.contains(k), k).otherwise(kind)
    return found.withColumn("log_class", kind)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value.

    Files are split like any text.  A line's number is its place by split and by its
    place in the split, which tasks give to rows as they read on; lines are numbered
    within a split, then shifted by the splits of the file before.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("row"))
    counts = rows.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("file").alias("f"), F.col("at").alias("a"), "first", before.alias("before"))
    placed = rows.join(counts, (rows["file"] == counts["f"]) & (rows["at"] == counts["a"]))
    return placed.select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), "value").filter(F.trim("value") != "")


def json_lines(lines: DataFrame) -> DataFrame:
    """The lines that are one JSON object, as map<string,string> ``data``."""
    rows = lines.filter(F.trim("value").startswith("{"))
    return rows.withColumn("data", F.from_json(F.trim("value"), PAYLOAD)).filter(F.col("data").isNotNull())


def tagged_lines(lines: DataFrame) -> DataFrame:
    """tag, time, data of ``TAG: {json}`` lines; lines whose payload is no JSON are left out."""
    tag = F.regexp_extract("value", rf"({'|'.join(TAGS)}):", 1)
    payload = F.from_json(F.regexp_extract("value", r"(?s)(\{.*)$", 1), PAYLOAD)
    rows = lines.select("file", "line", tag.alias("tag"), log_time(F.col("value")).alias("time"), payload.alias("data"))
    return rows.filter((F.col("tag") != "") & F.col("data").isNotNull())


def tag_summary(tagged: DataFrame, last: int = 5) -> DataFrame:
    """Count of each tag, and its last lines by file and line."""
    counted = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("file"), F.desc("line")))
    return tagged.withColumn("place", place).filter(F.col("place") <= last).join(counted, "tag")


def _epoch(value: Column) -> Column:
    """Seconds, or milliseconds if over 1e12; ISO text is parsed."""
    number = value.try_cast("double")
    return F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("long"))).otherwise(
        value.try_cast("timestamp")
    )


def classified(event: Column) -> dict[str, Column]:
    """level, job_type and operation_type of an event name (null: none)."""
    cases = ((event.isNull(), "unknown", "unknown"), (event == "CustomOperationCompletion", "data_processing", "complete"), (event == "CustomMetricsEvent", "metrics", "log"), (event.contains("BusinessEvent"), "business", "event"))
    kind, operation = F.lit("unknown"), F.lit("unknown")
    for when, k, o in reversed(cases):
        kind, operation = F.when(when, k).otherwise(kind), F.when(when, o).otherwise(operation)
    return {"job_level": F.lit("operation"), "job_type": kind, "operation_type": operation}


def job_log_rows(df: DataFrame, data: str = "data", source: str = "minio", created_by: str = "job_logger") -> DataFrame:
    """Log payloads (map<string,string>) in the shape of the job-log table."""
    of = {f: F.try_element_at(F.col(data), F.lit(f)) for f in FIELDS}
    whole = lambda *names: F.coalesce(*[of[n].try_cast("double").cast("long") for n in names])
    start = _epoch(of["timestamp"])
    ms = F.coalesce(whole("execution_time_ms"), (of["Execution Time"].try_cast("double") * 1000).cast("long"))
    processed, inserted, failed = whole("records_processed", "Result Count"), whole("successful_inserts", "records_inserted"), whole("failed_inserts", "records_failed")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    event = of["Event"]
    return df.select(
        F.coalesce(of["job_id"], of["Job Group"], F.lit("unknown")).alias("job_id"),
        *[c.alias(n) for n, c in classified(event).items()],
        F.coalesce(of["operation"], of["Operation"]).alias("operation_name"),
        F.lit(source).alias("source"),
        of["target_table"].alias("target_table"),
        start.alias("start_time"),
        F.when(start.isNotNull() & (ms > 0), F.timestamp_micros(F.unix_micros(start) + ms * 1000)).alias("end_time"),
        ms.alias("duration_ms"),
        zero(processed).alias("records_processed"),
        zero(inserted).alias("records_inserted"),
        zero(failed).alias("records_failed"),
        F.greatest(zero(processed) - zero(inserted) - zero(failed), F.lit(0)).alias("records_missing"),
        F.when(of["error_code"].isNotNull(), F.create_map(of["error_code"], F.lit(1))).alias("error_codes"),
        F.coalesce(of["status"], F.lit("unknown")).alias("status"),
        rates.success_rate(zero(inserted), zero(processed)).alias("success_rate"),
        F.lit(created_by).alias("created_by"),
    )


#: Columns of the job-log table (fixed names and types).
JOB_LOGS = (
    "job_id string, job_level string, job_type string, operation_type string, operation_name string, app_name string, source string, source_path string,"
    " target_table string, start_time timestamp, end_time timestamp, duration_ms bigint,"
    " records_listed bigint, records_processed bigint, records_inserted bigint, records_failed bigint, records_missing bigint, records_updated bigint, records_deleted bigint,"
    " total_bytes bigint, bytes_transferred bigint, error_codes map<string,int>, error_messages array<string>, error_summary string,"
    " failed_files_by_partition map<string,array<struct<file_path:string,file_size:bigint,error_code:string,error_message:string,retry_count:int,partition_id:int,failed_at:timestamp,executor_id:string>>>,"
    " business_event_count bigint, business_event_types array<string>, custom_metric_count bigint, custom_metric_operations array<string>,"
    " status string, success_rate double, async_logging_enabled boolean, environment string, spark_version string, executor_count int, executor_memory string,"
    " driver_memory string, batch_id string, created_at timestamp, updated_at timestamp, created_by string, updated_by string"
)


def job_logs_schema() -> T.StructType:
    """Needs an active session, as parsing DDL does."""
    return T.StructType.fromDDL(JOB_LOGS)


def conformed(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """All columns of a schema (default: the job-log table), in order; those missing are empty: 0 for numbers, '' for text, else null."""

    def empty(t: T.DataType) -> Column:
        if isinstance(t, T.NumericType):
            return F.lit(0).cast(t)
        return F.lit("") if isinstance(t, T.StringType) else F.lit(None).cast(t)

    return df.select(*[(df[f.name].cast(f.dataType) if f.name in df.columns else empty(f.dataType)).alias(f.name) for f in schema or job_logs_schema()])


def load_job_logs(spark: SparkSession, path: str, write=None) -> DataFrame:
    """Files to job-log rows; with ``write`` (a function of the DataFrame) they are stored too, without it nothing is."""
    rows = conformed(job_log_rows(json_lines(log_lines(spark, path))))
    if write is not None:
        write(rows)
    return rows


def sampled(df: DataFrame, batch: str = "batch_id", every: int = 10) -> DataFrame:
    """Only every so many batches are logged."""
    return df.filter(F.col(batch) % every == 0)


def main(arguments: list[str] | None = None) -> int:
    """``python -m lakeloom.operators.joblogs PATH [--table NAME] [--dry-run]``: log files into the job-log table; the number of rows."""
    import argparse

    parser = argparse.ArgumentParser(description="Loads log files into the job-log table.")
    parser.add_argument("path")
    parser.add_argument("--table", default="job_logs")
    parser.add_argument("--dry-run", action="store_true", help="show the rows and write nothing")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if given.dry_run:
        rows = load_job_logs(spark, given.path)
        rows.show(truncate=False, vertical=True)
        n = rows.count()
    else:
        from ..sources.sinks import insert

        figures: dict = {}
        load_job_logs(spark, given.path, lambda rows: figures.update(insert(rows, given.table)))
        n = figures["total_records"]
    print(f"{n} rows of {given.path} {'would go' if given.dry_run else 'went'} to {given.table}")
    return n


if __name__ == "__main__":
    main()
