"""Structured logging of jobs: an operation logger, a queued variant that never blocks, and the vocabulary."""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
from contextlib import contextmanager
from datetime import UTC, datetime
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession

#: Vocabulary of logs (fixed values).
Operation = StrEnum(
    "Operation",
    "dataframe_operation table_exists_check table_creation table_validation table_merge table_insert file_list file_read file_write file_save"
    " sql_query job_start job_complete load_validation schema_validation",
)
Metric = StrEnum(
    "Metric",
    "inputs_discovered inputs_processed inputs_inserted inputs_failed inputs_missing records_discovered records_processed records_inserted records_failed records_missing"
    " input_size_bytes record_size_bytes execution_time_ms insertion_time_ms validation_time_ms partition_count executor_count memory_usage_mb"
    " expected_count actual_count schema_valid data_quality_valid table_exists status",
)
Status = StrEnum("Status", "success failure partial_success in_progress error")
SourceSystem = StrEnum("SourceSystem", "local s3 database api")
LogLevel = StrEnum("LogLevel", [(x, x) for x in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")])


def plain(value):
    """A value that JSON takes: enums and dates as text, containers through and through, anything else as its text."""
    if value is None or isinstance(value, bool | int | float) or type(value) is str:
        return value
    if isinstance(value, StrEnum):
        return str(value)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple | set | frozenset) else str(value)


class JobLogger:
    """One JSON line an entry, to a file, the console, or both; entries also stay in memory."""

    def __init__(self, job_id: str, path: str | None = None, console: bool = False):
        self.job_id, self.entries = job_id, []
        self._log = logging.Logger(f"lakeloom.{job_id}")
        for handler in [logging.FileHandler(path)] * bool(path) + [logging.StreamHandler()] * console:
            handler.setFormatter(logging.Formatter("%(message)s"))
            self._log.addHandler(handler)

    def __enter__(self):
        self.log(Operation.job_start, Status.in_progress)
        return self

    def __exit__(self, kind, error, _):
        self.log(Operation.job_complete, Status.success if error is None else Status.error, {"error": error} if error else {})
        self.close()

    def log(self, operation, status, metrics: dict | None = None) -> dict:
        entry = {"timestamp": datetime.now(UTC).isoformat(), "job_id": self.job_id, "operation": str(operation), "status": str(status)} | plain(metrics or {})
        self.entries.append(entry)
        self._write(json.dumps(entry))
        return entry

    def tagged(self, tag: str, payload: dict) -> None:
        self._write(f"{tag}: {json.dumps(plain(payload))}")

    @contextmanager
    def operation(self, name, **metrics):
        """Logs how long a block took, and whether it failed."""
        began = time.perf_counter()
        try:
            yield
        except Exception as e:
            self.log(name, Status.error, metrics | {"error": e, "execution_time_ms": int(1000 * (time.perf_counter() - began))})
            raise
        self.log(name, Status.success, metrics | {"execution_time_ms": int(1000 * (time.perf_counter() - began))})

    def _write(self, line: str) -> None:
        self._log.info(line)

    def entries_df(self, spark: SparkSession) -> DataFrame:
        """All entries: the four fixed fields, and the metrics as a map."""
        fixed = ("timestamp", "job_id", "operation", "status")
        rows = [(*(e[k] for k in fixed), {k: json.dumps(v) if not isinstance(v, str) else v for k, v in e.items() if k not in fixed}) for e in self.entries]
        return spark.createDataFrame(rows, "timestamp string, job_id string, operation string, status string, metrics map<string,string>")

    def close(self) -> None:
        for handler in list(self._log.handlers):
            handler.close()
            self._log.removeHandler(handler)


class QueuedJobLogger(JobLogger):
    """Lines go through a bounded queue; when it is full they are dropped and counted.  Errors are written at once."""

    def __init__(self, job_id: str, path: str | None = None, console: bool = False, size: int = 1000):
        super().__init__(job_id, path, console)
        self.dropped = 0
        self._queue: queue.Queue = queue.Queue(size)
        self._worker = threading.Thread(target=self._drain, daemon=True)
        self._worker.start()

    def _write(self, line: str) -> None:
        if '"status": "error"' in line or line.startswith("ERROR"):
            super()._write(line)
            return
        try:
            self._queue.put_nowait(line)
        except queue.Full:
            self.dropped += 1

    def _drain(self) -> None:
        while (line := self._queue.get()) is not None:
            super()._write(line)

    def close(self) -> None:
        self._queue.put(None)
        self._worker.join()
        super().close()


def overhead_of_rows(spark, rows: int = 10_000, batches: int = 10, path: str | None = None) -> dict[str, dict[str, float]]:
    """For each way of logging: seconds, and rows a second, of counting ``rows`` by group in so many batches, each logged."""
    out = {}
    for name, make in (("none", None), ("sync", JobLogger), ("queued", QueuedJobLogger)):
        log, began = make("overhead", path) if make else None, time.perf_counter()
        for k in range(batches):
            counted = spark.range(k * rows // batches, (k + 1) * rows // batches).selectExpr("id % 7 AS g").groupBy("g").count().agg({"count": "sum"}).first()[0]
            if log:
                log.log(Operation.dataframe_operation, Status.success, {"batch": k, "rows": counted})
        if log:
            log.close()
        took = time.perf_counter() - began
        out[name] = {"seconds": took, "rows_per_second": rows / took}
    return out


def overhead(messages: int = 1000, path: str | None = None) -> dict[str, float]:
    """Seconds for so many messages: without logging, logged at once, queued."""
    out = {}
    for name, make in (("none", None), ("sync", JobLogger), ("queued", QueuedJobLogger)):
        began = time.perf_counter()
        log = make("overhead", path) if make else None
        for i in range(messages):
            if log:
                log.log(Operation.dataframe_operation, Status.success, {"i": i})
        if log:
            log.close()
        out[name] = time.perf_counter() - began
    return out
