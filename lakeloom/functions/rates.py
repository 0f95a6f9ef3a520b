"""Job figures: status, success rate, throughput, completeness, error texts, job ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Descriptions of error codes, and of all others (fixed values).
ERRORS = {
    "E001": "File or directory not found",
    "E011": "Schema validation failed",
    "E021": "Table does not exist",
    "E023": "Record count validation failed",
    "E999": "Unknown error occurred",
}
UNKNOWN = "No description available"


def status(inserted: Column, failed: Column) -> Column:
    return (
        F.when((inserted > 0) & (failed == 0), "success").when((inserted > 0) & (failed > 0), "partial_success").when(failed > 0, "failure").otherwise("error")
    )


def success_rate(inserted: Column, processed: Column) -> Column:
    return F.when(processed > 0, inserted / processed).otherwise(F.lit(0.0))


def throughput(processed: Column, ms: Column) -> Column:
    """Records a second."""
    return F.when(ms > 0, processed * 1000 / ms).otherwise(F.lit(0.0))


def completeness(processed: Column, files: Column) -> Column:
    return F.when(files > 0, F.round(processed / files, 4)).otherwise(F.lit(1.0))


def average_ms(ms: Column, files: Column) -> Column:
    return F.when(files > 0, ms / files).otherwise(F.lit(0.0))


def missing(files: Column, processed: Column) -> Column:
    return F.greatest(files - processed, F.lit(0))


def error_text(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(UNKNOWN))


def job_id(prefix: str) -> Column:
    """``prefix_epoch_8 hex digits``, another one each row."""
    return F.concat_ws("_", F.lit(prefix), F.unix_timestamp().cast("string"), F.substring(F.uuid(), 1, 8))
