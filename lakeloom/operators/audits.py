"""Data-quality audits.  An audit is a function DataFrame -> violating rows; it passes iff that is empty.

An audit whose verdict on old rows stands may have ``since(new, old)``: what it finds in
the new rows, given the old ones, of which it reads only what it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of, blank, naive_words

Audit = Callable[[DataFrame], DataFrame]


def _rowwise(audit: Audit) -> Audit:
    """An audit that looks at each row, or value, by itself."""
    audit.since = lambda new, old: audit(new)
    return audit


def violates(*conditions: Column) -> Audit:
    """Rows for which any condition holds."""
    return _rowwise(lambda df: df.filter(any_of(*conditions)))


def not_null(*columns: str) -> Audit:
    return violates(*[F.col(c).isNull() for c in columns])


def not_empty_content(text: str) -> Audit:
    t = F.col(text)
    return violates(t.isNull(), t == "", F.length(F.trim(t)) == 0, F.length(t) <= 0, naive_words(t) <= 0)


def positive_amounts(over_zero: list[str], not_below_zero: list[str] = ()) -> Audit:
    return violates(*[F.col(c) <= 0 for c in over_zero], *[F.col(c) < 0 for c in not_below_zero])


def valid_dates(column: str, as_of: Column, first: str = "1900-01-01") -> Audit:
    """Null, before ``first``, or later than a day after ``as_of``."""
    c = F.col(column)
    return violates(c.isNull(), c < F.lit(first).cast("date"), c > as_of + F.expr("INTERVAL 1 DAY"))


def valid_id(column: str) -> Audit:
    return violates(blank(F.col(column).cast("string")))


def count_in_range(column: str, low: int = 0, high: int = 10) -> Audit:
    c = F.col(column)
    return violates(c.isNull(), c < low, c > high, F.floor(c) != c)


def no_duplicates(*keys: str) -> Audit:
    """Keys that occur more than once; of old rows only the keys are read, and only new keys' are counted."""

    def audit(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    def since(new: DataFrame, old: DataFrame) -> DataFrame:
        fresh = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        names = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys])
        known = old.select(*keys).join(names, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return fresh.unionByName(known).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 1")

    audit.since = since
    return audit


def min_length(column: str, least: int, trimmed: bool = False) -> Audit:
    c = F.trim(column) if trimmed else F.col(column)
    return violates(F.length(c) < least)


def words_between(column: str, low: int, high: int) -> Audit:
    return violates(naive_words(F.col(column)) <= low, naive_words(F.col(column)) > high)


def in_list(column: str, allowed: list) -> Audit:
    return _rowwise(lambda df: df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(~F.col(column).isin(allowed)))


def error_integrity(df: DataFrame, code: str, message: str, moment: str, job: str, operation: str) -> DataFrame:
    """One row of five conditional counts over error rows."""
    missing = lambda c: F.count_if(blank(F.col(c).cast("string")))
    return df.agg(*[missing(c).alias(n) for c, n in ((code, "missing_code"), (message, "missing_message"), (moment, "missing_time"), (job, "missing_job"), (operation, "missing_operation"))])


def run(df: DataFrame, audits: dict[str, Audit]) -> DataFrame:
    """(audit, violations, passed) for each audit."""
    counted = [a(df).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("audit"), "violations") for n, a in audits.items()]
    return reduce(DataFrame.unionByName, counted).withColumn("passed", F.col("violations") == 0)


# -- lineage, freshness, volume ------------------------------------------------------------------


def dependencies(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """(model, status) where a model that others need is missing."""
    rows = [(n, "EXISTS" if df is not None else "MISSING") for n, df in tables.items()]
    return spark.createDataFrame(rows, "model string, status string")


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    rows = [(n, "EXISTS" if n in df.columns else "MISSING") for n in names]
    return df.sparkSession.createDataFrame(rows, "column_name string, status string")


def freshness(df: DataFrame, moment: str, as_of: Column, name: str) -> DataFrame:
    """(model, latest, days, status): FRESH to 7 days, STALE to 30, then VERY_STALE."""
    one = df.agg(F.max(moment).alias("latest")).withColumn("days", F.date_diff(as_of, F.to_date("latest")))
    status = F.when(F.col("days") <= 7, "FRESH").when(F.col("days") <= 30, "STALE").otherwise("VERY_STALE")
    return one.select(F.lit(name).alias("model"), "latest", "days", status.alias("status"))


def _band(value: Column, *bands: tuple[float, str], rest: str) -> Column:
    out = None
    for most, name in bands:
        out = F.when(value <= most, name) if out is None else out.when(value <= most, name)
    return out.otherwise(rest)


def time_band(seconds: Column) -> Column:
    return _band(seconds, (60, "ACCEPTABLE"), (300, "SLOW"), rest="VERY_SLOW")


def volume_band(rows: Column) -> Column:
    return F.when(rows == 0, "EMPTY").when(rows < 1_000_000, "NORMAL").when(rows < 10_000_000, "LARGE").otherwise("VERY_LARGE")


def memory_band(mb: Column) -> Column:
    return _band(mb, (100, "LOW"), (1000, "MEDIUM"), rest="HIGH")


def volumes(tables: dict[str, DataFrame], row_bytes: int = 1024) -> DataFrame:
    """(model, n_rows, est_mb, volume, memory) for each table: one aggregate each, put together."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("model"), "n_rows") for n, df in tables.items()]
    every = reduce(DataFrame.unionByName, counted).withColumn("est_mb", F.col("n_rows") * row_bytes / (1024.0 * 1024.0))
    return every.withColumns({"volume": volume_band(F.col("n_rows")), "memory": memory_band(F.col("est_mb"))})
