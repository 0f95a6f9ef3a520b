"""File sources: listing, reading with path capture, whole texts, JDBC, path rules.  Nothing here runs an action."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract

#: Rules for key=value folders, and for dated document folders (fixed patterns).
PARTITION_RULES = {
    "system_id": r"system_id=(\d+)",
    "year": r"year=(\d+)",
    "month": r"month=(\d+)",
    "day": r"day=(\d+)",
}
DOCUMENT_RULES = {
    "document_type": r"/\d{8}/([^/]+)/",
    "document_id": r"/([^/]+?)(?:\.[^.]*)?$",
    "year": r"/(\d{4})\d{4}/",
    "month": r"/\d{4}(\d{2})\d{2}/",
    "day": r"/\d{6}(\d{2})/",
}


def list_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path, length, modificationTime of files; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path).select("path", "length", "modificationTime")
    return found.limit(limit) if limit else found


def with_path(df: DataFrame, rules: Mapping[str, str] | None = None, empty_as_null: bool = True, name: str = "file_path") -> DataFrame:
    """Adds the file's path, and a column for each rule's first group."""
    df = df.withColumn(name, F.col("_metadata.file_path"))
    return extracted(df, name, rules or {}, empty_as_null)


def extracted(df: DataFrame, column: str, rules: Mapping[str, str], empty_as_null: bool = True) -> DataFrame:
    return df.withColumns({k: extract(F.col(column), rule, empty_as_null=empty_as_null) for k, rule in rules.items()}) if rules else df


def read_files(spark: SparkSession, paths: str | list[str], kind: str = "parquet", rules: Mapping[str, str] | None = None, empty_as_null: bool = True, **options) -> DataFrame:
    """Any format, with the path captured and path rules applied; ``kind='wholetext'`` is one row a file."""
    if kind == "wholetext":
        df = spark.read.text(paths, wholetext=True)
    else:
        df = spark.read.format(kind).options(**options).load(paths)
    return with_path(df, rules, empty_as_null)


def read_tree(spark: SparkSession, root: str, rules: Mapping[str, str], where: Column | str | None = None, kind: str = "parquet", empty_as_null: bool = True, **options) -> DataFrame:
    """All files below ``root``, whatever their folders, with path rules; ``where`` is a condition on the rules' columns.

    The rules are expressions over the file's path, so the condition is evaluated on the
    listing: files that it rules out aren't opened, and no paths go through the driver's code.
    """
    df = with_path(spark.read.format(kind).options(**options).option("recursiveFileLookup", "true").load(root), rules, empty_as_null)
    return df if where is None else df.filter(where)


def count_files(spark: SparkSession, paths: str | list[str]) -> int:
    """How many files the paths name: a count over the listing, no names and no contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path").count()


def distinct_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold at least one line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path")).distinct()


def suffix(column: Column, ending: str) -> Column:
    return column.endswith(ending)


def extension(column: Column) -> Column:
    """What follows the last dot of the last path part; null without one."""
    return extract(column, r"\.([^./]+)$")


def extension_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(extension(F.col(column)).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def is_remote(path: str) -> bool:
    return path.split("://", 1)[0] in ("s3", "s3a", "minio") if "://" in path else False


def bucket_and_key(path: str) -> tuple[str, str]:
    bucket, _, key = path.split("://", 1)[-1].partition("/")
    return bucket, key


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options) -> DataFrame:
    """A table of another database; with ``key`` and (low, high, parts) read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return reader.load()


def table_or_path(spark: SparkSession, name: str, gateway: str = "catalog", root: str = "") -> DataFrame:
    """One place that tells where a table lives: by path under ``root`` locally, else by its catalog name."""
    return spark.read.parquet(f"{root}/{name.replace('.', '/')}") if gateway == "local" else spark.table(name)
