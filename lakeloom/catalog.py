"""Catalog work: scripts, DDL templates, table checks, inspection."""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.joblogs import JOB_LOGS


def statements(script: str) -> list[str]:
    """The statements of a SQL script: split at ``;`` outside of quotes and comments; ``--`` and ``/* */`` comments go."""
    out, current, i, n = [], [], 0, len(script)
    while i < n:
        c = script[i]
        if c in "'\"`":
            j = i + 1
            while j < n and script[j] != c:
                j += 2 if script[j] == "\\" and c != "`" else 1
            current.append(script[i : j + 1])
            i = j + 1
        elif script.startswith("--", i):
            i = script.find("\n", i)
            i = n if i < 0 else i
        elif script.startswith("/*", i) and not script.startswith("/*+", i):
            j = script.find("*/", i + 2)
            i = n if j < 0 else j + 2
            current.append(" ")
        elif c == ";":
            out.append("".join(current).strip())
            current = []
            i += 1
        else:
            current.append(c)
            i += 1
    return [s for s in [*out, "".join(current).strip()] if s]


def renamed(script: str, old: str, new: str) -> str:
    """A table's name replaced as a whole identifier: ``a.b`` doesn't touch ``a.b_c``."""
    return re.sub(rf"(?<![\w.`]){re.escape(old)}(?![\w`])", lambda _: new, script)


def filled(script: str, **values: str) -> str:
    """``${name}`` replaced; a name without a value is an error."""
    return re.sub(r"\$\{(\w+)\}", lambda m: values[m[1]], script)


def table_names(script: str) -> list[str]:
    """Names that the script's CREATE TABLE statements create."""
    pattern = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)"
    return [m.replace("`", "") for s in statements(script) for m in re.findall(pattern, s)]


def execute(spark: SparkSession, script: str, stop_on_error: bool = False) -> list[dict]:
    """Each statement's outcome: statement, ok, error.  Later ones still run unless told to stop."""
    spark.sql("SELECT 1").collect()
    out = []
    for s in statements(script):
        try:
            spark.sql(s)
            out.append({"statement": s, "ok": True, "error": None})
        except Exception as e:  # noqa: BLE001  every failure is reported
            if stop_on_error:
                raise
            out.append({"statement": s, "ok": False, "error": str(e).split("\n")[0]})
    return out


def create_all(spark: SparkSession, scripts: dict[str, str]) -> dict[str, bool]:
    """All scripts by name; whether each went through as a whole."""
    return {name: all(x["ok"] for x in execute(spark, script)) for name, script in scripts.items()}


def require_table(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist")


def load_check(df: DataFrame, expected: int) -> DataFrame:
    """One row: expected, actual, ok."""
    return df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(expected).cast("long").alias("expected"), "actual", (F.col("actual") == expected).alias("ok"))


def inspected(spark: SparkSession, skip: tuple[str, ...] = ("information_schema", "system"), counts: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """database, table, columns and rows of every table of the current catalog (or of ``only`` some databases): one job for all counts."""
    kind, parts = "database string, table string, n_columns int, n_rows long", []
    for db in spark.catalog.listDatabases():
        if db.name in skip or only is not None and db.name not in only:
            continue
        for t in spark.catalog.listTables(db.name):
            if not t.isTemporary:
                df = spark.table(f"`{db.name}`.`{t.name}`")
                one = df.agg(F.count(F.lit(1)).alias("n_rows")) if counts else spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
                parts.append(one.select(F.lit(db.name).alias("database"), F.lit(t.name).alias("table"), F.lit(len(df.columns)).alias("n_columns"), "n_rows"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)


def current(spark: SparkSession) -> DataFrame:
    """One row: catalog_name and schema_name that unqualified names belong to."""
    return spark.sql("SELECT current_catalog() AS catalog_name, current_schema() AS schema_name")


def catalogs(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """catalog of each catalog in use."""
    return spark.sql("SHOW CATALOGS" + (f" LIKE '{pattern}'" if pattern else ""))


def schemas(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """namespace of each schema of the current catalog."""
    return spark.sql("SHOW SCHEMAS" + (f" LIKE '{pattern}'" if pattern else ""))


@contextmanager
def using(spark: SparkSession, schema: str):
    """USE for a block, and back."""
    before = spark.catalog.currentDatabase()
    spark.sql(f"USE {schema}")
    try:
        yield spark
    finally:
        spark.sql(f"USE {before}")


def schema_of(df: DataFrame) -> DataFrame:
    """DESCRIBE as rows: position, col_name, data_type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, col_name string, data_type string, nullable boolean")


#: Tables of the energy and document pipelines.
DDL = """
CREATE DATABASE IF NOT EXISTS ${db};
CREATE TABLE IF NOT EXISTS ${db}.pv_data (
  measured_on TIMESTAMP, utc_measured_on TIMESTAMP, metric_id STRING, value DOUBLE, file_path STRING,
  system_id INT, job_id STRING, year INT, month INT, day INT
) USING parquet PARTITIONED BY (year, month, day) COMMENT 'measurements';
CREATE TABLE IF NOT EXISTS ${db}.pv_site (
  av_pressure DOUBLE, av_temp DOUBLE, climate_type STRING, elevation DOUBLE, latitude DOUBLE, location STRING,
  longitude DOUBLE, public_name STRING, site_id INT, system_id INT, file_path STRING, job_id STRING
) USING parquet COMMENT 'sites';
CREATE TABLE IF NOT EXISTS ${db}.pv_system (
  area DOUBLE, comments STRING, ended_on TIMESTAMP, power DOUBLE, public_name STRING, site_id INT,
  started_on TIMESTAMP, system_id INT, file_path STRING, job_id STRING
) USING parquet COMMENT 'systems';
CREATE TABLE IF NOT EXISTS ${db}.docs (
  document_id STRING, document_type STRING, raw_text STRING, file_path STRING, job_id STRING, text_length BIGINT,
  updated_at TIMESTAMP, spark_partition_id INT, task_execution_id BIGINT, loaded_at TIMESTAMP
) USING parquet COMMENT 'document texts';
CREATE TABLE IF NOT EXISTS ${db}.docs_metadata (
  document_id STRING, language STRING, file_size BIGINT, method STRING, schema_version STRING, metadata_file_path STRING,
  job_id STRING, generated_at TIMESTAMP, loaded_at TIMESTAMP, updated_at TIMESTAMP, spark_partition_id INT,
  task_execution_id BIGINT, document_type STRING, source STRING
) USING parquet PARTITIONED BY (document_type, source) COMMENT 'document metadata';
"""
DDL += f"CREATE TABLE IF NOT EXISTS ${{db}}.job_logs ({JOB_LOGS}) USING parquet COMMENT 'jobs, batches and operations';\n"
