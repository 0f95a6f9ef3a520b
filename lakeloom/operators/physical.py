"""Physical choices that don't change results: hints, partition counts, salting, settings in a scope."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def settings(spark: SparkSession, **values):
    """Settings for a block (``__`` for dots), put back afterwards whatever happens.

    A DataFrame is planned when it runs: run it inside, or use :func:`session_with`.
    """
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def session_with(spark: SparkSession, **values) -> SparkSession:
    """A sister session (same tables and executors) with its own settings, for DataFrames that are run later."""
    other = spark.newSession()
    for k, v in values.items():
        other.conf.set(k.replace("__", "."), str(v))
    return other


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast the right side only if the optimizer's bound on its size is within ``most_bytes``, else join by merge."""
    size = int(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return left.join(F.broadcast(right) if size <= most_bytes else right.hint("merge"), on, how)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join for a key too hot even for adaptive splitting: the right side is repeated for each salt."""
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])))
    return l.join(r, [key, "__salt"]).drop("__salt")


@contextmanager
def job_group(spark: SparkSession, name: str, description: str = ""):
    """Jobs of a block carry a group (or a tag on Connect) that event logs show; taken back whatever happens."""
    context = getattr(spark, "_sc", None)
    if context is not None:
        context.setJobGroup(name, description)
    else:
        spark.addTag(name)
    try:
        yield
    finally:
        if context is not None:
            for key in ("spark.jobGroup.id", "spark.job.description"):
                context.setLocalProperty(key, None)
        else:
            spark.removeTag(name)


def megabytes(text: str) -> float:
    """``512m``, ``1g``, ``2t``, ``64k`` in MB; bare numbers are bytes."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgt]?)b?", text.strip().lower())
    if not m:
        raise ValueError(f"no size: {text}")
    return float(m[1]) * {"": 1 / 1024**2, "k": 1 / 1024, "m": 1, "g": 1024, "t": 1024**2}[m[2]]


def memory_report(spark: SparkSession) -> DataFrame:
    """(setting, value, mb) of the memory the session asks for, and the total over executors."""
    get = spark.conf.get
    executor, driver, n = get("spark.executor.memory", "1g"), get("spark.driver.memory", "1g"), int(get("spark.executor.instances", "1"))
    rows = [("driver", driver, megabytes(driver)), ("executor", executor, megabytes(executor)), ("executors", str(n), n * megabytes(executor))]
    return spark.createDataFrame(rows, "setting string, value string, mb double")
