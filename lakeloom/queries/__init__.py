"""Registered queries: each is (spark, sf_dir) -> DataFrame, most with the SQL that must give the same rows.

Integers come out as BIGINT, decimals as DOUBLE, so that both engines agree on types.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(f(Tables(spark, sf_dir)))

        REGISTRY[f.__name__] = (run, sql)
        return f

    return register


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, *names: str) -> SparkSession:
        for n in names:
            getattr(self, n).createOrReplaceTempView(n)
        return self.spark


def plain_types(df: DataFrame) -> DataFrame:
    kinds = {T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint", T.DecimalType: "double", T.FloatType: "double"}
    if not any(type(f.dataType) in kinds for f in df.schema):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast(kinds[type(f.dataType)]).alias(f.name) if type(f.dataType) in kinds else F.col(f"`{f.name}`") for f in df.schema])


for _module in ("relational", "scalar", "texts", "quality", "storage", "surface"):
    import_module(f"{__name__}.{_module}")
