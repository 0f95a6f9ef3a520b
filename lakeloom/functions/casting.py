"""Safe casts: a value that doesn't fit becomes null, never an error, ANSI mode on or off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a number in text (a fixed pattern).
NUMERIC = r"^-?\d+\.?\d*$"


def safe_cast(value: Column, kind: str) -> Column:
    """``value`` cast to int, bigint, double, ... if its trimmed text is numeric; timestamps and dates by their own syntax.

    Integers are cut off toward zero (``12.5`` gives 12); out of range gives null.
    """
    text = value.cast("string")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.trim(text).try_cast(kind)
    number = F.when(F.trim(text).rlike(NUMERIC), F.trim(text))
    if kind in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        whole = F.regexp_extract(number, r"^-?\d+", 0)
        return whole.try_cast(kind)
    return number.try_cast(kind)


def safe_cast_columns(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """All columns in their order, those named cast safely."""
    return df.select(*[safe_cast(df[c], kind).alias(c) if c in columns else df[c] for c in df.columns])
