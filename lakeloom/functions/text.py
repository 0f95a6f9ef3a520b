"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a log line's time is looked for, first match wins (fixed patterns).
LOG_TIMES = (
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})",
    r"(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})",
    r"(\d{2}:\d{2}:\d{2})",
)


def extract(value: Column, pattern: str, group: int = 1, empty_as_null: bool = True) -> Column:
    """A regular expression's group; null (or '' if asked for) without a match."""
    found = F.regexp_extract(value, pattern, group)
    return F.nullif(found, F.lit("")) if empty_as_null else found


def naive_words(text: Column) -> Column:
    """Pieces between single spaces: empty ones count, '' has one."""
    return F.size(F.split(text, " "))


def blank(text: Column) -> Column:
    return text.isNull() | (F.length(F.trim(text)) == 0)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.encode(text, "utf-8"))


def one_decimal(value: Column) -> Column:
    """A double of at least 1 with one decimal, rounded by its exact binary value, exact halves to even."""
    whole = F.floor(value)
    tenths = ((value - whole) * float(1 << 52)).cast("long") * 10
    digit, rest = F.shiftright(tenths, 52), tenths.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    total = whole * 10 + digit + up.cast("long")
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))


def human_duration(ms: Column) -> Column:
    """``850ms``, ``1.5s``, ``2.0min``."""
    ms = ms.cast("double")
    part = lambda by, unit: F.concat(one_decimal(ms / by), F.lit(unit))
    return F.when(ms < 1000, F.concat(F.rint(ms).cast("long").cast("string"), F.lit("ms"))).when(ms < 60_000, part(1000, "s")).otherwise(part(60_000, "min"))


def human_bytes(size: Column) -> Column:
    """``512B``, then KB, MB and GB in steps of 1024."""
    part = lambda power, unit: F.concat(one_decimal(size.cast("double") / 1024.0**power), F.lit(unit))
    return (
        F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit("B")))
        .when(size < 1024**2, part(1, "KB"))
        .when(size < 1024**3, part(2, "MB"))
        .otherwise(part(3, "GB"))
    )


def log_time(line: Column) -> Column:
    return F.coalesce(*[extract(line, p) for p in LOG_TIMES], F.lit("unknown"))


def render(template: Column, values: Column) -> Column:
    """``{{name}}`` replaced from a map column; names without a value stay."""
    entries = F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(entries, template, lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
