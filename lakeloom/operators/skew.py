"""Skew that is found, not assumed: heavy hitters by a mergeable summary, and salting of just those keys.

Each task keeps a Misra-Gries summary of its rows: so many counters, and whenever there
are more keys, the smallest that would have to go is taken off all.  A counter falls short
by at most n / (counters + 1) of a task's n rows, and so do the sums of all tasks; a key
with its share of all rows therefore can't be missed.  The few candidates are then counted
exactly, in a second pass with a filter of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(held: pd.Series, more: pd.Series, counters: int) -> pd.Series:
    """Two summaries (counts by key) as one of at most ``counters`` keys."""
    both = held.add(more, fill_value=0).astype("int64")
    if len(both) > counters:
        both -= both.nlargest(counters + 1).iloc[-1]
        both = both[both > 0]
    return both


def heavy_hitters(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """(key, n, salts): keys other than null with at least ``share`` of all rows; ``salts``: in how many parts each has about half of that share.

    At most 1 / ``share`` rows.  Two passes over the key's column.
    """
    if not 0 < share <= 1:
        raise ValueError("0 < share <= 1")
    counters = math.ceil(2 / share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = summary(held, batch["k"].value_counts(), counters)
        yield pd.DataFrame({"k": held.index.to_series().astype("object").values, "n": held.to_numpy("int64")})

    kind = df.schema[key].dataType.simpleString()
    keys = df.select(F.col(key).cast("string").alias("k"))
    total = keys.count()
    floor = share * total
    sums = keys.mapInPandas(run, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    found = [r.k for r in sums.filter(F.col("n") >= floor - total / (counters + 1)).select("k").collect()]  # at most 2 / share keys
    exact = keys.filter(F.col("k").isin(found)).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= floor)
    return exact.select(F.col("k").cast(kind).alias(key), "n", F.ceil(2 * F.col("n") / floor).cast("int").alias("salts"))


def _salts(hot: list[tuple], key: str):
    """A key's number of salts; 1 for all keys that aren't hot."""
    out = F.lit(1)
    for value, n in hot:
        out = F.when(F.col(key) == F.lit(value), n).otherwise(out)
    return out


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, how: str = "inner") -> DataFrame:
    """A join by ``key`` in which the keys that ``left`` has too many rows of are dealt out over several tasks.

    Their rows in ``right`` are repeated for each part; all other rows stay single.  Inner
    and left joins; for null keys as Spark has it.
    """
    if how not in ("inner", "left"):
        raise ValueError("rows of the right side are repeated: inner or left")
    hot = [(r[key], r.salts) for r in heavy_hitters(left, key, share).collect()]
    if not hot:
        return left.join(right, key, how)
    part = F.pmod(F.xxhash64(*left.columns), _salts(hot, key)).alias("__salt")
    l = left.select("*", part)  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts(hot, key).cast("long") - 1)))
    return l.join(r, [key, "__salt"], how).drop("__salt")


def skew_groups(df: DataFrame, key: str, first: list, then: list, share: float = 0.01) -> DataFrame:
    """Aggregates by ``key`` in two steps for hot keys only: ``first`` by key and part, ``then`` over those by key.

    For aggregates that can't be combined before the shuffle, such as sets and lists.
    """
    hot = [(r[key], r.salts) for r in heavy_hitters(df, key, share).collect()]
    part = F.pmod(F.xxhash64(*df.columns), _salts(hot, key)) if hot else F.lit(0)
    return df.groupBy(key, part.alias("__salt")).agg(*first).groupBy(key).agg(*then)
