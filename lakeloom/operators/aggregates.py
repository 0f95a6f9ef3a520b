"""Aggregations that are more than one call: profiles, skew figures, shares, ordered lists, salted sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_sum(value: Column, scale: int = 4) -> Column:
    """A sum that doesn't depend on order: in decimals, then a double."""
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def exact_avg(value: Column, scale: int = 4) -> Column:
    return exact_sum(value, scale) / F.count(value)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_null): one pass, whatever the number of columns."""
    names = columns or df.columns
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return counted.select(F.expr(f"stack({len(names)}, {pairs}) as (column_name, n_null)"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates) in one pass over the groups."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_skew(df: DataFrame, key: str) -> DataFrame:
    """(unique_keys, max_frequency, avg_frequency, skew_ratio): counts a key, then one row."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("unique_keys"),
        F.max("n").alias("max_frequency"),
        (F.sum("n") / F.count(F.lit(1))).alias("avg_frequency"),
        (F.max("n") * F.count(F.lit(1)) / F.sum("n")).alias("skew_ratio"),
    )


def shares(df: DataFrame, key: str) -> DataFrame:
    """(key, n, pct): the total is a window over the few groups, not a second scan."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def sorted_list(order: str, value: str) -> Column:
    """Values in the order of another column: lists have no order of their own."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])


def joined_text(order: str, value: str, separator: str = "\n") -> Column:
    return F.concat_ws(separator, sorted_list(order, value))


def salted(df: DataFrame, keys: list[str], sums: dict[str, Column], salts: int = 16) -> DataFrame:
    """Grouped decimal sums in two steps, the first by key and salt: for sources where map-side combining can't help."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("__salt")
    first = df.select("*", salt).groupBy(*keys, "__salt").agg(*[F.sum(v.cast("decimal(28,4)")).alias(k) for k, v in sums.items()])
    return first.groupBy(*keys).agg(*[F.sum(k).cast("double").alias(k) for k in sums])


def partition_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("record_count"))


def lineage(df: DataFrame) -> DataFrame:
    """Adds spark_partition_id and task_execution_id."""
    return df.withColumns({"spark_partition_id": F.spark_partition_id(), "task_execution_id": F.monotonically_increasing_id()})


#: Rows that bounds of ranges are taken from, for each range.
SAMPLE = 64


def range_bounds(df: DataFrame, order: list[str], ranges: int) -> Column:
    """Bounds that cut ``df`` into about equal ranges of ``order``, from a bounded sample by hash: a scalar subquery, so one value a query."""
    key = F.struct(*order).alias("k")
    drawn = df.select(key).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * ranges).agg(F.sort_array(F.collect_list("k")).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / ranges).cast("int")))
    return drawn.select(F.when(F.size("s") > 0, at).alias("bounds")).scalar()


def range_of(key: Column, bounds: Column, ranges: int) -> Column:
    """How many bounds are at or below the key, by halving."""

    def halve(s: Column, _) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(ranges - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ranges.bit_length())), start, halve)["lo"]


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """A global row number without a single task: cut into ranges, numbered in each range, shifted by the ranges before.

    Rows and counts see the same bounds, whatever columns are read of the result.
    One count a range is summed up; ``order`` should be total.  Nulls come first.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumn("__bounds", range_bounds(df, order, ranges))  # subqueries can't stand inside of lambdas
    placed = placed.withColumn("__part", range_of(F.struct(*order), F.col("__bounds"), ranges)).drop("__bounds")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    joined = placed.withColumn("__in", within).join(F.broadcast(counts), "__part")
    return joined.withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__part", "__in", "__before")
