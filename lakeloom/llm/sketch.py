"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction ``1 / SCALE`` of
the hash range, and nothing else, whatever the document's length, so sketches merge by
union and give containment between very unequal documents.

Shingles are five lower-cased words; a text of one to four words is one shingle.
Hashes are XXH64 over the words' XXH64, shifted to 63 bits.

Cases: null and empty texts have an empty sketch; two empty sketches, which short texts
may have too, are evidence of nothing (0.0) unless the texts are equal (1.0, as equal
texts always are); repeated rows, and ties of ids, follow one another by text; null ids
come first; the last document's next is the first, its own if it is alone; a very long
text is one array of hashes, 8 bytes a word; an empty table gives an empty table; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHINGLE, SCALE = 5, 4
LIMIT = (1 << 63) // SCALE
#: Documents of a range that one window walks in order, and how many ranges there are at most (their bounds visit the driver); of more documents ranges are larger.
RANGE_ROWS, MAX_RANGES = 2_000, 100_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a plain alias would be inlined into every lambda that uses it."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, shingle: int = SHINGLE, limit: int = LIMIT) -> Column:
    """Sorted array of the kept hashes of a text (not null)."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        n = F.size(h) - shingle + 1
        long = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
        return F.when(n > 0, long).otherwise(short)

    every = F.transform(let(hashed, shingled), lambda x: F.shiftrightunsigned(x, 1))
    return F.sort_array(F.array_distinct(F.filter(every, lambda x: x < limit)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents' shingles from their sketches."""

    def jaccard(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"])).cast("double")
        union = F.size(s["a"]) + F.size(s["b"]) - both
        return F.when(union == 0, F.lit(0.0)).otherwise(both / union)

    return let(F.struct(a.alias("a"), b.alias("b")), jaccard)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 0 for an empty sketch."""

    def share(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"])).cast("double")
        return F.when(F.size(s["a"]) == 0, F.lit(0.0)).otherwise(both / F.size(s["a"]))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together."""
    return F.sort_array(F.array_union(a, b))


def encoded(sk: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.lower(F.array_join(F.transform(sk, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``sketch`` (array of long) for each document."""
    rows = common.id_text(docs, id_col, text_col)
    return rows.select(F.col("_id").alias("doc_id"), sketch(F.col("_text")).alias("sketch"))


def with_next(docs: DataFrame, extra: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_text``, the ``extra`` columns (made of ``_text``), and ``_next``: text and extras of the next document.

    Ids are cut into ranges of about ``RANGE_ROWS`` documents.  The first rows of a
    range go to the range before it as well (those of the first to the last), so each
    range finds all its next documents by one window of its own; the texts are dealt
    out once.  Bounds and firsts are one number a range.
    """
    spark = docs.sparkSession
    rows = common.id_text(docs, id_col, text_col).withColumn("_order", F.coalesce("_id", F.lit(-(2**63))))
    keys = rows.select("_order")
    ranges = min(MAX_RANGES, max(1, math.ceil(keys.count() / RANGE_ROWS)))
    points = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(keys.agg(F.percentile_approx("_order", points, max(10_000, 10 * ranges))).first()[0] or [])) if points else []
    firsts = dict(_with_range(keys, bounds).groupBy("_range").agg(F.min("_order")).collect())
    present = sorted(firsts)
    before = {firsts[r]: present[k - 1] for k, r in enumerate(present)}  # the first's range before is the last
    rows = _with_range(rows, bounds)
    if before:
        heads = spark.createDataFrame([(k, v, v == present[-1]) for k, v in before.items()], "_head long, _to int, _wrap boolean")
        copied = F.broadcast(heads)  # one row a range
        copies = rows.join(copied, rows["_order"] == copied["_head"]).withColumn("_range", F.col("_to")).drop("_head", "_to")
        rows = rows.withColumn("_copy", F.lit(0)).unionByName(
            copies.withColumn("_copy", F.when(F.col("_wrap"), 2).otherwise(1)).drop("_wrap")
        )
    else:
        rows = rows.withColumn("_copy", F.lit(0))
    rows = rows.repartition("_range").withColumns(extra)  # made where the texts have arrived, so that texts alone are dealt out
    order = W.partitionBy("_range").orderBy((F.col("_copy") == 2), "_order", F.xxhash64("_text"), "_text", "_copy")
    following = F.lead(F.struct("_text", *extra)).over(order)
    return rows.withColumn("_next", following).filter("_copy = 0")


def _with_range(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds ``_range``, how many bounds are at or below ``_order``: a search by halving.

    The bounds are a row of a table, read by a scalar subquery, so the plan doesn't grow with them.
    """
    if not bounds:
        return rows.withColumn("_range", F.lit(0))
    table = rows.sparkSession.createDataFrame([(bounds,)], "b array<long>").scalar()

    def halve(s: Column, _) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(F.col("_bounds"), mid) <= F.col("_order"))
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve)["lo"]
    return rows.withColumn("_bounds", table).withColumn("_range", found).drop("_bounds")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The edited text has the last quarter of its code points replaced by the first as
    many (or all) of the next document's.
    """
    rows = with_next(docs, {"_sketch": sketch(F.col("_text"))}, id_col, text_col)
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(_text, length(_text) - cast(floor(length(_text) / 4) as int))"), F.substring(F.col("_next")["_text"], F.lit(1), cut))
    rows = rows.select(
        F.col("_id").alias("doc_id"), n.cast("long").alias("n_chars"), F.col("_sketch").alias("own"), F.col("_next")["_sketch"].alias("next"), edited.alias("edited"),
        (edited == F.col("_text")).alias("unedited"), (F.col("_next")["_text"] == F.col("_text")).alias("same"),
    )
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("own")).alias("fingerprint"),
        encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.when(F.col("unedited"), 1.0).otherwise(likeness(F.col("own"), F.col("edited_sketch"))).alias("near_edited"),
        F.when(F.col("same"), 1.0).otherwise(likeness(F.col("own"), F.col("next"))).alias("near_next"),
    )
