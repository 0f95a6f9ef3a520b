"""Connected components by alternating large-star and small-star steps.

Both steps are joins against one minimum a node, so a hub with a third of all
edges is pre-aggregated and its join can be split.  Each round's edges are written
to the shared folder: lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges in one file of a round; steps never make more edges than there were.
FILE_ROWS = 1_000_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node with an edge; label is the least node that it reaches.

    ``edges`` has long columns u and v; direction, repetition and loops don't matter.
    No edges give no rows.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.written(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = common.written(small, "edges", 1 + state[0] // FILE_ROWS)
        seen = _state(now)
        common.dropped(edges.sparkSession, edges)
        edges, before, state = now, state, seen
        if before == state:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
