"""Heavy hitters and salting of found keys, path rules on the listing, job logs as a stream."""

import json
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import eventlogs, skew
from lakeloom.sources import files


def test_summaries_fall_short_by_a_bounded_number():
    stream = [f"k{i % 7}" if i % 3 else f"r{i}" for i in range(3000)]
    held = pd.Series(dtype="int64")
    for at in range(0, len(stream), 100):
        held = skew.summary(held, pd.Series(stream[at : at + 100]).value_counts(), 20)
    true = Counter(stream)
    assert len(held) <= 20 and all(0 <= true[k] - held.get(k, 0) <= len(stream) / 21 for k in true)


@pytest.fixture(scope="module")
def skewed(spark):
    """A key with a third of all rows, one with a twentieth, nulls, and many others."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 20 == 1, 9).when(F.col("id") % 50 == 2, None).otherwise(F.col("id") + 100)
    return spark.range(20_000, numPartitions=6).select(key.alias("k"), F.col("id").alias("v")).cache()


def test_heavy_hitters_are_all_found_and_counted(spark, skewed):
    want = Counter(r.k for r in skewed.collect())
    found = {r.k: (r.n, r.salts) for r in skew.heavy_hitters(skewed, "k", 0.02).collect()}
    assert set(found) == {k for k, n in want.items() if n >= 400 and k is not None} == {7, 9} and all(found[k][0] == want[k] for k in found)
    assert found[7][1] > found[9][1] >= 2
    assert skew.heavy_hitters(skewed.limit(0), "k", 0.1).count() == 0
    text = skewed.select(F.col("k").cast("string").alias("s"))
    assert {r.s for r in skew.heavy_hitters(text, "s", 0.02).collect()} == {"7", "9"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_join_with_found_salts_is_the_same_join(spark, skewed, how):
    right = spark.createDataFrame([(7, "a"), (7, "b"), (9, "c"), (104, "d"), (None, "n")], "k long, w string")
    rows = lambda df: Counter(map(tuple, df.select("k", "v", "w").collect()))
    assert rows(skew.skew_join(skewed, right, "k", 0.02, how)) == rows(skewed.join(right, "k", how))
    with pytest.raises(ValueError):
        skew.skew_join(skewed, right, "k", 0.02, "right")


def test_hot_groups_are_made_in_parts(spark, skewed):
    got = skew.skew_groups(skewed, "k", [F.collect_set(F.col("v") % 10).alias("s"), F.max("v").alias("m")], [F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"), F.max("m").alias("m")], 0.02)
    want = skewed.groupBy("k").agg(F.array_sort(F.collect_set(F.col("v") % 10)).alias("s"), F.max("v").alias("m"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_path_rules_reach_the_listing(spark, tmp_path):
    root = str(tmp_path / "tree")
    spark.range(100).select("id", (F.col("id") % 10).alias("system_id"), F.lit(2024).alias("year")).repartition(1).write.partitionBy("system_id", "year").parquet(root)
    (broken,) = (tmp_path / "tree/system_id=9/year=2024").glob("part-*.parquet")
    broken.write_bytes(b"no file that is opened")
    (tmp_path / "tree/system_id=9/year=2024" / f".{broken.name}.crc").unlink()
    df = files.read_tree(spark, root, {"system_id": r"system_id=(\d+)", "year": r"year=(\d+)"}, F.col("system_id").isin("3", "4"))
    assert sorted(r.id for r in df.collect()) == sorted(i for i in range(100) if i % 10 in (3, 4)) and {r.year for r in df.collect()} == {"2024"}
    assert files.count_files(spark, f"{root}/*/*") == 10 == files.count_files(spark, root)


def test_jobs_of_a_rolling_log_as_a_stream(spark, tmp_path):
    def start(job, at, group=None):
        return {"Event": "SparkListenerJobStart", "Job ID": job, "Submission Time": at, "Properties": {"spark.jobGroup.id": group} if group else {}}

    def end(job, at, result="JobSucceeded"):
        return {"Event": "SparkListenerJobEnd", "Job ID": job, "Completion Time": at, "Job Result": {"Result": result}}

    path, hour = tmp_path / "eventlog_v2_app", 3_600_000
    path.mkdir()
    parts = [[start(1, 1000, "g"), start(2, 2000)], [end(1, 5000), start(3, 6000)], [end(3, 9000, "JobFailed"), start(4, 10 * hour)], [end(4, 10 * hour + 5), start(5, 20 * hour), end(5, 20 * hour + 7)], [start(6, 30 * hour), end(6, 30 * hour + 1)]]
    for i, events in enumerate(parts):
        (path / f"events_{i + 1}_app").write_text("\n".join(map(json.dumps, events)) + "\n")
        time.sleep(1.1)  # files are taken by age
    stream = eventlogs.job_stream(eventlogs.event_stream(spark, str(path), 1))
    query = stream.writeStream.outputMode("append").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.job_id: (r.job_group, r.duration_ms, r.result) for r in spark.table("jobs").collect()}
    assert got == {1: ("g", 4000, "JobSucceeded"), 2: (None, None, None), 3: (None, 3000, "JobFailed"), 4: (None, 5, "JobSucceeded"), 5: (None, 7, "JobSucceeded"), 6: (None, 1, "JobSucceeded")}
    whole = eventlogs.job_stream(eventlogs.events(spark, str(path)))
    assert {r.job_id: r.duration_ms for r in whole.collect()} == {k: v[1] for k, v in got.items()}
    state = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]
    assert max(state) <= 4  # what the watermark has passed is let go
