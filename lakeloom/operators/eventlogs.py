"""Spark event logs as DataFrames: jobs, stages, tasks, rules about them.  Takes a file or a rolling folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = (
    "Event string, `Job ID` int, `Submission Time` bigint, `Completion Time` bigint, `Job Result` struct<Result:string>, `Stage IDs` array<int>,"
    " Properties map<string,string>, `Stage ID` int,"
    " `Stage Info` struct<`Stage ID`:int,`Stage Name`:string,`Number of Tasks`:int,`Submission Time`:bigint,`Completion Time`:bigint,`Failure Reason`:string>,"
    " `Task Info` struct<`Task ID`:bigint,`Launch Time`:bigint,`Finish Time`:bigint,Failed:boolean>,"
    " `Task Metrics` struct<`Executor Run Time`:bigint,`Memory Bytes Spilled`:bigint,`Disk Bytes Spilled`:bigint,"
    "`Shuffle Read Metrics`:struct<`Remote Bytes Read`:bigint,`Local Bytes Read`:bigint,`Fetch Wait Time`:bigint,`Total Records Read`:bigint,`Remote Blocks Fetched`:bigint,`Local Blocks Fetched`:bigint>,"
    "`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint,`Shuffle Write Time`:bigint,`Shuffle Records Written`:bigint>>"
)


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").schema(EVENT).json(path)


def event_stream(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """The events of a rolling log as they come: each file that is new to the checkpoint is read once."""
    return spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).schema(EVENT).json(path)


def job_stream(df: DataFrame, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """job_id, job_group, start, end, duration_ms, result of a stream of events, each job once.

    Starts wait for their ends: an end counts within ``longest`` of its start.  A job whose
    end hasn't come when the watermark has passed that comes out without one, and its state
    is let go, so state is bounded by ``longest`` and ``late`` and not by the log.
    """
    start = _of(df, "JobStart").select(
        F.col("Job ID").alias("job_id"), F.try_element_at("Properties", F.lit("spark.jobGroup.id")).alias("job_group"), F.col("Submission Time").alias("start"), F.timestamp_millis("Submission Time").alias("started")
    )
    end = _of(df, "JobEnd").select(F.col("Job ID").alias("ended_id"), F.col("Completion Time").alias("end"), F.col("Job Result.Result").alias("result"), F.timestamp_millis("Completion Time").alias("ended"))
    if df.isStreaming:
        start, end = start.withWatermark("started", late), end.withWatermark("ended", late)
    on = (F.col("job_id") == F.col("ended_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {longest}"))
    return start.join(end, on, "left_outer").select("job_id", "job_group", "start", "end", (F.col("end") - F.col("start")).alias("duration_ms"), "result")


def _of(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("Event") == f"SparkListener{kind}")


def jobs(df: DataFrame) -> DataFrame:
    """job_id, job_group, start, end, duration_ms, result."""
    start = _of(df, "JobStart").select(F.col("Job ID").alias("job_id"), F.try_element_at("Properties", F.lit("spark.jobGroup.id")).alias("job_group"), F.col("Submission Time").alias("start"))
    end = _of(df, "JobEnd").select(F.col("Job ID").alias("job_id"), F.col("Completion Time").alias("end"), F.col("Job Result.Result").alias("result"))
    return start.join(end, "job_id", "left").withColumn("duration_ms", F.col("end") - F.col("start"))


def job_issues(df: DataFrame, very_slow: int = 10_000, slow: int = 5_000) -> DataFrame:
    ms = F.col("duration_ms")
    issue = F.when(F.col("result") != "JobSucceeded", "failed").when(ms > very_slow, "very slow").when(ms > slow, "optimize")
    return jobs(df).withColumn("issue", issue)


def groups(df: DataFrame, slow: int = 5_000) -> DataFrame:
    """Jobs of each group: how many, how long, which, how many slow ones."""
    return jobs(df).groupBy(F.coalesce("job_group", F.lit("none")).alias("job_group")).agg(
        F.count(F.lit(1)).alias("n_jobs"), F.sum("duration_ms").alias("total_ms"), F.sort_array(F.collect_list("job_id")).alias("job_ids"), F.count_if(F.col("duration_ms") > slow).alias("n_slow")
    )


def tasks(df: DataFrame) -> DataFrame:
    m = F.col("Task Metrics")
    read, write = m["Shuffle Read Metrics"], m["Shuffle Write Metrics"]
    return _of(df, "TaskEnd").select(
        F.col("Stage ID").alias("stage_id"),
        F.col("Task Info.Task ID").alias("task_id"),
        (F.col("Task Info.Finish Time") - F.col("Task Info.Launch Time")).alias("duration_ms"),
        (read["Remote Bytes Read"] + read["Local Bytes Read"]).alias("shuffle_read_bytes"),
        read["Fetch Wait Time"].alias("fetch_wait_ms"),
        (read["Remote Blocks Fetched"] + read["Local Blocks Fetched"]).alias("blocks"),
        write["Shuffle Bytes Written"].alias("shuffle_write_bytes"),
        write["Shuffle Write Time"].alias("shuffle_write_ns"),
        m["Memory Bytes Spilled"].alias("memory_spilled"),
        m["Disk Bytes Spilled"].alias("disk_spilled"),
    )


def task_skew(task: DataFrame) -> DataFrame:
    """By stage: tasks, longest, mean, ratio, verdict, and whether anything spilled."""
    out = task.groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.max("duration_ms").alias("max_ms"), F.avg("duration_ms").alias("avg_ms"), F.coalesce(F.sum(F.col("memory_spilled") + F.col("disk_spilled")), F.lit(0)).alias("spilled")
    )
    ratio = F.when(F.col("avg_ms") > 0, F.col("max_ms") / F.col("avg_ms")).otherwise(F.lit(1.0))
    return out.withColumn("skew", ratio).withColumn("verdict", skew_verdict(F.col("skew"))).withColumn("spills", F.col("spilled") > 0)


def skew_verdict(ratio: Column) -> Column:
    return F.when(ratio > 3, "severe").when(ratio > 2, "moderate").otherwise("even")


def stages(df: DataFrame) -> DataFrame:
    """Each stage's duration and the sums of its tasks, with the issues that rules find."""
    info = _of(df, "StageCompleted").select(F.col("Stage Info.Stage ID").alias("stage_id"), F.col("Stage Info.Stage Name").alias("name"), (F.col("Stage Info.Completion Time") - F.col("Stage Info.Submission Time")).alias("duration_ms"))
    sums = tasks(df).groupBy("stage_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("shuffle_read_bytes", "shuffle_write_bytes", "fetch_wait_ms", "blocks", "memory_spilled")])
    return info.join(sums, "stage_id", "left").withColumn("issues", stage_issues())


def stage_issues() -> Column:
    """array<string> from fixed limits: time, bytes, waits, blocks."""
    ms, mb = F.col("duration_ms"), F.greatest("shuffle_read_bytes", "shuffle_write_bytes") / 1e6
    wait = F.col("fetch_wait_ms")
    found = [
        F.when(ms > 5000, "slow stage").when(ms > 2000, "moderate stage"),
        F.when(mb > 10, "expensive shuffle").when(mb > 1, "high shuffle"),
        F.when(wait > 100, "slow fetch").when(wait > 10, "moderate fetch"),
        F.when(F.col("blocks") > 10, "many blocks"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


#: Limits of custom metrics (fixed values): name, over this high, over this moderate.
RATINGS = {"skew_ratio": (10, 5), "execution_seconds": (10, 5), "memory_fraction": (0.5, 0.3), "estimated_mb": (1000, 500)}


def rating(metric: str, value: Column) -> Column:
    """high, moderate or fine; partitions: over 1000 too many, under 10 too few."""
    if metric == "partitions":
        return F.when(value > 1000, "too many").when(value < 10, "too few").otherwise("fine")
    high, moderate = RATINGS[metric]
    return F.when(value > high, "high").when(value > moderate, "moderate").otherwise("fine")
