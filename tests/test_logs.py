"""Loggers, log lines, job-log rows, event logs."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lakeloom import observe
from lakeloom.operators import eventlogs, joblogs
from lakeloom.operators.physical import job_group


def test_logger(spark, tmp_path):
    path = tmp_path / "j-operations.log"
    with observe.JobLogger("j1", str(path)) as log:
        log.log(observe.Operation.file_read, observe.Status.success, {"n": 3, "at": datetime(2024, 1, 1, tzinfo=UTC), "what": {1: {2}}})
        log.tagged("CUSTOM_METRICS", {"x": 1})
        with pytest.raises(KeyError), log.operation("lookup"):
            raise KeyError("k")
    lines = path.read_text().splitlines()
    assert [json.loads(x)["operation"] for x in lines if x.startswith("{")] == ["job_start", "file_read", "lookup", "job_complete"]
    rows = {r.operation: r for r in log.entries_df(spark).collect()}
    assert rows["lookup"].status == "error" and rows["file_read"].metrics["n"] == "3"
    parsed = joblogs.tagged_lines(joblogs.log_lines(spark, str(path))).collect()
    assert [(r.tag, r.data) for r in parsed] == [("CUSTOM_METRICS", {"x": "1"})]
    assert joblogs.log_files(spark, str(tmp_path)).first().log_class == "operations"
    out = joblogs.load_job_logs(spark, str(path))
    assert out.schema.names == joblogs.job_logs_schema().names and out.count() == 4 and len(out.columns) == 42


def test_queued_logger(tmp_path):
    log = observe.QueuedJobLogger("j2", str(tmp_path / "q.log"))
    for i in range(200):
        log.log("op", observe.Status.success, {"i": i})
    log.log("op", observe.Status.error)
    log.close()
    assert len((tmp_path / "q.log").read_text().splitlines()) + log.dropped == 201
    assert set(observe.overhead(50, str(tmp_path / "o.log"))) == {"none", "sync", "queued"}


def test_vocabulary():
    assert (len(observe.Operation), len(observe.Metric), len(observe.Status)) == (15, 24, 5)


def test_job_log_rows(spark):
    data = [
        {"Event": "CustomOperationCompletion", "Job Group": "g", "Operation": "o", "Execution Time": "1.5", "timestamp": "1700000000", "Result Count": "7"},
        {"Event": "MyBusinessEvent", "job_id": "j", "timestamp": "1700000000000", "execution_time_ms": "20", "successful_inserts": "3", "records_processed": "5", "failed_inserts": "1", "error_code": "E001"},
        {"operation": "x"},
    ]
    rows = joblogs.job_log_rows(spark.createDataFrame([(d,) for d in data], "data map<string,string>")).collect()
    a, b, c = rows
    assert (a.job_id, a.job_type, a.operation_type, a.duration_ms, a.records_processed) == ("g", "data_processing", "complete", 1500, 7)
    assert a.start_time == b.start_time and (a.end_time - a.start_time).total_seconds() == 1.5
    assert (b.job_type, b.records_missing, b.error_codes, b.success_rate) == ("business", 1, {"E001": 1}, 0.6)
    assert (c.job_id, c.job_type, c.end_time, c.status) == ("unknown", "unknown", None, "unknown")


def test_tag_summary(spark):
    lines = spark.createDataFrame([("f", i, f'2024-01-02 03:04:{i:02d} ERROR: {{"n": {i}}}') for i in range(8)] + [("f", 9, "ERROR: no json"), ("f", 10, "plain")], "file string, line int, value string")
    out = joblogs.tag_summary(joblogs.tagged_lines(lines)).orderBy("place").collect()
    assert [(r.tag, r.n, r.line, r.time) for r in out][:2] == [("ERROR", 8, 7, "2024-01-02 03:04:07"), ("ERROR", 8, 6, "2024-01-02 03:04:06")] and len(out) == 5


def event(kind, **fields):
    return {"Event": f"SparkListener{kind}", **fields}


def task(stage, ident, start, end, spilled=0):
    shuffle = {"Shuffle Read Metrics": {"Remote Bytes Read": 6_000_000, "Local Bytes Read": 6_000_000, "Fetch Wait Time": 60, "Remote Blocks Fetched": 6, "Local Blocks Fetched": 6}}
    return event("TaskEnd", **{"Stage ID": stage, "Task Info": {"Task ID": ident, "Launch Time": start, "Finish Time": end}, "Task Metrics": {"Memory Bytes Spilled": spilled, "Disk Bytes Spilled": 0, **shuffle}})


def test_event_log(spark, tmp_path):
    log = [
        event("JobStart", **{"Job ID": 0, "Submission Time": 1000, "Stage IDs": [0], "Properties": {"spark.jobGroup.id": "g"}}),
        event("JobEnd", **{"Job ID": 0, "Completion Time": 13_000, "Job Result": {"Result": "JobSucceeded"}}),
        event("JobStart", **{"Job ID": 1, "Submission Time": 2000, "Stage IDs": [1], "Properties": {}}),
        event("JobEnd", **{"Job ID": 1, "Completion Time": 2500, "Job Result": {"Result": "JobFailed"}}),
        event("StageCompleted", **{"Stage Info": {"Stage ID": 0, "Stage Name": "s", "Number of Tasks": 4, "Submission Time": 1000, "Completion Time": 7000}}),
        *[task(0, i, 0, 100) for i in range(9)],
        task(0, 9, 0, 2000, spilled=5),
    ]
    folder = tmp_path / "eventlog_v2_x"
    folder.mkdir()
    (folder / "events_1_x").write_text("\n".join(map(json.dumps, log)))
    df = eventlogs.events(spark, str(folder))
    assert {r.job_id: (r.duration_ms, r.issue) for r in eventlogs.job_issues(df).collect()} == {0: (12_000, "very slow"), 1: (500, "failed")}
    assert {r.job_group: (r.n_jobs, r.n_slow) for r in eventlogs.groups(df).collect()} == {"g": (1, 1), "none": (1, 0)}
    assert eventlogs.stages(df).first().issues == ["slow stage", "expensive shuffle", "slow fetch", "many blocks"]
    skew = eventlogs.task_skew(eventlogs.tasks(df)).first()
    assert (skew.n_tasks, skew.verdict, skew.spills) == (10, "severe", True)
    rated = spark.range(1).select(eventlogs.rating("skew_ratio", F.lit(11)).alias("a"), eventlogs.rating("partitions", F.lit(5)).alias("b")).first()
    assert (rated.a, rated.b) == ("high", "too few")


def test_job_group(spark):
    with job_group(spark, "named", "what it does"):
        assert spark.range(3).count() == 3
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "named"
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
