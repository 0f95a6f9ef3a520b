"""Sessions, casts, versions, catalog, contracts, sinks, sources, models, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from lakeloom import catalog
from lakeloom.functions import casting
from lakeloom.operators import aggregates, audits, contracts, physical
from lakeloom.plans import ingest, models
from lakeloom.session import EventLog, Mode, Performance, Settings, Store, create_session
from lakeloom.sources import files, sinks, synthetic
from lakeloom.sources.versions import VersionedTable
from lakeloom.streaming import micro


# -- session


def test_layers(tmp_path):
    defaults = tmp_path / "defaults.conf"
    defaults.write_text("# comment\nspark.sql.shuffle.partitions 7\nspark.x=1\nspark.x 2\nspark.sql.adaptive.enabled false\n")
    conf = Settings(Store("http://s", "a", "b"), performance=Performance(), event_log=EventLog("file:/e"), defaults=str(defaults)).resolved({"spark.eventLog.dir": "file:/f"})
    assert conf["spark.x"] == "2" and conf["spark.sql.shuffle.partitions"] == "7" and conf["spark.sql.adaptive.enabled"] == "true"
    assert conf["spark.eventLog.dir"] == "file:/f" and conf["spark.hadoop.fs.s3a.endpoint"] == "http://s"
    assert "spark.hadoop.fs.s3a.endpoint" not in Settings().resolved()


def test_modes(spark):
    with pytest.raises(ValueError):
        create_session("x", "nothing")
    assert Mode("classic") is Mode.CLASSIC
    assert create_session("x", "local").range(3).count() == 3


# -- casts


def test_safe_cast_under_both_modes(spark):
    df = spark.createDataFrame([("12.5", "x", "2024-01-02 03:04:05"), ("+1", "y", "soon"), (None, "z", None), (" 7 ", "w", "2024")], "n string, other string, at string")
    for ansi in ("true", "false"):
        with physical.settings(spark, spark__sql__ansi__enabled=ansi):
            out = casting.safe_cast_columns(casting.safe_cast_columns(df, ["n"], "int"), ["at"], "timestamp")
            assert out.columns == df.columns
            assert [(r.n, r.at is not None) for r in out.collect()] == [(12, True), (None, False), (None, False), (7, True)]


# -- versions


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k int, v string")


def test_branches_and_fast_forward(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists()
    first = t.overwrite(rows(spark, [(1, "a")]))
    t.create_branch("dev")
    t.append(rows(spark, [(2, "b")]), "dev")
    assert t.read().count() == 1 and t.read("dev").count() == 2 and t.read(snapshot=first).count() == 1
    t.append(rows(spark, [(3, "c")]))
    with pytest.raises(ValueError):
        t.fast_forward("main", "dev")
    assert t.history().count() == 3
    t.create_branch("ahead")
    t.append(rows(spark, [(4, "d")]), "ahead")
    t.fast_forward("main", "ahead")
    assert sorted(r.k for r in t.read().collect()) == [1, 3, 4]
    assert {r.name for r in t.refs().collect()} == {"main", "dev", "ahead"}


def test_merge_and_partitions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.merge(rows(spark, [(1, "a"), (None, "n")]), ["k"])
    t.merge(rows(spark, [(1, "b"), (2, "c"), (None, "m")]), ["k"])
    assert {(r.k, r.v) for r in t.read().collect()} == {(1, "b"), (2, "c"), (None, "m")}
    with pytest.raises(ValueError):
        t.merge(rows(spark, [(5, "x"), (5, "y")]), ["k"])
    t.overwrite_partitions(rows(spark, [(2, "z"), (2, "y")]), ["k"])
    assert sorted(r.v for r in t.read().collect()) == ["b", "m", "y", "z"]


def test_publish_only_what_passes(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    checks = {"v": audits.not_null("v")}
    assert t.publish(rows(spark, [(1, "a")]), checks) == {"v": 0} and t.read().count() == 1
    assert t.publish(rows(spark, [(2, None)]), checks, "bad") == {"v": 1} and t.read().count() == 1


# -- catalog


def test_script_splitting():
    script = "SELECT 'a;b' AS x; -- a comment; with a stop\nSELECT \"--no\" /* gone; */ AS y;\n;SELECT `c;d` FROM t /*+ BROADCAST(t) */"
    assert catalog.statements(script) == ["SELECT 'a;b' AS x", 'SELECT "--no"   AS y', "SELECT `c;d` FROM t /*+ BROADCAST(t) */"]
    assert catalog.renamed("a.b a.b_c x.a.b `a.b` a.b;", "a.b", "z.y") == "z.y a.b_c x.a.b `a.b` z.y;"
    assert catalog.table_names("CREATE TABLE IF NOT EXISTS a.b (x INT); create or replace table c.d (y INT)") == ["a.b", "c.d"]


def test_execution_and_inspection(spark, tmp_path):
    out = catalog.execute(spark, f"CREATE DATABASE IF NOT EXISTS insp LOCATION '{tmp_path}/i'; SELECT nothing FROM nowhere; CREATE TABLE IF NOT EXISTS insp.t (a INT) USING parquet")
    assert [x["ok"] for x in out] == [True, False, True]
    found = {(r.database, r.table): (r.n_columns, r.n_rows) for r in catalog.inspected(spark).collect()}
    assert found["insp", "t"] == (1, 0)
    with pytest.raises(ValueError):
        catalog.require_table(spark, "insp.other")
    assert catalog.create_all(spark, {"x": "SELECT 1", "y": "SELECT z"}) == {"x": True, "y": False}
    spark.sql("DROP DATABASE insp CASCADE")


# -- contracts


def test_contracts_folder(spark, tmp_path):
    item = {"type": "object", "properties": {"name": {"type": "string", "pattern": "^[a-z_]+$"}, "keywords": {"type": "array", "minItems": 1}}, "required": ["name"]}
    (tmp_path / "kinds.json").write_text(json.dumps({"version": "v7", "type": "array", "items": item}))
    (tmp_path / "meta.json").write_text(json.dumps(contracts.DOCUMENT_METADATA))
    (tmp_path / "kinds_data.json").write_text(json.dumps([{"name": "ok", "keywords": ["a"]}, {"name": "NO", "keywords": []}]))
    c = contracts.Contracts(str(tmp_path))
    assert c.names() == ["kinds", "meta"] and len(c.required("meta")) == 8
    assert {(r.name, r.version, r.n_properties) for r in c.info(spark).collect()} == {("kinds", "v7", 0), ("meta", "v1", 8)}
    assert len(c.struct_type("kinds")) == 0
    assert {r.name: r.errors for r in c.data(spark, "kinds").collect()} == {"ok": [], "NO": ["name has another form", "keywords has too few items"]}


def test_document_metadata_contract(spark):
    made = synthetic.documents(spark, 30).withColumn("file_path", F.lit("p"))
    names = list(contracts.DOCUMENT_METADATA["properties"])
    assert contracts.validated(made.select(*names), contracts.DOCUMENT_METADATA).filter("not is_valid").count() == 0
    broken = made.select(*names).withColumns({"language": F.lit("xx"), "file_size": F.lit(-1), "more": F.lit(1)}).drop("method").limit(1)
    assert contracts.validated(broken, contracts.DOCUMENT_METADATA).first().errors == ["language is not allowed", "file_size is too small", "method is required", "more is not expected"]


# -- sources and sinks


def test_skewed_source(spark):
    df = synthetic.skewed(spark, 20_000)
    top = df.groupBy("key").count().orderBy(F.desc("count")).first()
    assert top.key == 1 and 1200 < top["count"] < 2000
    assert df.exceptAll(synthetic.skewed(spark, 20_000)).count() == 0
    skew = aggregates.key_skew(df, "key").first()
    assert skew.unique_keys == 1000 and skew.max_frequency == top["count"]


def test_documents_are_rendered(spark):
    out = synthetic.documents(spark, 50, "contract").collect()
    assert len(out) == 50 and all("{{" not in r.content and r.file_size == len(r.content.encode()) and r.document_type == "contract" for r in out)


def test_document_files_round_trip(spark, tmp_path):
    made = synthetic.documents(spark, 20).withColumn("day", F.lit("20240101"))
    sinks.save_documents(made, str(tmp_path / "d"), contracts.valid_document(F.col("content"), F.col("document_type")), ["day", "document_type"])
    texts = spark.read.option("lineSep", "\0").text(str(tmp_path / "d/content"))
    assert {r.value for r in texts.collect()} == {r.content for r in made.collect()}
    assert spark.read.json(str(tmp_path / "d/metadata")).count() == 20


def test_path_rules_and_listing(spark, tmp_path):
    folder = tmp_path / "docs/20240203/contract/content"
    folder.mkdir(parents=True)
    (folder / "abc.txt").write_text("line one\nline two")
    (folder / "no.json").write_text("{}")
    listed = files.list_files(spark, str(tmp_path), "*.txt")
    assert listed.columns == ["path", "length", "modificationTime"] and listed.count() == 1
    row = files.read_files(spark, [r.path for r in listed.collect()], "wholetext", files.DOCUMENT_RULES).first()
    assert (row.value, row.document_type, row.document_id, row.year, row.month, row.day) == ("line one\nline two", "contract", "abc", "2024", "02", "03")
    assert files.distinct_files(spark, str(folder)).count() == 2
    assert files.is_remote("s3a://b/k") and not files.is_remote("/x") and files.bucket_and_key("s3a://b/k/l") == ("b", "k/l")


def test_ingest_pipelines(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS pipe LOCATION '{tmp_path}/db'")
    assert all(x["ok"] for x in catalog.execute(spark, catalog.filled(catalog.DDL, db="pipe")))
    folder = tmp_path / "docs/20240203/contract/content"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"d{i}.txt").write_text(f"text {i}\nmore")
        (folder / f"d{i}.json").write_text(json.dumps({"language": "fr", "file_size": 5 + i, "generated_at": "2024-01-02T03:04:05Z"}, indent=1))
    out = ingest.run(spark, ingest.document_contents("pipe"), str(folder / "*.txt"), "j")
    assert (out["files"], out["processed"], out["status"], out["completeness"]) == (3, 3, "success", 1.0)
    ingest.run(spark, ingest.document_metadata("pipe"), str(folder / "*.json"), "j")
    docs = spark.table("pipe.docs").join(spark.table("pipe.docs_metadata").select("document_id", "language", "file_size"), "document_id")
    assert {(r.document_id, r.language, r.file_size, r.raw_text[:6]) for r in docs.collect()} == {(f"d{i}", "fr", 5 + i, f"text {i}") for i in range(3)}
    system = spark.createDataFrame([("1.5", "c", "2024-01-01", "9", "n", "2", "2020-01-01 00:00:00", "3")], "area string, comments string, ended_on string, power string, public_name string, site_id string, started_on string, system_id string")
    system.write.parquet(str(tmp_path / "sys"))
    spec = ingest.pv_system("pipe")
    ingest.run(spark, ingest.IngestSpec(spec.target, casts={**spec.casts, "int": ["site_id", "system_id"]}), str(tmp_path / "sys"), "j")
    row = spark.table("pipe.pv_system").first()
    assert (row.area, row.power, row.site_id, row.ended_on.year) == (1.5, 9.0, 2, 2024)
    with pytest.raises(ValueError):
        sinks.insert(system, "pipe.pv_system", sinks.Write.MERGE)
    spark.sql("DROP DATABASE pipe CASCADE")


# -- models, physical, streaming


def test_models(spark, tmp_path):
    df = spark.createDataFrame([("d1", "Some text that is long enough to be a chunk.", "2024-01-01 05:00:00"), ("d2", None, "2024-01-01 06:00:00"), ("d3", "Another text that is long enough here.", "2024-01-02 00:00:00")], "document_id string, raw_text string, at string")
    df = df.selectExpr("*", "cast(at as timestamp) as generated_at", "'t' as document_type", "'s' as source", "'en' as language")
    clean = models.cleaned(df)
    assert [(r.content_length, r.word_count, r.data_quality_status) for r in clean.orderBy("document_id").collect()] == [(44, 10, "valid"), (0, 0, "invalid"), (38, 7, "valid")]
    chunks = models.chunked(clean, "2024-01-01", "2024-01-02").collect()
    assert [r.chunk_id for r in chunks] == ["d1_chunk_000"]
    t = VersionedTable(spark, str(tmp_path / "m"))
    bad = models.Model("m", models.cleaned, audits={"text": audits.not_null("raw_text")})
    assert models.run(bad, t, df) == {"text": 1} and "main" not in t.branches()
    assert models.run(models.Model("m", models.cleaned), t, df, branch="again") == {} and t.read().count() == 3


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS buck LOCATION '{tmp_path}/b'")
    for n in ("x", "y"):
        sinks.bucketed(spark.range(1000).withColumn("v", F.lit(n)), f"buck.{n}", 4, ["id"])
    joined = spark.table("buck.x").join(spark.table("buck.y").hint("merge"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 1000
    spark.sql("DROP DATABASE buck CASCADE")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from lakeloom.queries import REGISTRY

    plan = REGISTRY["p7_time_range"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]
    star = REGISTRY["j3_star_join_rollup"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert star.count("BroadcastHashJoin") == 2 and "l_shipdate" not in star


def test_numbering_over_partitions(spark):
    got = aggregates.numbered(spark.range(997).select((F.col("id") * 7 % 997).alias("x")), ["x"]).collect()
    assert {r.x: r.row_number for r in got} == {i: i + 1 for i in range(997)}


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), physical.settings(spark, spark__sql__shuffle__partitions=99, spark__lakeloom__x=1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "99"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.lakeloom.x", None) is None
    assert physical.megabytes("2g") == 2048 and physical.megabytes("512m") == 512
    assert physical.memory_report(spark).count() == 3


def test_sister_session_plans_by_its_own_settings(spark, sf_dir):
    from lakeloom.queries import REGISTRY

    plan = lambda name: REGISTRY[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_orderstatus" in plan("x1_shuffle_partitions") and ", 2)" in plan("x1_shuffle_partitions")
    assert "AdaptiveSparkPlan" not in plan("x4_without_aqe") and "AdaptiveSparkPlan" in plan("x2_repartition")


def test_hints_and_salts_keep_the_rows(spark, sf_dir):
    from lakeloom.queries import REGISTRY

    rows = lambda name: sorted(map(tuple, REGISTRY[name][0](spark, sf_dir).collect()))
    assert rows("j1_inner_join") == rows("j4_merge_join") == rows("j4_shuffle_hash_join") == rows("j9_salted_join")
    assert rows("x1_shuffle_partitions") == rows("x2_repartition") == rows("x3_coalesce") == rows("x4_without_aqe")


def test_streams(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).selectExpr("id", "timestamp_seconds(id * 600) as ts", "id % 2 as k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: micro.new_files(spark, str(tmp_path / "in"), schema, most_files=1)
    for _ in range(2):
        micro.ingest(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    seen = []
    micro.each_batch(stream(), micro.batch_counter("k", "id >= 5", lambda b, x: seen.append((b, x["rows"])), 1), str(tmp_path / "c2")).awaitTermination()
    assert sorted(n for _, n in seen) == [5, 10, 10]
    query = micro.windowed_counts(stream(), "ts", "k").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 30


def test_row_numbers_are_one_to_n_whatever_is_read(spark):
    """Over a million rows, with a column that counting doesn't need: as one plain window numbers them."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lakeloom.operators.aggregates import numbered

    n = 1_200_000
    rows = spark.range(n, numPartitions=7).select(F.when(F.col("id") % 1000 == 0, None).otherwise(F.xxhash64("id") % 1000).alias("a"), F.col("id").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("extra"))
    got = numbered(rows, ["a", "b"])
    assert got.select("row_number", "extra").agg(F.count_distinct("row_number"), F.min("row_number"), F.max("row_number")).first()[:] == (n, 1, n)
    plain = rows.select("b", F.row_number().over(Window.orderBy("a", "b")).alias("want"))
    assert got.select("b", "row_number").join(plain, "b").filter("row_number <> want").count() == 0
    assert numbered(rows.limit(0), ["a", "b"]).count() == 0 and [r.row_number for r in numbered(rows.limit(1), ["b"]).collect()] == [1]


def test_appends_and_merges_write_only_what_changes(spark, tmp_path):
    import os

    t = VersionedTable(spark, str(tmp_path / "v"))
    written = lambda: {f"{d}/{n}" for d, _, names in os.walk(tmp_path / "v/data") for n in names if n.endswith(".parquet")}
    t.append(spark.range(0, 100, 1, 1).selectExpr("id", "'a' as x"))
    first = written()
    for k in range(1, 20):  # past the commit that lists all files again
        t.append(spark.range(k * 100, k * 100 + 100, 1, 1).selectExpr("'b' as x", "cast(id as int) as id"))
    assert len(written()) == 20 and first < written() and t.read().count() == 2000 and len(t.files(t.branches()["main"])) == 20
    before = t.branches()["main"]
    t.merge(spark.createDataFrame([(150, "new"), (5000, "more")], "id long, x string"), ["id"])
    kept, now = set(t.files(before)), set(t.files(t.branches()["main"]))
    assert len(kept - now) == 1 and t.read().filter("id = 150").first().x == "new" and t.read().count() == 2001 == t.history().orderBy("committed_at").collect()[-1].rows
    assert t.read(snapshot=before).filter("id = 150").first().x == "b"
    t.merge(spark.createDataFrame([(-1, "none touched")], "id long, x string"), ["id"])
    assert now < set(t.files(t.branches()["main"]))
    t.overwrite(spark.range(0).selectExpr("id", "'c' as x"))
    assert t.read().count() == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "w"))
    t.append(spark.range(3).toDF("id"))
    head = t._head("main")
    t._commit(spark.range(5).toDF("id"), "main", head, "append", [])
    with pytest.raises(RuntimeError, match="moved on"):
        t._commit(spark.range(7).toDF("id"), "main", head, "append", [])
    assert t.read().count() == 8
    open(tmp_path / "w/refs/main/9", "w").close()  # an entry that is still being written
    assert t.read().count() == 8
    with pytest.raises(ValueError, match="exists"):
        t.create_branch("main", "main", if_not_exists=False)


def test_batches_are_all_counted(spark):
    logged = []
    work = micro.batch_counter("k", F.col("v") > 0, lambda batch, figures: logged.append((batch, figures["rows"], figures["batches_since"], figures["rows_since"])), every=3)
    for batch in range(7):
        work(spark.createDataFrame([(1, 1), (2, 1), (2, 0)], "k int, v int"), batch)
    assert logged == [(0, 2, 1, 2), (3, 2, 3, 6), (6, 2, 3, 6)]


def test_job_groups_end_with_an_exception(spark):
    with pytest.raises(AttributeError), physical.job_group(spark, "g", "d"):
        raise AttributeError("inside")
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    from lakeloom.operators import joblogs

    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(1, 3000)))
    with physical.settings(spark, spark__sql__files__maxPartitionBytes=4000, spark__sql__files__openCostInBytes=100):
        rows = joblogs.log_lines(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * sum(bool(i % 5) for i in range(1, 3000)) and all(r.value == f"line {r.line}" for r in rows)


def test_row_functions_are_refused(spark):
    """Lambda predicates, RDDs and their relatives raise, with a message that says what to use."""
    from lakeloom.operators import guards

    df = spark.range(5)
    assert guards.where(df, "id > 1", F.col("id") < 4).count() == 2
    with pytest.raises(TypeError, match="column or SQL"):
        guards.where(df, lambda r: r.id > 1)
    with pytest.raises(Exception, match="NOT_COLUMN_OR_STR|condition"):
        df.filter(lambda r: r.id > 1)
    declared = guards.Declared(df).filter("id > 0").select((F.col("id") * 2).alias("x"))
    assert declared.agg(F.sum("x")).first()[0] == 20 and declared.columns == ["x"]
    for name in guards.REFUSED:
        with pytest.raises(NotImplementedError, match=name):
            getattr(declared, name)
    with pytest.raises(TypeError, match="column or SQL"):
        declared.filter(lambda r: True)


def test_registered_functions(spark):
    from lakeloom.functions import registered

    assert set(registered.register(spark)) == {"text_tokens", "estimated_tokens", "token_windows", "middle", "char_chunks"}
    row = spark.sql("SELECT token_windows('a b c d e', 3, 1) AS w, token_windows(NULL, 3, 1) AS n, token_windows('x', 0, 0) AS z, estimated_tokens('123456789') AS e, text_tokens('Ab_1, é!') AS t").first()
    assert (row.w, row.n, row.z, row.e, row.t) == (["a b c", "c d e"], [], ["x"], 2, ["ab_1", "é"])
    assert [tuple(r) for r in spark.sql("SELECT * FROM char_chunks('abcdefg', 4, 1)").collect()] == [(0, "abcd"), (1, "defg")]
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT token_windows('a b c d', 2, 2)").collect()


def test_job_log_command_line(spark, tmp_path, capsys):
    from lakeloom.operators import joblogs

    (tmp_path / "a.log").write_text('{"operation": "x", "status": "success", "job_id": "j"}\nplain\n{"operation": "y", "job_id": "j"}\n')
    spark.sql("CREATE DATABASE IF NOT EXISTS cli")
    catalog.execute(spark, catalog.filled(catalog.DDL, db="cli"), stop_on_error=True)
    try:
        assert joblogs.main([str(tmp_path / "a.log"), "--table", "cli.job_logs", "--dry-run"]) == 2 and spark.table("cli.job_logs").count() == 0
        assert joblogs.main([str(tmp_path / "a.log"), "--table", "cli.job_logs"]) == 2 and spark.table("cli.job_logs").count() == 2
        assert "2 rows" in capsys.readouterr().out
    finally:
        spark.sql("DROP DATABASE cli CASCADE")


def test_declared_external_table(spark):
    spark.createDataFrame([(1, "a", 2.0)], "n long, s string, x double").createOrReplaceTempView("outside")
    assert contracts.External("outside", "s STRING, n BIGINT").read(spark).columns == ["s", "n"]
    wrong = contracts.External("outside", "s STRING, n INT, at TIMESTAMP")
    assert wrong.problems(spark.table("outside")) == ["n is bigint, not int", "at is missing"]
    with pytest.raises(ValueError, match="at is missing"):
        wrong.read(spark)


def test_jdbc_in_parts(spark, tmp_path):
    """Against the database that comes with Spark's jars, in a folder of its own."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1, 101).selectExpr("cast(id as int) as id", "concat('n', id) as name")
    rows.write.jdbc(url, "things", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    whole = files.jdbc(spark, url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    parts = files.jdbc(spark, url, "things", "ID", (1, 100, 4), driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert whole.count() == parts.count() == 100 and parts.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, parts.collect())) == [(i, f"n{i}") for i in range(1, 101)]


def test_logging_overhead_on_rows(spark, tmp_path):
    from lakeloom import observe

    got = observe.overhead_of_rows(spark, 1000, 3, str(tmp_path / "x.log"))
    assert set(got) == {"none", "sync", "queued"} and all(v["rows_per_second"] > 0 for v in got.values())


def test_log_settings_and_shipped_code(spark, tmp_path):
    from lakeloom.session import Logging, ship

    conf = Settings(logging=Logging("file:/l.properties")).resolved()
    assert conf["spark.driver.extraJavaOptions"] == conf["spark.executor.extraJavaOptions"] == "-Dlog4j2.configurationFile=file:/l.properties"
    package = tmp_path / "shippedcode"
    (package / "inner").mkdir(parents=True)
    (package / "__init__.py").write_text("")
    (package / "inner" / "__init__.py").write_text("def triple(x):\n    return 3 * x\n")
    assert ship(spark, str(package)).endswith("shippedcode.zip")

    @F.udf("long")
    def use(x):
        from shippedcode.inner import triple

        return triple(x)

    assert [r.y for r in spark.range(3).select(use("id").alias("y")).collect()] == [0, 3, 6]
