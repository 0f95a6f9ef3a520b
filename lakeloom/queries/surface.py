"""The rest of the surface that users rely on: scans, catalog, views, UDFs, caching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import rates, registered
from ..operators import aggregates as agg
from ..operators import contracts
from ..sources import files, sinks
from ..sources.versions import VersionedTable
from . import Tables, query
from .storage import database, scratch

c, lit, count = F.col, F.lit, F.count
_CUSTOMER = "SELECT c_custkey, c_name FROM customer"


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def s4_parquet_glob(t: Tables):
    return t.spark.read.parquet(f"{t.sf_dir}/regio?.parquet")


@query(_CUSTOMER)
def s6_csv_without_header(t: Tables):
    path = sinks.save(t.customer.select("c_custkey", "c_name"), scratch(t), "csv")
    return t.spark.read.schema("c_custkey bigint, c_name string").csv(path)


@query("SELECT source, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents WHERE source IS NOT NULL GROUP BY source")
def s8_binary_files(t: Tables):
    """Sizes of files by folder, from the listing alone: each line of text is its bytes and a line break."""
    rows = t.documents.filter("source is not null").select(F.coalesce("text", lit("")).alias("value"), "source")
    path = sinks.save(rows, scratch(t), "text", by=["source"])
    found = files.extracted(files.list_files(t.spark, path, "part-*"), "path", {"source": r"source=([^/]+)/"})
    return found.groupBy("source").agg(F.sum("length").alias("bytes"))


@query("SELECT count(DISTINCT coalesce(source, '')) AS n_folders FROM documents WHERE length(text) > 0")
def s9_files_with_text(t: Tables):
    """Folders with a file that holds a line; empty texts give files without one."""
    rows = t.documents.filter("length(text) > 0").select("text", "source")
    path = sinks.save(rows, scratch(t), "text", by=["source"])
    found = files.distinct_files(t.spark, path).select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("folder"))
    return found.agg(F.count_distinct("folder").alias("n_folders"))


@query(_CUSTOMER)
def s10_table_by_name(t: Tables):
    db = database(t)
    sinks.replace_table(t.customer.select("c_custkey", "c_name"), f"{db}.x")
    return files.table_or_path(t.spark, f"{db}.x")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s11_branch_scan(t: Tables):
    table, rows = VersionedTable(t.spark, scratch(t)), t.orders.select("o_orderkey", "o_orderstatus")
    table.overwrite(rows)
    table.create_branch("staging")
    table.overwrite(rows.filter("o_orderstatus = 'F'"), "staging")
    return table.read("staging")


@query("SELECT meaning, weight, count(*) AS n FROM orders JOIN (VALUES ('F', 'finished', 2::BIGINT), ('O', 'open', 3::BIGINT)) v(o_orderstatus, meaning, weight) USING (o_orderstatus) GROUP BY ALL")
def s13_inline_rows(t: Tables):
    """Rows from the program beside a table."""
    meanings = t.spark.createDataFrame([("F", "finished", 2), ("O", "open", 3)], "o_orderstatus string, meaning string, weight int")
    return t.orders.join(F.broadcast(meanings), "o_orderstatus").groupBy("meaning", "weight").agg(count(lit(1)).alias("n"))


@query(_CUSTOMER)
def s20_path_gateway(t: Tables):
    root = scratch(t)
    sinks.save(t.customer.select("c_custkey", "c_name"), f"{root}/energy/customer")
    return files.table_or_path(t.spark, "energy.customer", "local", root)


@query("SELECT count(*) AS total_records, count(*) AS successful_inserts, 0::BIGINT AS failed_inserts, count(*) AS in_table FROM orders")
def k1_insert_figures(t: Tables):
    db = database(t)
    sinks.replace_table(t.orders.limit(0), f"{db}.x")
    out = sinks.insert(t.orders, f"{db}.x", sinks.Write.APPEND)
    row = [(out["total_records"], out["successful_inserts"], out["failed_inserts"])]
    figures = t.spark.createDataFrame(row, "total_records long, successful_inserts long, failed_inserts long")
    return figures.crossJoin(t.spark.table(f"{db}.x").agg(count(lit(1)).alias("in_table")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 3")
def k5_replaced_table(t: Tables):
    db = database(t)
    sinks.replace_table(t.customer, f"{db}.x", properties={"compression": "zstd"})
    sinks.replace_table(t.customer.filter("c_nationkey < 3").select("c_custkey", "c_name"), f"{db}.x")
    return t.spark.table(f"{db}.x")


@query("SELECT o_orderpriority, count(*) AS n, false AS dropped FROM orders GROUP BY o_orderpriority")
def d1_create_and_drop(t: Tables):
    """Tables of a database are written and read, one is dropped, and then the database."""
    db = database(t)
    sinks.replace_table(t.orders.select("o_orderpriority"), f"{db}.x")
    sinks.replace_table(t.spark.table(f"{db}.x").groupBy("o_orderpriority").agg(count(lit(1)).alias("n")), f"{db}.y")
    rows = t.spark.table(f"{db}.y").collect()  # one a priority
    t.spark.sql(f"DROP TABLE {db}.x")
    left = t.spark.catalog.tableExists(f"{db}.x")
    t.spark.sql(f"DROP DATABASE {db} CASCADE")
    return t.spark.createDataFrame([(*r, left or t.spark.catalog.databaseExists(db)) for r in rows], "o_orderpriority string, n long, dropped boolean")


@query("SELECT 'a' AS \"table\", 6::BIGINT AS n_columns, count(*) AS n_rows FROM orders UNION ALL SELECT 'b', 5, count(*) FROM customer")
def d13_inspected(t: Tables):
    db = database(t)
    sinks.replace_table(t.orders, f"{db}.a")
    sinks.replace_table(t.customer, f"{db}.b")
    return catalog.inspected(t.spark, only=(db,)).drop("database")


@query("SELECT o_orderstatus || ';' AS status, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 1")
def d9_statements(t: Tables):
    """A script with comments, and with semicolons in them and in text, is run statement by statement; the last one's rows."""
    db = database(t)
    script = """-- first; the dear ones
CREATE TABLE ${db}.dear USING parquet AS SELECT concat(o_orderstatus, ';') AS status FROM orders WHERE o_totalprice > 100000; /* then;
they are counted */ CREATE TABLE ${db}.counted USING parquet AS SELECT status, count(*) AS n FROM ${db}.dear GROUP BY status;
DELETE_NOT_A_STATEMENT;
CREATE TABLE ${db}.many USING parquet AS SELECT * FROM ${db}.counted WHERE n > 1 -- done;
"""
    t.view("orders")
    assert [x["ok"] for x in catalog.execute(t.spark, catalog.filled(script, db=db))] == [True, True, False, True]
    return t.spark.table(f"{db}.many")


@query("SELECT doc_id, lang AS language FROM documents WHERE source NOT IN ('src0', 'src1')")
def p3_renamed_not_in(t: Tables):
    return t.documents.filter(~c("source").isin("src0", "src1")).select("doc_id", "lang").withColumnRenamed("lang", "language")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def u6_temp_view(t: Tables):
    return t.view("documents").sql("SELECT lang, count(*) AS n FROM documents GROUP BY lang")


@query("SELECT user_id, CASE WHEN count(*) > 0 THEN count(*) FILTER (event_type = 'click') / count(*) ELSE 0.0 END AS rate FROM events GROUP BY user_id")
def f21_success_rate(t: Tables):
    return t.events.groupBy("user_id").agg(rates.success_rate(F.count_if(c("event_type") == "click"), count(lit(1))).alias("rate"))


@query("SELECT c_mktsegment, count(*) AS n, 'spark_catalog' AS catalog_name, 'default' AS schema_name FROM customer GROUP BY c_mktsegment")
def f19_current(t: Tables):
    """Counts say under which catalog and schema they were made."""
    counts = t.customer.groupBy("c_mktsegment").agg(count(lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(catalog.current(t.spark)))


@query("SELECT 'catalogs' AS what, 1::BIGINT AS n UNION ALL SELECT 'schemas', 2 UNION ALL SELECT 'first', count(*) FROM customer UNION ALL SELECT 'second', count(*) FROM orders")
def d14_namespaces(t: Tables):
    """An unqualified name means the table of the schema in use."""
    dbs = {"first": database(t), "second": database(t)}
    for db, rows in zip(dbs.values(), (t.customer, t.orders), strict=True):
        sinks.replace_table(rows, f"{db}.x")
    found = [("catalogs", catalog.catalogs(t.spark, "spark_catalog").count()), ("schemas", sum(catalog.schemas(t.spark, db).count() for db in dbs.values()))]
    for name, db in dbs.items():
        with catalog.using(t.spark, db):
            found.append((name, t.spark.table("x").count()))
    return t.spark.createDataFrame(found, "what string, n long")


@query("SELECT user_id, median(value) AS middle FROM events GROUP BY user_id")
def g7_user_aggregate(t: Tables):
    registered.register(t.spark)
    return t.view("events").sql("SELECT user_id, middle(value) AS middle FROM events GROUP BY user_id")


@query("""SELECT doc_id, k AS chunk_index, substr(text, k * 150 + 1, 200) AS chunk_text FROM documents, unnest(range(CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(ceil((length(text) - 50) / 150.0) AS BIGINT)) END)) u(k)""")
def g7_table_function(t: Tables):
    registered.register(t.spark)
    return t.view("documents").sql("SELECT doc_id, c.chunk_index, c.chunk_text FROM documents, LATERAL char_chunks(text, 200, 50) c")


@query("SELECT c_nationkey::BIGINT AS c_nationkey, true AS formed, count(*) AS n, true AS new FROM customer GROUP BY c_nationkey")
def f23_job_ids(t: Tables):
    """Each id is new (chance may give two the same eight hex digits); its form is prefix, seconds, eight hex digits."""
    rows = t.customer.select("c_nationkey", rates.job_id("job").alias("job_id"))
    ids = rows.groupBy("c_nationkey").agg(F.bool_and(c("job_id").rlike(r"^job_\d{10}_[0-9a-f]{8}$")).alias("formed"), count(lit(1)).alias("n"), F.count_distinct("job_id").alias("ids"))
    return ids.select("c_nationkey", "formed", "n", (c("ids") >= c("n") - 1).alias("new"))


@query("SELECT count(*) AS n, count(*) AS n_ids, true AS placed FROM orders")
def f18_lineage(t: Tables):
    """Ids of rows are unique, and tell the partition."""
    rows = agg.lineage(t.orders.select("o_orderkey"))
    placed = F.bool_and(F.shiftright("task_execution_id", 33) == F.col("spark_partition_id"))
    return rows.agg(count(lit(1)).alias("n"), F.count_distinct("task_execution_id").alias("n_ids"), placed.alias("placed"))


@query("SELECT c_custkey, (c_nationkey * 2)::BIGINT AS doubled, upper(c_name) AS upper_name FROM customer")
def g1_udfs(t: Tables):
    """Arrow-batched user functions, null-safe; built-ins do the same without leaving the JVM."""

    @F.udf("int", useArrow=True)
    def doubled(x):
        return None if x is None else 2 * x

    @F.pandas_udf("string")
    def upper(x):
        return x.str.upper()

    return t.customer.select("c_custkey", doubled("c_nationkey").alias("doubled"), upper("c_name").alias("upper_name"))


_TWICE = "SELECT {0}::VARCHAR AS key, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice > 1000 GROUP BY {0}"


@query(f"{_TWICE.format('o_orderstatus')} UNION ALL {_TWICE.format('o_orderpriority')}")
def x5_cached(t: Tables):
    """What two aggregates share is read once and kept in memory for as long as a frame refers to it."""
    kept = t.orders.filter("o_totalprice > 1000").select("o_orderstatus", "o_orderpriority", "o_totalprice").cache()
    one = lambda k: kept.groupBy(c(k).alias("key")).agg(count(lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return one("o_orderstatus").unionByName(one("o_orderpriority"))


@query("SELECT doc_id, lang IN ('en', 'es', 'fr', 'de', 'it', 'pt') AS known, n_chars >= 100 AS long_enough FROM documents")
def v6_enum_and_minimum(t: Tables):
    schema = {"properties": {"lang": contracts.DOCUMENT_METADATA["properties"]["language"], "n_chars": {"type": "integer", "minimum": 100}}}
    errors = contracts.errors(schema, t.documents.columns)
    return t.documents.select("doc_id", (~F.array_contains(errors, "lang is not allowed")).alias("known"), (~F.array_contains(errors, "n_chars is too small")).alias("long_enough"))


def _as_of(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The last order on or before each line, by one union and one window: no range join."""
    from pyspark.sql import Window as W

    lines = lines.select(c("l_suppkey").alias("k"), c("l_shipdate").alias("at"), "l_orderkey", "l_linenumber")
    orders = orders.select(c("o_custkey").alias("k"), c("o_orderdate").alias("at"), c("o_orderdate").alias("found"))
    both = lines.withColumn("found", lit(None).cast("timestamp_ntz")).unionByName(orders, allowMissingColumns=True)
    before = W.partitionBy("k").orderBy("at", c("found").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("last", F.last("found", ignorenulls=True).over(before)).filter(c("l_orderkey").isNotNull() & c("last").isNotNull())
    return found.select("l_orderkey", "l_linenumber", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_before"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, o_orderdate::VARCHAR AS last_before FROM lineitem ASOF JOIN (SELECT o_custkey, o_orderdate FROM orders) o ON l_suppkey = o_custkey AND l_shipdate >= o_orderdate")
def j_as_of(t: Tables):
    return _as_of(t.lineitem, t.orders)
