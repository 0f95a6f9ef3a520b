"""Projections, filters, scalar functions, casts, job figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rates, text
from ..functions.casting import safe_cast
from ..operators import joblogs
from ..plans.ingest import job_metrics
from ..sources import files, synthetic
from . import Tables, query

c, lit = F.col, F.lit


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS document_type, text AS raw_text, CAST(length(text) AS BIGINT) AS text_length FROM documents WHERE doc_id IS NOT NULL")
def p1_target_shape(t: Tables):
    cols = [c("doc_id").cast("string").alias("document_id"), c("source").alias("document_type"), c("text").alias("raw_text"), F.length("text").cast("long").alias("text_length")]
    return t.documents.filter(c("doc_id").isNotNull()).select(*cols)


@query("SELECT doc_id AS id, lang, 'job' AS job_id FROM documents")
def p2_literals_and_names(t: Tables):
    return t.documents.select("doc_id", "lang").withColumnRenamed("doc_id", "id").withColumn("job_id", lit("job"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def p4_struct_star(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint").alias("s")).select("event_id", "s.*")


@query("SELECT count(*) AS n FROM documents WHERE text IS NOT NULL")
def p5_not_null(t: Tables):
    return t.documents.filter(c("text").isNotNull()).agg(F.count(lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 300000")
def p6_comparisons(t: Tables):
    return t.orders.filter((c("o_orderstatus") == "F") & (c("o_totalprice") >= 300000)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01' AND o_orderstatus = 'O'")
def p7_time_range(t: Tables):
    d = c("o_orderdate")
    inside = (d >= lit("1997-01-01").cast("timestamp_ntz")) & (d < lit("1997-02-01").cast("timestamp_ntz"))
    return t.orders.filter(inside & (c("o_orderstatus") == "O")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_tax > 0.07 OR l_discount > 0.09 OR l_quantity > 49")
def p8_or_chain(t: Tables):
    return t.lineitem.filter(text.any_of(c("l_tax") > 0.07, c("l_discount") > 0.09, c("l_quantity") > 49)).select("l_orderkey", "l_linenumber")


@query("SELECT page_id FROM pages WHERE url LIKE '%ref=x' AND contains(url, '/fr/')")
def p10_suffix_filter(t: Tables):
    return t.pages.filter(files.suffix(c("url"), "ref=x") & c("url").contains("/fr/")).select("page_id")


@query("SELECT nullif(regexp_extract(url, '\\.([^./]+)$', 1), '') AS extension, count(*) AS n FROM pages GROUP BY 1")
def p11_extension_histogram(t: Tables):
    return files.extension_histogram(t.pages, "url")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/(\\d+)\\?', 1) AS number, regexp_extract(url, 'nothing=(\\d+)', 1) AS missing FROM pages")
def s3_path_rules(t: Tables):
    rules = {"host": r"^https?://([^/]+)/", "number": r"/(\d+)\?", "missing": r"nothing=(\d+)"}
    return files.extracted(t.pages, "url", rules, empty_as_null=False).select("page_id", *rules)


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS kind FROM documents")
def p12_case_when(t: Tables):
    n = c("n_chars")
    return t.documents.select("doc_id", F.when(n < 500, "short").when(n < 2000, "medium").otherwise("long").alias("kind"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS words, length(trim(text)) AS trimmed, octet_length(encode(text)) AS bytes FROM documents")
def f3_lengths(t: Tables):
    x = c("text")
    return t.documents.select("doc_id", text.naive_words(x).alias("words"), F.length(F.trim(x)).alias("trimmed"), text.utf8_bytes(x).alias("bytes"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem WHERE floor(l_extendedprice) <> l_extendedprice")
def f7_integrality(t: Tables):
    p = c("l_extendedprice")
    return t.lineitem.filter(F.floor(p) != p).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_id, 'category_' || (user_id % 10)::VARCHAR AS category FROM events")
def f8_bucket_label(t: Tables):
    return t.events.select("event_id", F.concat(lit("category_"), F.pmod("user_id", lit(10)).cast("string")).alias("category"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age FROM orders")
def f9_dates(t: Tables):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", d.cast("string").alias("day"), F.date_diff(lit("2000-01-01").cast("date"), d).alias("age"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none'), 'default') AS none FROM events")
def f12_json_defaults(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), lit("default")).alias("none"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, to_json({'name': n_name, 'region': n_regionkey})::VARCHAR AS j FROM nation")
def f14_to_json(t: Tables):
    return t.nation.select("n_nationkey", F.to_json(F.struct(c("n_name").alias("name"), c("n_regionkey").alias("region"))).alias("j"))


@query("SELECT doc_id, unnest(string_split(source || '-' || lang, '-')) AS part FROM documents")
def f15_explode(t: Tables):
    return t.documents.select("doc_id", F.explode(F.split(F.concat_ws("-", "source", "lang"), "-")).alias("part"))


_VALUES = """CASE event_id % 12 WHEN 0 THEN concat(user_id, '') WHEN 1 THEN concat(user_id, '.') WHEN 2 THEN concat(user_id, '.5') WHEN 3 THEN concat('-', user_id) WHEN 4 THEN concat(' ', user_id, ' ')
WHEN 5 THEN concat('+', user_id) WHEN 6 THEN concat(user_id, 'e5') WHEN 7 THEN concat('.', user_id) WHEN 8 THEN '' WHEN 9 THEN concat(user_id, '99999999999') WHEN 10 THEN concat('-0.', user_id) WHEN 11 THEN event_type END"""


@query(f"""SELECT event_id, v, CASE WHEN regexp_matches(trim(v), '^-?\\d+\\.?\\d*$') THEN try_cast(trim(v) AS DOUBLE) END AS d,
CASE WHEN regexp_matches(trim(v), '^-?\\d+\\.?\\d*$') THEN try_cast(regexp_extract(trim(v), '^-?\\d+') AS INTEGER)::BIGINT END AS i FROM (SELECT event_id, {_VALUES} AS v FROM events)""")
def i1_safe_cast(t: Tables):
    rows = t.events.select("event_id", F.expr(_VALUES).alias("v"))
    return rows.select("event_id", "v", safe_cast(c("v"), "double").alias("d"), safe_cast(c("v"), "int").alias("i"))


@query("""SELECT o_orderkey, v, strftime(try_cast(v AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'not a time' WHEN 3 THEN strftime(o_orderdate, '%Y-13-%d 00:00:00') END AS v FROM orders)""")
def i1_safe_cast_time(t: Tables):
    at, n = c("o_orderdate"), c("o_orderkey") % 5
    v = F.when(n == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(n == 1, F.date_format(at, "yyyy-MM-dd")).when(n == 2, "not a time").when(n == 3, F.date_format(at, "yyyy-'13'-dd 00:00:00"))
    rows = t.orders.select("o_orderkey", v.alias("v"))
    return rows.select("o_orderkey", "v", F.date_format(safe_cast(c("v"), "timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


_JOBS = "SELECT user_id, count(*) AS files, count(*) FILTER (event_type <> 'view') AS processed, count(*) FILTER (event_type IN ('click', 'purchase')) AS inserted, count(*) FILTER (event_type = 'error') AS failed, 100 AS ms FROM events GROUP BY user_id"


@query(f"""SELECT user_id, files, processed, inserted, failed, ms::BIGINT AS ms,
CASE WHEN inserted > 0 AND failed = 0 THEN 'success' WHEN inserted > 0 AND failed > 0 THEN 'partial_success' WHEN failed > 0 THEN 'failure' ELSE 'error' END AS status,
greatest(files - processed, 0) AS records_missing, CASE WHEN files > 0 THEN ms / files ELSE 0.0 END AS avg_ms_per_file,
CASE WHEN files > 0 THEN round(processed / files, 4) ELSE 1.0 END AS completeness, CASE WHEN processed > 0 THEN inserted / processed ELSE 0.0 END AS success_rate,
processed * 1000 / ms AS throughput FROM ({_JOBS})""")
def i6_job_metrics(t: Tables):
    e = c("event_type")
    rows = t.events.groupBy("user_id").agg(
        F.count(lit(1)).alias("files"), F.count_if(e != "view").alias("processed"), F.count_if(e.isin("click", "purchase")).alias("inserted"), F.count_if(e == "error").alias("failed"), lit(100).cast("long").alias("ms")
    )
    return job_metrics(rows)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'File or directory not found' WHEN 'error' THEN 'Unknown error occurred' WHEN 'view' THEN 'Table does not exist'
ELSE 'No description available' END AS description FROM events""")
def f22_error_text(t: Tables):
    code = F.when(c("event_type") == "click", "E001").when(c("event_type") == "error", "E999").when(c("event_type") == "view", "E021").otherwise("E777")
    return t.events.select("event_id", rates.error_text(code).alias("description"))


@query("""SELECT doc_id, CASE WHEN n_chars * 7 < 1000 THEN format('{:.0f}ms', (n_chars * 7)::DOUBLE) WHEN n_chars * 7 < 60000 THEN format('{:.1f}s', n_chars * 7 / 1000) ELSE format('{:.1f}min', n_chars * 7 / 60000) END AS took,
CASE WHEN n_chars * n_chars < 1024 THEN (n_chars * n_chars) || 'B' WHEN n_chars * n_chars < 1048576 THEN format('{:.1f}KB', n_chars * n_chars / 1024) WHEN n_chars * n_chars < 1073741824 THEN format('{:.1f}MB', n_chars * n_chars / 1048576)
ELSE format('{:.1f}GB', n_chars * n_chars / 1073741824) END AS size FROM documents""")
def f24_humanized(t: Tables):
    n = c("n_chars")
    return t.documents.select("doc_id", text.human_duration(n * 7).alias("took"), text.human_bytes(n * n).alias("size"))


@query("""SELECT event_id, v, coalesce(nullif(regexp_extract(v, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})', 1), ''), nullif(regexp_extract(v, '(\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}:\\d{2})', 1), ''),
nullif(regexp_extract(v, '(\\d{2}:\\d{2}:\\d{2})', 1), ''), 'unknown') AS at FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || event_type
WHEN 1 THEN 'at ' || strftime(ts, '%d/%m/%Y %H:%M:%S') WHEN 2 THEN 'only ' || strftime(ts, '%H:%M:%S') || props WHEN 3 THEN event_type ELSE '' END AS v FROM events)""")
def f25_log_time(t: Tables):
    n, at = c("event_id") % 5, lambda form: F.date_format("ts", form)
    v = F.when(n == 0, F.concat(at("yyyy-MM-dd HH:mm:ss"), lit(" INFO "), "event_type")).when(n == 1, F.concat(lit("at "), at("dd/MM/yyyy HH:mm:ss"))).when(n == 2, F.concat(lit("only "), at("HH:mm:ss"), "props")).when(n == 3, c("event_type")).otherwise("")
    return t.events.select("event_id", v.alias("v")).select("event_id", "v", text.log_time(c("v")).alias("at"))


@query("SELECT c_custkey, 'Customer ' || c_name || ' of ' || c_nationkey || ' {{other}}' AS body FROM customer")
def s16_rendered(t: Tables):
    values = F.create_map(lit("name"), c("c_name"), lit("nation"), c("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", text.render(lit("Customer {{name}} of {{nation}} {{other}}"), values).alias("body"))


@query("SELECT doc_id, octet_length(encode(text)) AS file_size FROM documents")
def s17_file_size(t: Tables):
    return synthetic.metadata(t.documents.select("doc_id", c("doc_id").alias("id"), c("text").alias("content"))).select("doc_id", "file_size")


@query()
def s14_skewed_source(t: Tables):
    """As many rows as there are lines."""
    return synthetic.skewed(t.spark, t.lineitem.count()).groupBy("category").agg(F.count(lit(1)).alias("n"))


@query()
def s15_document_source(t: Tables):
    """As many as there are documents."""
    return synthetic.documents(t.spark, t.documents.count())


@query("""SELECT event_id, event_type AS operation_name, CASE WHEN event_type = 'purchase' THEN 'business' WHEN event_type = 'view' THEN 'metrics' ELSE 'unknown' END AS job_type,
CASE WHEN event_type = 'purchase' THEN 'event' WHEN event_type = 'view' THEN 'log' ELSE 'unknown' END AS operation_type, value::BIGINT AS x,
'user-' || user_id AS job_id FROM (SELECT event_id, event_type, user_id, floor(value) AS value FROM events)""")
def o5_job_log_rows(t: Tables):
    event = F.when(c("event_type") == "purchase", "OrderBusinessEvent").when(c("event_type") == "view", "CustomMetricsEvent")
    data = F.map_from_entries(F.filter(F.array(*[F.struct(lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (
        ("Event", event), ("Operation", c("event_type")), ("Job Group", F.concat(lit("user-"), c("user_id"))), ("records_processed", F.floor("value")), ("status", c("event_id")))]), lambda e: e["value"].isNotNull()))
    rows = joblogs.job_log_rows(t.events.select(data.alias("data")))
    return rows.select(c("status").cast("long").alias("event_id"), "operation_name", "job_type", "operation_type", c("records_processed").alias("x"), "job_id")


@query("SELECT event_id FROM events WHERE event_id % 10 = 0")
def o3_sampled_batches(t: Tables):
    return joblogs.sampled(t.events.select("event_id"), "event_id", 10)


@query("SELECT l_linenumber::BIGINT AS stage_id, count(*) AS n_tasks, max(l_quantity)::BIGINT AS max_ms, CASE WHEN max(l_quantity) / avg(l_quantity) > 3 THEN 'severe' WHEN max(l_quantity) / avg(l_quantity) > 2 THEN 'moderate' ELSE 'even' END AS verdict FROM lineitem GROUP BY l_linenumber")
def o15_task_skew(t: Tables):
    from ..operators.eventlogs import task_skew

    tasks = t.lineitem.select(c("l_linenumber").alias("stage_id"), c("l_quantity").cast("long").alias("duration_ms"), lit(0).alias("memory_spilled"), lit(0).alias("disk_spilled"))
    return task_skew(tasks).select("stage_id", "n_tasks", "max_ms", "verdict")
