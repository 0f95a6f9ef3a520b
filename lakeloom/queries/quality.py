"""Models, audits, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, contracts
from ..plans import models
from . import Tables, query

c, lit = F.col, F.lit


@query("""SELECT doc_id, length(text) AS content_length, len(string_split(text, ' ')) AS word_count, CASE WHEN length(text) > 0 AND doc_id IS NOT NULL THEN 'valid' ELSE 'invalid' END AS data_quality_status FROM documents""")
def q1_documents_cleaned(t: Tables):
    return models.cleaned(t.documents, "doc_id", "text", None).select("doc_id", "content_length", "word_count", "data_quality_status")


@query("SELECT doc_id FROM documents WHERE doc_id IS NULL OR lang IS NULL OR source IS NULL")
def q3_not_null(t: Tables):
    return audits.not_null("doc_id", "lang", "source")(t.documents).select("doc_id")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR length(trim(text)) = 0 OR len(string_split(text, ' ')) <= 0")
def q4_content(t: Tables):
    return audits.not_empty_content("text")(t.documents).select("doc_id")


@query("SELECT count(*) FILTER (trim(props) = '' OR props IS NULL) AS missing_code, 0::BIGINT AS missing_message, count(*) FILTER (ts IS NULL) AS missing_time, count(*) FILTER (user_id IS NULL) AS missing_job, 0::BIGINT AS missing_operation FROM events WHERE event_type = 'error'")
def q5_error_integrity(t: Tables):
    return audits.error_integrity(t.events.filter("event_type = 'error'"), "props", "event_type", "ts", "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_extendedprice <= 0 OR l_quantity <= 0 OR l_discount < 0 OR l_tax < 0")
def q6_positive_amounts(t: Tables):
    return audits.positive_amounts(["l_extendedprice", "l_quantity"], ["l_discount", "l_tax"])(t.lineitem).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate < DATE '1900-01-01' OR o_orderdate > DATE '1998-01-01' + INTERVAL 1 DAY")
def q7_valid_dates(t: Tables):
    return audits.valid_dates("o_orderdate", lit("1998-01-01").cast("timestamp_ntz"))(t.orders).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id IS NULL OR trim(doc_id::VARCHAR) = ''")
def q8_valid_id(t: Tables):
    return audits.valid_id("doc_id")(t.documents).select("doc_id")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity IS NULL OR l_quantity < 0 OR l_quantity > 10 OR floor(l_quantity) <> l_quantity")
def q9_count_in_range(t: Tables):
    return audits.count_in_range("l_quantity")(t.lineitem).select("l_orderkey", "l_linenumber")


_TEN = {
    "nulls": "doc_id IS NULL OR text IS NULL", "short": "length(text) < 100", "words": "len(string_split(text, ' ')) <= 0 OR len(string_split(text, ' ')) > 100000", "thin": "length(trim(text)) < 50",
}


@query(
    " UNION ALL ".join(f"SELECT '{k}' AS audit, count(*) AS violations, count(*) = 0 AS passed FROM documents WHERE {v}" for k, v in _TEN.items())
    + " UNION ALL SELECT 'duplicates', count(*), count(*) = 0 FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"
    + " UNION ALL SELECT 'languages', count(*), count(*) = 0 FROM (SELECT lang FROM documents GROUP BY lang HAVING lang NOT IN ('en', 'fr', 'de'))"
)
def q10_document_audits(t: Tables):
    suite = {
        "nulls": audits.not_null("doc_id", "text"),
        "short": audits.min_length("text", 100),
        "words": audits.words_between("text", 0, 100_000),
        "thin": audits.min_length("text", 50, trimmed=True),
        "duplicates": audits.no_duplicates("text"),
        "languages": audits.in_list("lang", ["en", "fr", "de"]),
    }
    return audits.run(t.documents, suite)


@query("SELECT 'documents' AS model, 'EXISTS' AS status UNION ALL SELECT 'other', 'MISSING'")
def q11_dependencies(t: Tables):
    return audits.dependencies(t.spark, {"documents": t.documents, "other": None})


@query("SELECT * FROM (VALUES ('doc_id', 'EXISTS'), ('text', 'EXISTS'), ('embedding', 'MISSING')) v(column_name, status)")
def q11_required_columns(t: Tables):
    return audits.required_columns(t.documents, ["doc_id", "text", "embedding"])


@query("""SELECT 'orders' AS model, max(o_orderdate)::VARCHAR AS latest, date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01') AS days,
CASE WHEN date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01') <= 7 THEN 'FRESH' WHEN date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01') <= 30 THEN 'STALE' ELSE 'VERY_STALE' END AS status FROM orders""")
def q11_freshness(t: Tables):
    rows = audits.freshness(t.orders, "o_orderdate", lit("2002-01-01").cast("date"), "orders")
    return rows.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS model, count(*) AS n_rows, count(*) * 1024 / 1048576.0 AS est_mb, CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) < 1000000 THEN 'NORMAL' WHEN count(*) < 10000000 THEN 'LARGE' ELSE 'VERY_LARGE' END AS volume,"
    f" CASE WHEN count(*) * 1024 / 1048576.0 <= 100 THEN 'LOW' WHEN count(*) * 1024 / 1048576.0 <= 1000 THEN 'MEDIUM' ELSE 'HIGH' END AS memory FROM {n}" for n in ("orders", "lineitem", "events")))  # fmt: skip
def q12_volumes(t: Tables):
    return audits.volumes({n: getattr(t, n) for n in ("orders", "lineitem", "events")})


@query("SELECT event_id, CASE WHEN value <= 60 THEN 'ACCEPTABLE' WHEN value <= 300 THEN 'SLOW' ELSE 'VERY_SLOW' END AS band FROM events")
def q12_time_bands(t: Tables):
    return t.events.select("event_id", audits.time_band(c("value")).alias("band"))


_SCHEMA = {
    "properties": {
        "event_type": {"type": "string", "enum": ["click", "view", "purchase"]},
        "value": {"type": "number", "minimum": 1, "maximum": 90},
        "props": {"type": "string", "pattern": r"^\{.*[0-4]\}$", "minLength": 9},
        "user_id": {"type": "integer"},
        "gone": {"type": "string"},
    },
    "required": ["event_type", "gone"],
}


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type is not allowed' END,
CASE WHEN value < 1 THEN 'value is too small' END, CASE WHEN value > 90 THEN 'value is too large' END, CASE WHEN NOT regexp_matches(props, '^\\{.*[0-4]\\}$') THEN 'props has another form' END,
CASE WHEN length(props) < 9 THEN 'props is too short' END, 'gone is required'], lambda x: x IS NOT NULL), '; ') AS errors FROM events""")
def v5_schema_errors(t: Tables):
    return t.events.select("event_id", F.array_join(contracts.errors(_SCHEMA, t.events.columns), "; ").alias("errors"))


@query("SELECT doc_id, coalesce(source IN ('contract', 'legal_memo', 'court_filing', 'policy_document', 'legal_opinion') AND length(trim(text)) >= 50, false) AS ok FROM documents")
def v9_document_rule(t: Tables):
    return t.documents.select("doc_id", contracts.valid_document(c("text"), c("source")).alias("ok"))


@query("SELECT event_id, code, code IN ('E001', 'E042') AS known FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'E001' WHEN 'view' THEN 'E007' WHEN 'purchase' THEN 'E042' ELSE props END AS code FROM events)")
def v7_known_error(t: Tables):
    kind = c("event_type")
    code = F.when(kind == "click", "E001").when(kind == "view", "E007").when(kind == "purchase", "E042").otherwise(c("props"))
    return t.events.select("event_id", code.alias("code")).select("event_id", "code", contracts.known_error(c("code")).alias("known"))


@query("""SELECT doc_id, doc_id::VARCHAR AS document_id, source AS document_type, lang AS language, n_chars AS file_size, 'spark' AS method FROM documents""")
def v8_struct_type(t: Tables):
    """Documents' metadata as JSON, parsed by the type that the contract gives."""
    made = F.to_json(F.struct(c("doc_id").cast("string").alias("document_id"), c("source").alias("document_type"), c("lang").alias("language"), c("n_chars").alias("file_size"), lit("spark").alias("method")))
    parsed = F.from_json(made, contracts.struct_type(contracts.DOCUMENT_METADATA)).alias("m")
    return t.documents.select("doc_id", parsed).select("doc_id", "m.document_id", "m.document_type", "m.language", "m.file_size", "m.method")
