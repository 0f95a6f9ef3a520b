"""Joins, aggregates, windows, top-k, subqueries, physical variants."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import physical, skew
from . import Tables, query

c, count, lit = F.col, F.count, F.lit
REVENUE = "l_extendedprice * (1 - l_discount)"
SUM = "CAST(sum(CAST({} AS DECIMAL(28,4))) AS DOUBLE)"


def dsum(x: str) -> str:
    return SUM.format(x)


@query(f"""
SELECT n_name, {dsum(REVENUE)} AS revenue, {dsum('l_quantity')} / count(*) AS avg_qty, max(l_extendedprice) AS max_price,
       min(l_extendedprice) AS min_price, count(*) AS n_lines
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def j3_star_join_rollup(t: Tables):
    """Fact to dimension to dimension, grouped: the dimensions are broadcast if their sizes allow it."""
    dims = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.select("n_nationkey", "n_name"), c("s_nationkey") == c("n_nationkey"))
    lines = t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    joined = lines.join(dims, c("l_suppkey") == c("s_suppkey"))
    price = c("l_extendedprice")
    return joined.groupBy("n_name").agg(
        agg.exact_sum(price * (1 - c("l_discount"))).alias("revenue"), agg.exact_avg(c("l_quantity")).alias("avg_qty"), F.max(price).alias("max_price"), F.min(price).alias("min_price"), count(lit(1)).alias("n_lines")
    )


@query("SELECT count(*) AS n FROM lineitem")
def a1_count(t: Tables):
    return t.lineitem.agg(count(lit(1)).alias("n"))


@query(f"SELECT count(*) AS n, {dsum('l_quantity')} AS s, {dsum('l_quantity')} / count(l_quantity) AS a, max(l_quantity) AS mx, min(l_quantity) AS mn FROM lineitem")
def a2_global_aggs(t: Tables):
    q = c("l_quantity")
    return t.lineitem.agg(count(lit(1)).alias("n"), agg.exact_sum(q).alias("s"), agg.exact_avg(q).alias("a"), F.max(q).alias("mx"), F.min(q).alias("mn"))


@query(f"SELECT user_id, {dsum('value')} AS total, count(*) AS n, {dsum('value')} / count(value) AS mean FROM events GROUP BY user_id")
def a3_group_skewed_key(t: Tables):
    v = c("value")
    return t.events.groupBy("user_id").agg(agg.exact_sum(v).alias("total"), count(lit(1)).alias("n"), agg.exact_avg(v).alias("mean"))


@query(f"SELECT user_id, {dsum('value')} AS total FROM events GROUP BY user_id")
def a3_salted_sum(t: Tables):
    return agg.salted(t.events, ["user_id"], {"total": c("value")})


@query(f"SELECT event_type, {dsum('value')} AS total, count(*) AS n FROM events GROUP BY event_type")
def a4_group_low_cardinality(t: Tables):
    return t.events.groupBy("event_type").agg(agg.exact_sum(c("value")).alias("total"), count(lit(1)).alias("n"))


@query(f"""SELECT l_suppkey, count(*) AS n, {dsum('l_quantity')} AS s, {dsum('l_quantity')} / count(l_quantity) AS a, max(l_quantity) AS mx, min(l_quantity) AS mn
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590""")
def a5_five_aggs_having(t: Tables):
    q = c("l_quantity")
    five = [count(lit(1)).alias("n"), agg.exact_sum(q).alias("s"), agg.exact_avg(q).alias("a"), F.max(q).alias("mx"), F.min(q).alias("mn")]
    return t.lineitem.groupBy("l_suppkey").agg(*five).filter("n > 590")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def a6_duplicate_keys(t: Tables):
    return agg.duplicate_keys(t.documents, ["text"])


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING lang NOT IN ('en', 'fr')")
def a7_having_on_key(t: Tables):
    return t.documents.groupBy("lang").agg(count(lit(1)).alias("n")).filter(~c("lang").isin("en", "fr"))


@query("SELECT lang, count(*) AS count FROM documents GROUP BY lang")
def a8_group_count(t: Tables):
    return t.documents.groupBy("lang").count()


@query("SELECT sum(n) / count(n) AS avg_turns FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def a9_average_of_counts(t: Tables):
    return t.conversations.groupBy("conv_id").agg(count(lit(1)).alias("n")).agg((F.sum("n") / count("n")).alias("avg_turns"))


@query("SELECT lang, sum(n_chars) / count(n_chars) AS avg_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents GROUP BY lang")
def a10_aliased_aggs(t: Tables):
    n = c("n_chars")
    return t.documents.groupBy("lang").agg((F.sum(n) / count(n)).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


@query("""SELECT count(n_chars) AS n, sum(n_chars) / count(n_chars) AS mean, round(stddev_samp(n_chars), 4) AS stddev, min(n_chars) AS min,
quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, max(n_chars) AS max FROM documents""")
def a11_summary(t: Tables):
    n = c("n_chars")
    parts = [F.percentile(n, lit(p)).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return t.documents.agg(count(n).alias("n"), (F.sum(n) / count(n)).alias("mean"), F.round(F.stddev(n), 4).alias("stddev"), F.min(n).alias("min"), *parts, F.max(n).alias("max"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def a12_distinct(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def a13_duplicate_rows(t: Tables):
    return agg.duplicate_rows(t.documents, ["text", "lang"])


@query(" UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) - count({x}) AS n_null FROM documents" for x in ("doc_id", "text", "lang", "source", "n_chars")))
def a14_null_counts(t: Tables):
    return agg.null_counts(t.documents)


@query("""SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished, count(CASE WHEN o_totalprice > 400000 THEN 1 END) AS large,
count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS urgent FROM orders""")
def a15_conditional_counts(t: Tables):
    return t.orders.agg(F.count_if(c("o_orderstatus") == "F").alias("finished"), F.count_if(c("o_totalprice") > 400000).alias("large"), F.count_if(c("o_orderpriority").startswith("1")).alias("urgent"))


@query("SELECT conv_id, list(role ORDER BY turn)::VARCHAR AS roles FROM conversations GROUP BY conv_id")
def a16_sorted_list(t: Tables):
    rows = t.conversations.groupBy("conv_id").agg(agg.sorted_list("turn", "role").alias("r"))
    return rows.select("conv_id", F.concat(lit("["), F.array_join("r", ", "), lit("]")).alias("roles"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def a17_joined_text(t: Tables):
    return t.conversations.groupBy("conv_id").agg(agg.joined_text("turn", "text").alias("body"))


@query(f"SELECT CAST(ts AS DATE)::VARCHAR AS day, hour(ts) AS hour, count(*) AS n, {dsum('value')} AS total FROM events GROUP BY 1, 2")
def a18_hourly_profile(t: Tables):
    keys = [F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour")]
    return t.events.groupBy(*keys).agg(count(lit(1)).alias("n"), agg.exact_sum(c("value")).alias("total"))


@query("SELECT count(*) AS unique_keys, max(n) AS max_frequency, sum(n) / count(*) AS avg_frequency, max(n) * count(*) / sum(n) AS skew_ratio FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def a22_key_skew(t: Tables):
    return agg.key_skew(t.documents, "source")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 0.001 * (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL OR o_custkey IS NULL)")
def a22_heavy_hitters(t: Tables):
    return skew.heavy_hitters(t.orders, "o_custkey", 0.001).select("o_custkey", "n")


@query("SELECT source, count(DISTINCT text) AS n_texts, max(n_chars) AS longest FROM documents GROUP BY source")
def a3_skewed_distinct(t: Tables):
    """Distinct texts by source: sets of hot sources are made in parts that no text is in twice."""
    docs = t.documents.select("source", "text", F.xxhash64("text").alias("h"), "n_chars")
    rows = docs.groupBy("source", "h", "text").agg(F.max("n_chars").alias("n_chars"))
    return skew.skew_groups(rows, "source", [count("text").alias("n"), F.max("n_chars").alias("m")], [F.sum("n").alias("n_texts"), F.max("m").alias("longest")], 0.04)


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY event_type")
def a23_shares(t: Tables):
    return agg.shares(t.events, "event_type")


@query("SELECT true AS some, count(*)::BIGINT AS record_count, true AS all_counted FROM events")
def a21_partition_counts(t: Tables):
    """How many partitions there are is the reader's choice; together they hold all rows, each once."""
    counts = agg.partition_counts(t.events)
    return counts.agg((count(lit(1)) > 0).alias("some"), F.sum("record_count").cast("long").alias("record_count"), (count(lit(1)) == F.count_distinct("partition_id")).alias("all_counted"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::BIGINT AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a_rollup(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(count(lit(1)).alias("n"), F.grouping("l_returnflag").alias("g"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def a_pivot(t: Tables):
    pivoted = t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return pivoted.select("o_orderstatus", F.coalesce("1-URGENT", lit(0)).alias("urgent"), F.coalesce("5-LOW", lit(0)).alias("low"))


# -- joins ---------------------------------------------------------------------------------------

_CO = "SELECT c_mktsegment, count(*) AS n, {} AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment".format(dsum("o_totalprice"))


def _segments(t: Tables, joined):
    return joined.groupBy("c_mktsegment").agg(count(lit(1)).alias("n"), agg.exact_sum(c("o_totalprice")).alias("total"))


@query(_CO)
def j1_inner_join(t: Tables):
    return _segments(t, t.customer.join(t.orders, c("c_custkey") == c("o_custkey")))


@query("SELECT d.doc_id, d.lang, l.quality::BIGINT AS quality FROM documents d JOIN labels l USING (doc_id)")
def j2_join_using(t: Tables):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "quality")


@query(_CO)
def j4_merge_join(t: Tables):
    return _segments(t, t.customer.join(t.orders.hint("merge"), c("c_custkey") == c("o_custkey")))


@query(_CO)
def j4_shuffle_hash_join(t: Tables):
    return _segments(t, t.customer.hint("shuffle_hash").join(t.orders, c("c_custkey") == c("o_custkey")))


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def j5_broadcast_join(t: Tables):
    return physical.join_small(t.supplier, t.nation, c("s_nationkey") == c("n_nationkey")).groupBy("n_name").agg(count(lit(1)).alias("n"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j6_cross_join(t: Tables):
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query("SELECT o_orderkey, x.v FROM orders CROSS JOIN LATERAL (SELECT unnest([o_orderstatus, o_orderpriority]) AS v) x")
def j7_lateral_join(t: Tables):
    return t.view("orders").sql("SELECT o_orderkey, x.v FROM orders CROSS JOIN LATERAL (SELECT explode(array(o_orderstatus, o_orderpriority)) AS v) x")


@query("SELECT o_orderstatus, count(*) AS n, any_value(s.n_all) AS n_all FROM orders CROSS JOIN (SELECT count(*) AS n_all FROM orders) s GROUP BY o_orderstatus")
def j8_join_one_row(t: Tables):
    one = t.orders.agg(count(lit(1)).alias("n_all"))
    return t.orders.crossJoin(F.broadcast(one)).groupBy("o_orderstatus").agg(count(lit(1)).alias("n"), F.any_value("n_all").alias("n_all"))


@query(_CO)
def j9_salted_join(t: Tables):
    left = t.orders.withColumn("k", c("o_custkey")).select("k", "o_orderkey", "o_totalprice")
    return _segments(t, physical.salted_join(left, t.customer.select(c("c_custkey").alias("k"), "c_mktsegment"), "k", 4))


@query(_CO)
def j9_skew_join(t: Tables):
    """Only customers with a thousandth of all orders are dealt out."""
    left = t.orders.withColumn("k", c("o_custkey")).select("k", "o_orderkey", "o_totalprice")
    return _segments(t, skew.skew_join(left, t.customer.select(c("c_custkey").alias("k"), "c_mktsegment"), "k", 0.001))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j_anti_join(t: Tables):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j_left_join(t: Tables):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(count("o_orderkey").alias("n"))


# -- windows -------------------------------------------------------------------------------------

_BY_TYPE = "PARTITION BY event_type ORDER BY ts, event_id"


@query(f"SELECT event_id, row_number() OVER ({_BY_TYPE}) AS rn FROM events")
def w1_row_number(t: Tables):
    return t.events.select("event_id", F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")).alias("rn"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DOUBLE) AS running FROM orders")
def w2_running_total(t: Tables):
    """The default frame: rows with an equal date count together."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate")
    return t.orders.select("o_orderkey", F.sum(c("o_totalprice").cast("decimal(28,4)")).over(w).cast("double").alias("running"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events")
def w3_place_by_value(t: Tables):
    return t.events.select("event_id", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("place"))


@query(f"""SELECT event_id, row_number() OVER ({_BY_TYPE}) AS rn, CAST(sum(CAST(value AS DECIMAL(28,4))) OVER ({_BY_TYPE}) AS DOUBLE) AS running,
row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events""")
def w4_three_windows(t: Tables):
    """One exchange, two sorts."""
    by = W.partitionBy("event_type")
    time, size = by.orderBy("ts", "event_id"), by.orderBy(F.desc("value"), "event_id")
    running = F.sum(c("value").cast("decimal(28,4)")).over(time).cast("double")
    return t.events.select("event_id", F.row_number().over(time).alias("rn"), running.alias("running"), F.row_number().over(size).alias("place"))


@query(f"SELECT event_id, event_type, rn FROM (SELECT event_id, event_type, row_number() OVER ({_BY_TYPE}) AS rn FROM events) ORDER BY event_id LIMIT 100")
def w5_window_then_limit(t: Tables):
    rn = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id"))
    return t.events.select("event_id", "event_type", rn.alias("rn")).orderBy("event_id").limit(100)


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS row_number FROM documents")
def w7_global_row_number(t: Tables):
    """No single task: ranges are numbered on their own and shifted."""
    return agg.numbered(t.documents.select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "row_number")


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d,
lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::BIGINT AS before, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS quarter FROM part""")
def w8_ranks(t: Tables):
    by, total = W.partitionBy("p_brand").orderBy("p_size"), W.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return t.part.select("p_partkey", F.rank().over(by).alias("r"), F.dense_rank().over(by).alias("d"), F.lag("p_size").over(total).alias("before"), F.ntile(4).over(total).alias("quarter"))


@query("SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def o10_last_of_each(t: Tables):
    place = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.select("event_type", "event_id", place.alias("place")).filter("place <= 5")


# -- order, top-k, subqueries --------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal")
def t1_order_by(t: Tables):
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal")


@query(f"SELECT c_mktsegment, {dsum('c_acctbal')} AS total FROM customer GROUP BY c_mktsegment ORDER BY total DESC")
def t2_order_by_agg(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(agg.exact_sum(c("c_acctbal")).alias("total")).orderBy(F.desc("total"))


@query(f"SELECT l_partkey, {dsum('l_quantity')} AS total FROM lineitem GROUP BY l_partkey ORDER BY total DESC, l_partkey LIMIT 20")
def t3_top_k(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(agg.exact_sum(c("l_quantity")).alias("total")).orderBy(F.desc("total"), "l_partkey").limit(20)


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY day DESC, hour LIMIT 10")
def t4_mixed_order(t: Tables):
    keys = [F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour")]
    return t.events.groupBy(*keys).agg(count(lit(1)).alias("n")).orderBy(F.desc("day"), "hour").limit(10)


@query("SELECT least(10, count(*)) AS n_rows, least(10, count(*)) AS n_events FROM events")
def t5_limit(t: Tables):
    """Any ten rows: of the table, and no event twice."""
    return t.events.limit(10).join(t.events.select("event_id"), "event_id", "left_semi").agg(count(lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_events"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY n DESC, conv_id LIMIT 10")
def t6_top_groups(t: Tables):
    return t.conversations.groupBy("conv_id").agg(count(lit(1)).alias("n")).orderBy(F.desc("n"), "conv_id").limit(10)


@query("SELECT label, count(*) AS n FROM customer JOIN (VALUES (1, 'Category A'), (2, 'Category B'), (3, 'Category C')) v(id, label) ON c_nationkey = id GROUP BY label")
def u1_inline_rows(t: Tables):
    """Labels put together row by row, beside a table."""
    one = lambda i, x: t.spark.range(i, i + 1).select("id", lit(x).alias("label"))
    labels = one(1, "Category A").unionByName(one(2, "Category B")).unionByName(one(3, "Category C"))
    return t.customer.join(F.broadcast(labels), c("c_nationkey") == c("id")).groupBy("label").agg(count(lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("orders", "customer", "part")))
def u2_union_of_aggs(t: Tables):
    parts = [getattr(t, n).agg(count(lit(1)).alias("n")).select(lit(n).alias("name"), "n") for n in ("orders", "customer", "part")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT part.p_partkey FROM part WHERE p_retailprice > (SELECT avg(CAST(p_retailprice AS DECIMAL(18,4))) FROM part)")
def u3_scalar_subquery(t: Tables):
    return t.view("part").sql("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(CAST(p_retailprice AS DECIMAL(18,4))) FROM part)")


@query("SELECT b, count(*) AS n FROM (SELECT p_partkey % 10 AS b FROM part) GROUP BY b")
def u4_derived_table(t: Tables):
    return t.view("part").sql("SELECT b, count(*) AS n FROM (SELECT p_partkey % 10 AS b FROM part) GROUP BY b")


_CTE = """WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey)
SELECT n, count(*) AS n_customers FROM per GROUP BY n"""


@query(_CTE)
def u5_cte_chain(t: Tables):
    return t.view("orders").sql(_CTE)


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(CAST(o_totalprice AS DECIMAL(18,4))) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def u7_correlated_subquery(t: Tables):
    return t.view("orders").sql("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(CAST(o_totalprice AS DECIMAL(18,4))) FROM orders i WHERE i.o_custkey = o.o_custkey)")


@query("SELECT lang FROM documents WHERE n_chars > 3000 INTERSECT SELECT lang FROM documents WHERE n_chars < 100 UNION SELECT o_orderstatus FROM orders EXCEPT SELECT 'F'")
def u_set_operations(t: Tables):
    long, short = (t.documents.filter(x).select("lang") for x in ("n_chars > 3000", "n_chars < 100"))
    return long.intersect(short).union(t.orders.select(c("o_orderstatus").alias("lang"))).distinct().subtract(t.spark.sql("SELECT 'F' AS lang"))


# -- the same rows however they are dealt --------------------------------------------------------

_STATUS = f"SELECT o_orderstatus, {dsum('o_totalprice')} AS total, count(*) AS n FROM orders GROUP BY o_orderstatus"


def _status(df):
    return df.groupBy("o_orderstatus").agg(agg.exact_sum(c("o_totalprice")).alias("total"), count(lit(1)).alias("n"))


@query(_STATUS)
def x1_shuffle_partitions(t: Tables):
    return _status(Tables(physical.session_with(t.spark, spark__sql__shuffle__partitions=2), t.sf_dir).orders)


@query(_STATUS)
def x2_repartition(t: Tables):
    return _status(t.orders.repartition(16, "o_orderstatus"))


@query(_STATUS)
def x3_coalesce(t: Tables):
    return _status(t.orders).coalesce(1)


@query(_STATUS)
def x4_without_aqe(t: Tables):
    return _status(Tables(physical.session_with(t.spark, spark__sql__adaptive__enabled="false"), t.sf_dir).orders)


@query("SELECT window_start::VARCHAR AS window_start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def g_windowed_counts(t: Tables):
    from ..streaming.micro import windowed_counts

    rows = windowed_counts(t.events, "ts", "event_type")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")
