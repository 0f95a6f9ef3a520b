"""Queries that judge their whole table, against plain Python."""

import math

from lakeloom.queries import REGISTRY


def test_every_line_is_judged(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice").collect()
    want = sorted((k, n) for k, n, p in rows if p is not None and math.floor(p) != p)
    got = sorted((r.l_orderkey, r.l_linenumber) for r in REGISTRY["f7_integrality"][0](spark, sf_dir).collect())
    assert got == want and any(k % 100 for k, _ in got)


def test_every_line_is_joined(spark, sf_dir):
    orders: dict = {}
    for k, at in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate").collect():
        orders.setdefault(k, []).append(at)
    want = {}
    for k, n, s, at in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate").collect():
        before = [o for o in orders.get(s, []) if o <= at]
        if before:
            want.setdefault((k, n), []).append(str(max(before)))
    got: dict = {}
    for r in REGISTRY["j_as_of"][0](spark, sf_dir).collect():
        got.setdefault((r.l_orderkey, r.l_linenumber), []).append(r.last_before)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and any(k % 50 for k, _ in got)


def test_halves_are_rounded_by_their_exact_value(spark):
    from pyspark.sql import functions as F

    from lakeloom.functions import text

    def duration(ms):
        return f"{ms:.0f}ms" if ms < 1000 else f"{ms / 1000:.1f}s" if ms < 60_000 else f"{ms / 60_000:.1f}min"

    def size(n):
        return f"{n}B" if n < 1024 else f"{n / 1024:.1f}KB" if n < 1024**2 else f"{n / 1024**2:.1f}MB" if n < 1024**3 else f"{n / 1024**3:.1f}GB"

    values = [*range(0, 200_000, 50), 1280, 1792, 2304, 1024**2 * 5 // 4, 1024**3 * 7 // 4, 10**12 + 7, 59_999, 1024**2 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", text.human_duration(F.col("v")).alias("took"), text.human_bytes(F.col("v")).alias("size")).collect()
    assert [(r.took, r.size) for r in rows] == [(duration(r.v), size(r.v)) for r in rows]


def test_every_document_is_in_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = REGISTRY["q2_incremental_model"][0](spark, sf_dir).collect()
    assert sum(r.n for r in got) == docs.filter("doc_id IS NOT NULL").count()


def test_documents_are_ingested_from_few_files(spark, tmp_path, monkeypatch):
    from lakeloom.plans import ingest

    kinds = ["web", "a b", "x/y", "q+r", "50%", ""]
    rows = [(i, f"text {i}", "en", kinds[i % 6], i) for i in range(300)]
    rows += [(7, "again", "de", kinds[1], 3), (7, "again", "de", kinds[1], 3), (None, "no id", "en", "web", 5), (301, "", "en", "web", 0), (302, None, "en", "web", 0), (303, "no kind", "en", None, 7)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    files, run = [], ingest.run

    def counted(*args):
        done = run(*args)
        files.append(done["files"])
        return done

    monkeypatch.setattr(ingest, "run", counted)
    got = REGISTRY["i8_document_pipelines"][0](spark, path).select("document_id", "document_type", "raw_text", "text_length", "language", "file_size").collect()
    text = lambda i: None if i is None else str(i)
    want = [(text(i), k, t, len(t), lang, n) for i, t, lang, k, n in rows if t and k is not None]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len(files) == 2 and max(files) <= 60
