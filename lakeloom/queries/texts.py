"""Chunkers and document kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as ch
from . import Tables, query

c, lit = F.col, F.lit
_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_S = _STRIP.format("s")


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens FROM documents")
def c1_token_counts(t: Tables):
    return t.documents.select("doc_id", F.size(ch.tokens(c("text"))).alias("n_tokens"))


_WINDOWS = f"""WITH k AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents),
n AS (SELECT doc_id, text, w, CASE WHEN len(w) <= 100 THEN 0 ELSE CAST(ceil((len(w) - 100) / 80.0) AS BIGINT) END AS last FROM k),
x AS (SELECT doc_id, text, w, unnest(range(last + 1)) AS i FROM n WHERE text <> '')
SELECT doc_id, i AS chunk_index, CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') END AS chunk_text FROM x"""


@query(_WINDOWS)
def c2_token_windows(t: Tables):
    return ch.exploded(t.documents, "doc_id", ch.token_windows(c("text"))).select("doc_id", "chunk_index", "chunk_text")


@query(_WINDOWS)
def c4_sql_chunkers(t: Tables):
    """The chunkers as SQL functions."""
    from ..functions import registered

    registered.register(t.spark)
    return t.view("documents").sql("SELECT doc_id, posexplode(w) AS (chunk_index, chunk_text) FROM (SELECT doc_id, token_windows(text, 100, 20) AS w FROM documents)")


def _count(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""WITH RECURSIVE raw AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+') AS p FROM documents)),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, {_S} AS s, {_count(_S)} AS k FROM raw WHERE {_S} <> ''),
walk AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS held, []::BIGINT[] AS ks, NULL::VARCHAR AS emitted, false AS last FROM (SELECT DISTINCT doc_id FROM sent)
 UNION ALL SELECT doc_id, i + 1,
  CASE WHEN s IS NULL THEN [] WHEN cut THEN list_append(held[len(held) - m + 1 :], s) ELSE list_append(held, s) END,
  CASE WHEN s IS NULL THEN [] WHEN cut THEN list_append(ks[len(ks) - m + 1 :], k) ELSE list_append(ks, k) END,
  CASE WHEN s IS NULL OR cut THEN array_to_string(held, ' ') END, s IS NULL
 FROM (SELECT w.doc_id, w.i, w.held, w.ks, n.s, n.k, len(w.held) > 0 AND list_sum(w.ks) + n.k > 100 AS cut,
   list_max([x for x in range(0, len(w.ks) + 1) if coalesce(list_sum(w.ks[len(w.ks) - x + 1 :]), 0) <= 20]) AS m
  FROM walk w LEFT JOIN sent n ON n.doc_id = w.doc_id AND n.i = w.i + 1 WHERE NOT w.last))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, emitted AS chunk_text, {_count('emitted')} AS token_count FROM walk WHERE emitted IS NOT NULL
UNION ALL SELECT doc_id, 0, text, {_count('text')} FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM sent)""")
def c3_sentence_chunks(t: Tables):
    return ch.exploded(t.documents, "doc_id", ch.sentence_chunks(c("text")))


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_text, chunk_index) AS chunk_id, len(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS token_count, 100::BIGINT AS chunk_size, 20::BIGINT AS overlap FROM ({_WINDOWS})")
def c5_chunk_table(t: Tables):
    from pyspark.sql import Window as W

    rows = ch.exploded(t.documents, "doc_id", ch.token_windows(c("text")))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_text", "chunk_index"))
    return rows.select("doc_id", number.alias("chunk_id"), "token_count", lit(100).alias("chunk_size"), lit(20).alias("overlap"))


@query(f"""SELECT count(*) AS n_chunks, min(k) AS min_tokens, max(k) AS max_tokens, sum(k)::BIGINT / count(*) AS avg_tokens, count(*) / count(DISTINCT doc_id) AS chunks_per_doc
FROM (SELECT doc_id, len(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS k FROM ({_WINDOWS}))""")
def c6_chunk_stats(t: Tables):
    rows = ch.exploded(t.documents, "doc_id", ch.token_windows(c("text"))).select("doc_id", c("token_count").cast("long").alias("k"))
    per = rows.groupBy("doc_id").agg(F.count(lit(1)).alias("n"), F.min("k").alias("mn"), F.max("k").alias("mx"), F.sum("k").alias("s"))
    n = F.sum("n")
    return per.agg(n.alias("n_chunks"), F.min("mn").alias("min_tokens"), F.max("mx").alias("max_tokens"), (F.sum("s") / n).alias("avg_tokens"), (n / F.count(lit(1))).alias("chunks_per_doc"))


@query(f"SELECT token_count, count(*) AS n FROM (SELECT len(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS token_count FROM ({_WINDOWS})) GROUP BY token_count")
def c18_size_histogram(t: Tables):
    return ch.exploded(t.documents, "doc_id", ch.token_windows(c("text"))).groupBy("token_count").agg(F.count(lit(1)).alias("n"))


#: Headings put before frequent first words of sentences, so that boundaries of all kinds occur.
_HEADS = {
    ". The ": ".\n\nChapter 3: The ", ". Of ": ".\nSection 4 Of ", ". And ": ".\n1.2 And ", ". To ": ".\n \nArticle 5: To ", ". In ": ".\n(a) In ", ". A ": ".\n7. A ",
    ". Is ": ".\nMethods\nIs ", ". That ": ".\n\nExecutive Summary That ", ". For ": ".\nHEADING LINE\nFor ", ". It ": ".\n# one\nIt ", ". He ": ".\n## two\n\n### three\nHe ",
    ". La ": ".\nHowever la ", ". De ": ".\n\n\nTherefore de ", ". Der ": ".\nAnother der ", ". Die ": ".\nCONTRACT\n \nClause 6: the party ", ". El ": ".\nIntroduction\nfunction ",
}


def _headed(t: Tables):
    text = c("text")
    for old, new in _HEADS.items():
        text = F.replace(text, lit(old), lit(new))
    return t.documents.select("doc_id", text.alias("text"))


def _headed_sql() -> str:
    text = "text"
    for old, new in _HEADS.items():
        text = f"replace({text}, '{old}', '{new}')"
    return f"(SELECT doc_id, {text} AS text FROM documents)"


_OUTLINE = r"\n(#{1,6}\s|[A-Z][A-Z ]{3,}\n)"


def _outline_sql(table: str) -> str:
    """A heading's line break may belong to the heading before, so marks are set in two rounds."""
    marked = f"regexp_replace(regexp_replace(text, '{_OUTLINE}', chr(1) || '\\1', 'g'), '{_OUTLINE}', chr(1) || '\\1', 'g')"
    return f"""WITH part AS (SELECT doc_id, unnest(string_split({marked}, chr(1))) AS s FROM {table} AS d)
SELECT doc_id, {_S} AS section, len(list_filter(regexp_split_to_array(s, '\\n\\s*\\n'), lambda p: {_STRIP.format("p")} <> '')) AS n_paragraphs FROM part WHERE {_S} <> ''"""


def _outlined(df):
    return df.select("doc_id", F.explode(ch.outline(c("text"))).alias("s")).select("doc_id", "s.section", F.size("s.paragraphs").alias("n_paragraphs"))


@query(_outline_sql("documents"))
def c7_outline(t: Tables):
    return _outlined(t.documents)


@query(_outline_sql(_headed_sql()))
def c7_headed_outline(t: Tables):
    return _outlined(_headed(t))


def _found_sql(names: list[str]) -> str:
    """Where each match of each pattern begins: what lies between the matches, and the matches, summed up."""
    each = [f"SELECT doc_id, '{n}' AS name, regexp_split_to_array(text, '(?i){ch.BOUNDARIES[n]}') AS g, regexp_extract_all(text, '(?i){ch.BOUNDARIES[n]}') AS h FROM src" for n in names]
    before = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)"
    return f"SELECT doc_id, name, unnest(list_transform(range(1, len(h) + 1), lambda i: {before}))::BIGINT AS pos FROM ({' UNION ALL '.join(each)})"


def _kind_sql(table: str) -> str:
    score = {k: _sql_score(k) for k in ("legal", "academic", "business", "technical")}
    return f"""(SELECT doc_id, CASE WHEN l >= a AND l >= b AND l >= c THEN 'legal' WHEN a >= b AND a >= c THEN 'academic' WHEN b >= c THEN 'business' ELSE 'technical' END AS document_type
FROM (SELECT doc_id, {score['legal']} AS l, {score['academic']} AS a, {score['business']} AS b, {score['technical']} AS c FROM {table}))"""


def _ranks_sql() -> str:
    kinds = [None, *ch.KINDS]
    return "VALUES " + ", ".join(f"('{k or 'general'}', '{n}', {i})" for k in kinds for i, n in enumerate(ch.priority(k)))


def _semantic_sql(table: str, typed: bool, most: int = 200, overlap: int = 200) -> str:
    """Chunks as a walk over segments that carries the open text."""
    kind = _kind_sql("src") if typed else "(SELECT doc_id, 'general' AS document_type FROM src)"
    tail = _STRIP.format(f"regexp_extract(right(cur, {overlap}), '([^.!?]*[.!?])\\s*$', 1)")
    cur = _STRIP.format("emitted")
    return f"""WITH RECURSIVE src AS (SELECT doc_id, coalesce(text, '') AS text FROM {table} AS d), kind AS MATERIALIZED {kind}, ranks(document_type, name, rank) AS ({_ranks_sql()}),
found AS MATERIALIZED (SELECT doc_id, pos, rank, name FROM ({_found_sql(list(ch.BOUNDARIES))}) JOIN kind USING (doc_id) JOIN ranks USING (document_type, name)),
cuts AS (SELECT * FROM found UNION ALL SELECT DISTINCT doc_id, 0, -1, 'document_start' FROM found),
seg AS (SELECT doc_id, name, row_number() OVER w AS k, substr(text, pos + 1, lead(pos, 1, length(text)) OVER w - pos) AS s FROM cuts JOIN src USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos, rank)),
numbered AS (SELECT *, count(*) FILTER ({_S} <> '') OVER (PARTITION BY doc_id ORDER BY k) AS i FROM seg),
piece AS MATERIALIZED (SELECT doc_id, i, arg_min(s, k) AS s, arg_max(name, k) AS label FROM numbered WHERE i > 0 GROUP BY doc_id, i),
walk AS (SELECT doc_id, 0::BIGINT AS i, '' AS cur, NULL::VARCHAR AS label, NULL::VARCHAR AS emitted, NULL::VARCHAR AS typed, false AS last FROM (SELECT DISTINCT doc_id FROM piece)
 UNION ALL SELECT doc_id, i + 1, CASE WHEN s IS NULL THEN '' WHEN cut THEN tail || s ELSE cur || s END, next, CASE WHEN s IS NULL OR cut THEN cur END, label, s IS NULL
 FROM (SELECT w.doc_id, w.i, cur, n.s, w.label, n.label AS next, cur <> '' AND (length(cur) + length(n.s)) // 4 > {most} AS cut,
   CASE WHEN {overlap} >= {4 * most} THEN '' WHEN length(cur) <= {overlap} THEN cur WHEN {tail} <> '' THEN {tail} ELSE string_split(right(cur, {overlap}), chr(10))[-1] END AS tail
  FROM walk w LEFT JOIN piece n ON n.doc_id = w.doc_id AND n.i = w.i + 1 WHERE NOT w.last)),
plain AS (SELECT doc_id, chunk_index, chunk_text FROM ({_paragraph_sql("(SELECT * FROM src WHERE doc_id NOT IN (SELECT doc_id FROM found))", most, 2000)})),
made AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, {cur} AS text, typed AS boundary_type, 'semantic_boundary' AS chunk_strategy FROM walk WHERE emitted IS NOT NULL
 UNION ALL SELECT doc_id, chunk_index, chunk_text, 'paragraph_group', 'paragraph_fallback' FROM plain)
SELECT doc_id, chunk_index, text, boundary_type, length(text) // 4 AS estimated_tokens, chunk_strategy, document_type FROM made JOIN kind USING (doc_id)"""


def _paragraph_sql(table: str, most: int, overlap: int) -> str:
    tail = _STRIP.format(f"regexp_extract(right(cur, {overlap}), '([^.!?]*[.!?])\\s*$', 1)")
    return f"""WITH RECURSIVE raw AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS p FROM {table} AS d)),
part AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, {_S} AS s FROM raw WHERE {_S} <> ''),
walk AS (SELECT doc_id, 0::BIGINT AS i, '' AS cur, NULL::VARCHAR AS emitted, false AS last FROM (SELECT DISTINCT doc_id FROM part)
 UNION ALL SELECT doc_id, i + 1,
  CASE WHEN s IS NULL THEN '' WHEN cur = '' THEN s WHEN cut THEN tail || chr(10) || chr(10) || s ELSE cur || chr(10) || chr(10) || s END,
  CASE WHEN (s IS NULL OR cut) AND cur <> '' THEN cur END, s IS NULL
 FROM (SELECT w.doc_id, w.i, cur, n.s, cur <> '' AND (length(cur) + 2 + length(n.s)) // 4 > {most} AS cut,
   CASE WHEN length(cur) <= {overlap} THEN cur WHEN {tail} <> '' THEN {tail} ELSE string_split(right(cur, {overlap}), chr(10))[-1] END AS tail
  FROM walk w LEFT JOIN part n ON n.doc_id = w.doc_id AND n.i = w.i + 1 WHERE NOT w.last))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, emitted AS chunk_text FROM walk WHERE emitted IS NOT NULL"""


def _boundaries(df):
    return df.select("doc_id", F.explode(ch.boundaries(c("text"))).alias("b")).select("doc_id", "b.pos", "b.name")


def _boundaries_sql(table: str) -> str:
    return f"WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM {table} AS d) SELECT doc_id, pos, name FROM ({_found_sql(ch.DEFAULT_PRIORITY)})"


@query(_boundaries_sql("documents"))
def c8_boundaries(t: Tables):
    return _boundaries(t.documents)


@query(_boundaries_sql(_headed_sql()))
def c8_headed_boundaries(t: Tables):
    return _boundaries(_headed(t))


def _semantic(df, by_kind: bool = False):
    rows = ch.semantic_chunks(df.select("doc_id", "text"), max_tokens=200, overlap=200, by_kind=by_kind)
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk")).select("doc_id", "chunk_index", "chunk.*")


def _sql_score(kind: str) -> str:
    weight, cues = ch.KINDS[kind]
    return "(" + " + ".join(f"len(regexp_extract_all(text, '(?i){x}'))" for x in cues) + f") * {weight}"


@query(_semantic_sql("documents", False))
def c9_semantic_chunks(t: Tables):
    return _semantic(t.documents)


@query(_semantic_sql(_headed_sql(), False))
def c9_headed_chunks(t: Tables):
    return _semantic(_headed(t))


@query(f"SELECT *, {_count('chunk_text')} AS token_count FROM ({_paragraph_sql('documents', 200, 100)})")
def c10_paragraph_chunks(t: Tables):
    return ch.exploded(t.documents, "doc_id", ch.paragraph_chunks(c("text"), 200, 100))


@query("SELECT doc_id, length(text) // 4 AS estimated FROM documents")
def c11_estimated_tokens(t: Tables):
    return t.documents.select("doc_id", ch.estimated_tokens(c("text")).alias("estimated"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN trim(regexp_extract(right(text, 80), '([^.!?]*[.!?])\\s*$', 1)) <> ''
THEN regexp_replace(regexp_extract(right(text, 80), '([^.!?]*[.!?])\\s*$', 1), '^\\s+|\\s+$', '', 'g') ELSE string_split(right(text, 80), chr(10))[-1] END AS overlap FROM documents""")
def c12_overlap(t: Tables):
    return t.documents.select("doc_id", ch.overlap_text(c("text"), 80).alias("overlap"))


@query(f"SELECT * FROM {_kind_sql('documents')}")
def c13_document_kind(t: Tables):
    return t.documents.select("doc_id", ch.kind(c("text")).alias("document_type"))


def _typed(df):
    return _semantic(df, by_kind=True).withColumns({"max_tokens": lit(200), "chunking_method": lit("enhanced_semantic")})


def _typed_sql(table: str) -> str:
    return f"SELECT *, 200::BIGINT AS max_tokens, 'enhanced_semantic' AS chunking_method FROM ({_semantic_sql(table, True)})"


@query(_typed_sql("documents"))
def c15_typed_semantic_chunks(t: Tables):
    return _typed(t.documents)


@query(_typed_sql(_headed_sql()))
def c15_headed_typed_chunks(t: Tables):
    return _typed(_headed(t))


def _stats(df):
    tokens = "estimated_tokens"
    return _semantic(df).groupBy("boundary_type", "chunk_strategy").agg(F.count(lit(1)).alias("n"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.avg(tokens).alias("mean"))


def _stats_sql(table: str) -> str:
    return f"""SELECT boundary_type, chunk_strategy, count(*) AS n, min(estimated_tokens) AS least, max(estimated_tokens) AS most, avg(estimated_tokens) AS mean
FROM ({_semantic_sql(table, False)}) GROUP BY ALL"""


@query(_stats_sql("documents"))
def c16_semantic_stats(t: Tables):
    return _stats(t.documents)


@query(_stats_sql(_headed_sql()))
def c16_headed_stats(t: Tables):
    return _stats(_headed(t))


_CHARS = f"""WITH RECURSIVE raw AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+') AS p FROM documents)),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, {_S} AS s FROM raw WHERE length({_S}) > 10),
walk AS (SELECT doc_id, 0::BIGINT AS i, '' AS cur, NULL::VARCHAR AS emitted, false AS last FROM (SELECT DISTINCT doc_id FROM sent)
 UNION ALL SELECT w.doc_id, w.i + 1,
  CASE WHEN n.s IS NULL THEN '' WHEN length(w.cur) + length(n.s) > 512 AND w.cur <> '' THEN right(w.cur, 128) || ' ' || n.s WHEN w.cur = '' THEN n.s ELSE w.cur || ' ' || n.s END,
  CASE WHEN n.s IS NULL THEN w.cur WHEN length(w.cur) + length(n.s) > 512 AND w.cur <> '' THEN w.cur END, n.s IS NULL
 FROM walk w LEFT JOIN sent n ON n.doc_id = w.doc_id AND n.i = w.i + 1 WHERE NOT w.last)
SELECT doc_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_position, {_STRIP.format('emitted')} AS chunk_text,
length({_STRIP.format('emitted')}) AS chunk_length FROM walk WHERE emitted IS NOT NULL AND {_STRIP.format('emitted')} <> ''"""


@query(_CHARS)
def c17_char_chunks(t: Tables):
    return ch.embedding_rows(t.documents).select("document_id", "chunk_position", "chunk_text", "chunk_length")


@query(f"""SELECT document_id, count(*) OVER (PARTITION BY document_id) AS total_chunks, chunk_position, chunk_text, chunk_length,
 document_id || '_chunk_' || CASE WHEN chunk_position < 1000 THEN lpad(chunk_position::VARCHAR, 3, '0') ELSE chunk_position::VARCHAR END AS chunk_id,
 len(regexp_split_to_array(chunk_text, '[\\s\\p{{Z}}]+')) AS chunk_word_count, CASE WHEN chunk_length BETWEEN 100 AND 1000 THEN 'optimal' ELSE 'suboptimal' END AS chunk_quality,
 'ready_for_embedding' AS embedding_status,
 '{{"chunk_position":' || chunk_position || ',"total_chunks":' || count(*) OVER (PARTITION BY document_id) || ',"chunk_length":' || chunk_length || ',"overlap":128}}' AS chunk_metadata
FROM ({_CHARS})""")
def c17_embedding_rows(t: Tables):
    return ch.embedding_rows(t.documents)
