"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM line),
first AS (SELECT key, min(doc_id) AS head FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> head, false) AS gone FROM keyed LEFT JOIN first USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

#: The checksum of a feature goes over its bits, lowest first; the polynomial of crc32 is a fixed value.
RESAMPLING = rf"""
WITH texts AS (SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
doc AS (SELECT row_number() OVER () AS r, side, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (SELECT r, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM doc),
counted AS (SELECT f, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM feature GROUP BY f),
bits AS (SELECT f, s, t, hex(encode(f)) AS h FROM counted),
bucketed AS (SELECT f, s, t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(4 * length(h)),
    lambda i: (('0x' || substr(h, 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)) & 1)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) % 10000 AS b FROM bits),
gained AS (SELECT b, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM bucketed GROUP BY b),
meant AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM feature JOIN bucketed USING (f) JOIN gained USING (b) WHERE side = 'd' GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN meant USING (r) WHERE side = 'd'),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS most FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""

COLLOCATIONS = rf"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
piece AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
run AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM piece, (SELECT unnest([1, 2, 3, 4]) AS k)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM run GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND f >= 30),
cut AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM candidate)),
scored AS (SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN counted x ON x.lang = cut.lang AND x.phrase = head JOIN counted y ON y.lang = cut.lang AND y.phrase = rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, part AS phrase, max(a) AS longest
  FROM (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS part FROM (SELECT *, unnest(range(2, k)) AS m FROM candidate)) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * longest::HUGEINT < 80 * a::HUGEINT, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

JACCARD_JOIN = rf"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT d, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM doc),
size AS (SELECT d, count(*) AS n FROM shingle GROUP BY d),
pair AS (SELECT x.d AS u, y.d AS v, count(*) AS same FROM shingle x JOIN shingle y ON x.s = y.s AND x.d <> y.d GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN size x ON x.d = u JOIN size y ON y.d = v WHERE 100 * same >= 85 * (x.n + y.n - same)),
reach AS (SELECT d AS a, d AS b FROM doc UNION SELECT a, v FROM reach JOIN link ON b = u)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, min(other.doc_id) AS component_id
FROM doc LEFT JOIN size USING (d) JOIN reach ON a = doc.d JOIN doc other ON other.d = b GROUP BY doc.d, doc.doc_id, n"""

ORACLES = {"op7_line_dedup": LINE_DEDUP, "op11_collocations": COLLOCATIONS, "op12_jaccard_join": JACCARD_JOIN, "op13_importance_resampling": RESAMPLING}
