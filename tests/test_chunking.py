"""The column chunkers against plain Python versions of their rules, on random texts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import chunking as ch

TEXTS = st.lists(st.text(alphabet="ab cdé.!?\n_1 ", max_size=120), min_size=1, max_size=12)
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def run(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", column.alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def words(text):
    return re.findall(r"[^\W]+", text.lower())


def windows(text, size, overlap):
    w = words(text)
    if not text:
        return []
    if len(w) <= size:
        return [text]
    out, start = [], 0
    while True:
        out.append(" ".join(w[start : start + size]))
        if start + size >= len(w):
            return out
        start += size - overlap


def packed(text, size, overlap):
    if not text:
        return []
    sents = [s for s in (x.strip() for x in re.split(r"[.!?]+", text)) if s]
    if not sents:
        return [text]
    out, opened, n = [], [], 0
    for s in sents:
        k = len(words(s))
        if n + k > size and opened:
            out.append(" ".join(opened))
            kept, total = [], 0
            for x in reversed(opened if overlap else []):
                if total + len(words(x)) > overlap:
                    break
                kept.insert(0, x)
                total += len(words(x))
            opened, n = kept, total
        opened.append(s)
        n += k
    return [*out, " ".join(opened)]


def chars(text, size, overlap, least):
    out, cur = [], ""
    for s in (x.strip() for x in re.split(r"[.!?]+", text)):
        if len(s) <= least:
            continue
        if cur and len(cur) + len(s) > size:
            out.append(cur.strip())
            cur = cur[-overlap:] + " " + s
        else:
            cur = f"{cur} {s}" if cur else s
    return out + [cur.strip()] * bool(cur.strip())


@QUICK
@given(TEXTS)
def test_token_windows(spark, texts):
    for size, overlap in ((3, 1), (5, 4), (4, 0)):
        assert run(spark, texts, ch.token_windows(F.col("text"), size, overlap)) == [windows(t, size, overlap) for t in texts]


@QUICK
@given(TEXTS)
def test_sentence_chunks(spark, texts):
    for size, overlap in ((4, 2), (3, 0), (6, 5)):
        assert run(spark, texts, ch.sentence_chunks(F.col("text"), size, overlap)) == [packed(t, size, overlap) for t in texts]


@QUICK
@given(TEXTS)
def test_char_chunks(spark, texts):
    assert run(spark, texts, ch.char_chunks(F.col("text"), 30, 8, 2)) == [chars(t, 30, 8, 2) for t in texts]


def test_edges(spark):
    null = [None, ""]
    for column in (ch.token_windows(F.col("text")), ch.sentence_chunks(F.col("text")), ch.char_chunks(F.col("text")), ch.paragraph_chunks(F.col("text"))):
        assert run(spark, null, column) == [[], []]
    assert run(spark, ["a b"], ch.token_windows(F.col("text"), 0)) == [["a b"]]
    with pytest.raises(ValueError):
        ch.token_windows(F.col("text"), 5, 5)


def test_paragraphs_and_overlap(spark):
    text = "one two three.\n\nfour five six. seven\n\neight nine ten"
    assert run(spark, [text], ch.paragraph_chunks(F.col("text"), 6, 8)) == [ch_paragraphs(text, 6, 8)]
    assert run(spark, ["short", "x" * 20 + " end here.", "no stop at all\nlast line"], ch.overlap_text(F.col("text"), 12)) == ["short", "xx end here.", "last line"]


def ch_paragraphs(text, most, overlap):
    """Paragraphs packed plainly: the estimate is a fourth of the characters."""
    done, current = [], None
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        if current is None:
            current = paragraph
        elif len(current + "\n\n" + paragraph) // 4 <= most:
            current += "\n\n" + paragraph
        else:
            done.append(current)
            current = plain_tail(current, overlap) + "\n\n" + paragraph
    return done + [current] * (current is not None)


def plain_tail(text, n):
    if len(text) <= n:
        return text
    tail = text[len(text) - n :]
    ended = re.search(r"[^.!?]*[.!?]\s*$", tail)
    return ended.group().strip() if ended and ended.group().strip() else tail.split("\n")[-1]


def plain_boundaries(text, kind=None):
    """Every match of every pattern, by place, then by the kind's order."""
    order = ch.FIRST_FOR_KIND.get(kind, []) + [n for n in ch.DEFAULT_PRIORITY if n not in ch.FIRST_FOR_KIND.get(kind, [])]
    places = {}
    for name in order:
        for match in re.compile(ch.BOUNDARIES[name], re.IGNORECASE).finditer(text):
            places.setdefault(match.start(), []).append(name)
    return [(at, name) for at in sorted(places) for name in places[at]]


def plain_semantic(text, most, overlap, kind=None):
    found = plain_boundaries(text, kind)
    if not found:
        return [(x, "paragraph_group", len(x) // 4, "paragraph_fallback", kind or "general") for x in ch_paragraphs(text, most, 2000)]
    starts, names = [0] + [at for at, _ in found], ["document_start"] + [n for _, n in found]
    done, current, label = [], "", None
    for begin, end, name in zip(starts, starts[1:] + [len(text)], names, strict=True):
        piece = text[begin:end]
        if piece.strip():
            if current and (len(current) + len(piece)) // 4 > most:
                done.append((current.strip(), label))
                current = plain_tail(current, overlap) if overlap < 4 * most else ""
            current += piece
            label = name
        elif current:
            label = name
    if current.strip():
        done.append((current.strip(), label))
    return [(x, name, len(x) // 4, "semantic_boundary", kind or "general") for x, name in done]


def plain_kind(text):
    scores = [(w * sum(len(re.findall(cue, text, re.IGNORECASE)) for cue in cues), -i, name) for i, (name, (w, cues)) in enumerate(ch.KINDS.items())]
    return max(scores)[2]


@pytest.fixture(scope="module")
def headed(spark, sf_dir, tmp_path_factory):
    """The whole documents table, with headings of all sorts put between lines of some texts, and as it is."""
    heads = ["Chapter 3: x", "Section 4 y", "1.2 Alpha", "Article 5: z", "(a) Beta", "7. Gamma", "Methods", "Executive Summary", "HEADING LINE", "# one", "## two", "### three", "However it is", "Therefore so", "Another thing", "the contract party", "an api function"]
    rows = []
    for k, r in enumerate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()):
        words = (r.text or "").split(" ")
        for i in range(20 + k % 7, len(words), 25 + k % 11):
            words[i] = ("\n\n" if i % 2 else "\n") + heads[(i + k) % len(heads)] + "\n" + words[i]
        rows.append((r.doc_id, " ".join(words) if k % 3 else r.text))
    rows.append((-1, None))
    path = str(tmp_path_factory.mktemp("headed"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, [(i, t or "") for i, t in rows]


def rows_of(spark, name, path):
    from collections import Counter

    from lakeloom.queries import REGISTRY

    return Counter(map(tuple, REGISTRY[name][0](spark, path).collect()))


def test_queries_over_a_whole_table_of_headed_texts(spark, headed):
    from collections import Counter, defaultdict

    path, rows = headed
    numbered = lambda chunks: enumerate(chunks)
    count = lambda t: len(re.findall(r"[^\W]+", t.lower()))
    places = Counter((i, at, name) for i, t in rows for at, name in plain_boundaries(t))
    assert len(places) > 1000 and len({n for _, _, n in places}) >= 14 and rows_of(spark, "c8_boundaries", path) == places
    want = Counter((i, k, *x) for i, t in rows for k, x in numbered(plain_semantic(t, 200, 200)))
    assert rows_of(spark, "c9_semantic_chunks", path) == want and len({x[3] for x in want}) >= 8
    typed = Counter((i, k, *x, 200, "enhanced_semantic") for i, t in rows for k, x in numbered(plain_semantic(t, 200, 200, plain_kind(t))))
    assert rows_of(spark, "c15_typed_semantic_chunks", path) == typed and len({x[6] for x in typed}) >= 3
    figures = defaultdict(list)
    for x in want.elements():
        figures[x[3], x[5]].append(x[4])
    assert rows_of(spark, "c16_semantic_stats", path) == Counter((*k, len(v), min(v), max(v), sum(v) / len(v)) for k, v in figures.items())
    parts = Counter((i, k, x, count(x)) for i, t in rows for k, x in numbered(ch_paragraphs(t, 200, 100)))
    assert rows_of(spark, "c10_paragraph_chunks", path) == parts
    whole = Counter((i, k, x, count(x)) for i, t in rows for k, x in numbered(packed(t, 100, 20)))
    assert rows_of(spark, "c3_sentence_chunks", path) == whole
    sections = Counter()
    for i, t in rows:
        for s in re.split(r"\n(?=#{1,6}\s|[A-Z][A-Z ]{3,}\n)", t):
            if s.strip():
                sections[i, s.strip(), sum(bool(p.strip()) for p in re.split(r"\n\s*\n", s))] += 1
    assert rows_of(spark, "c7_outline", path) == sections and max(n for _, _, n in sections) > 2


def test_kinds(spark):
    texts = ["the contract and the agreement", "abstract results discussion", "the revenue and financial background", "api endpoint function", "nothing here"]
    assert run(spark, texts, ch.kind(F.col("text"))) == ["legal", "academic", "business", "technical", "legal"]


def test_semantic_chunks_keep_bodies(spark):
    text = "start of it\nChapter 1: one\n" + "body one. " * 30 + "\nChapter 2: two\n" + "body two. " * 30 + "\n# heading\nend"
    rows = ch.semantic_chunks(spark.createDataFrame([(text,), ("a\n\nb",), (None,)], "text string"), max_tokens=60, overlap=0).collect()
    chunks = rows[0].chunks
    assert [c.boundary_type for c in chunks] == [x[1] for x in plain_semantic(text, 60, 0)] and chunks[-1].boundary_type == "markdown_h1"
    joined = " ".join(c.text for c in chunks)
    assert joined.count("body one.") >= 30 and joined.count("body two.") >= 30
    assert [(c.text, c.boundary_type, c.chunk_strategy) for c in rows[1].chunks] == [("a\n\nb", "paragraph_group", "paragraph_fallback")] and rows[2].chunks == []
    assert ch.priority("legal")[:3] == ["legal_section", "legal_subsection", "legal_paragraph"] and ch.priority(None) == ch.DEFAULT_PRIORITY


def test_embedding_rows(spark):
    df = spark.createDataFrame([(7, "A sentence that is long enough. Another sentence that is long.")], "doc_id int, text string")
    row = ch.embedding_rows(df).first()
    assert (row.chunk_id, row.total_chunks, row.chunk_word_count, row.chunk_quality) == ("7_chunk_000", 1, 11, "suboptimal") and '"chunk_position":0' in row.chunk_metadata


def test_overlap_is_found_in_one_pass(spark):
    import random
    import re
    import time

    from pyspark.sql import functions as F

    def want(t, n):
        if len(t) <= n:
            return t
        found = re.search(r"([^.!?]*[.!?])[ \t\n\x0b\x0c\r]*$", t[-n:])
        s = found[1].strip() if found else ""
        return s or t[-n:].split("\n")[-1]

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .!?\n\r\t") for _ in range(rng.randrange(40))) for _ in range(3000)] + ["abc" * 10, "a. b\n", "x\n..", "a" * 30 + "!\n \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 7, 20):
        assert [r.o for r in df.select(ch.overlap_text(F.col("t"), n).alias("o")).collect()] == [want(t, n) for t in texts]
    began = time.time()
    assert spark.range(1).select(F.length(ch.overlap_text(F.concat(F.lit("x."), F.repeat(F.lit("y "), 200_000)), 300_000)).alias("n")).first().n == 300_000
    assert time.time() - began < 10
