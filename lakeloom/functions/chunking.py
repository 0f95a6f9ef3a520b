"""Text chunkers as column expressions: every one maps a text column to an array column.

Folds are ``aggregate`` over an array; whatever a lambda uses more than once is bound by
``let``, because a plain alias would be inlined and computed anew for every element.
Folds carry lengths and places; a chunk's text is joined once, from the pieces it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
STRINGS = "array<string>"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


#: All characters of Unicode's White_Space property (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without any white space at the ends, Unicode included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_windows(text: Column, size: int = 100, overlap: int = 20) -> Column:
    """Windows of ``size`` tokens, each starting ``size - overlap`` after the one before; a short text stays as it is.

    Null and '' give no window.  ``overlap >= size`` is refused: it would never end.
    """
    none = F.array().cast(STRINGS)
    if size <= 0:
        return F.when(text.isNull() | (text == ""), none).otherwise(F.array(text))
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step = size - overlap

    def cut(t: Column) -> Column:
        last = F.ceil((F.size(t) - size) / step).cast("int")
        windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.array_join(F.slice(t, k * step + 1, size), " "))
        return F.when(F.size(t) <= size, F.array(text)).otherwise(windows)

    return F.when(text.isNull() | (text == ""), none).otherwise(let(tokens(text), cut))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


def sentence_chunks(text: Column, size: int = 100, overlap: int = 20) -> Column:
    """Whole sentences packed up to ``size`` tokens; a chunk begins with the last sentences of the one before that fit ``overlap``.

    The fold goes over numbers only: the sentences' tokens; a chunk is where it begins
    and ends.  Sentences are joined once, at the end.
    """
    none = F.array().cast(STRINGS)
    if size <= 0:
        return F.when(text.isNull() | (text == ""), none).otherwise(F.array(text))
    ends = F.array().cast("array<struct<a:int,b:int>>")

    def packed(x: Column) -> Column:
        found, counts = x["s"], x["n"]
        start = F.struct(ends.alias("out"), F.lit(0).alias("a"), F.lit(0).alias("n"))

        def carried(a: Column, b: Column) -> Column:
            """How many of the last whole sentences before ``b`` have up to ``overlap`` tokens together, and how many tokens."""
            none_yet = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("go"))

            def back(acc: Column, n: Column) -> Column:
                fits = acc["go"] & (acc["n"] + n <= overlap)
                return F.struct((acc["k"] + fits.cast("int")).alias("k"), (acc["n"] + F.when(fits, n).otherwise(0)).alias("n"), fits.alias("go"))

            return F.aggregate(F.reverse(F.slice(counts, a + 1, b - a)), none_yet, back) if overlap > 0 else none_yet

        def step(acc: Column, i: Column) -> Column:
            n = F.get(counts, i)
            cut = F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), i.alias("b"))))
            after = let(carried(acc["a"], i), lambda k: F.struct(cut.alias("out"), (i - k["k"]).alias("a"), (k["n"] + n).alias("n")))
            return F.when((acc["n"] + n > size) & (i > acc["a"]), after).otherwise(F.struct(acc["out"].alias("out"), acc["a"].alias("a"), (acc["n"] + n).alias("n")))

        def close(acc: Column) -> Column:
            return F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), F.size(found).alias("b"))))

        chunks = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, close)
        return F.transform(chunks, lambda k: F.array_join(F.slice(found, k["a"] + 1, k["b"] - k["a"]), " "))

    def counted(found: Column) -> Column:
        numbers = F.struct(found.alias("s"), F.transform(found, lambda s: F.size(tokens(s))).alias("n"))
        return F.when(F.size(found) == 0, F.array(text)).otherwise(let(numbers, packed))

    return F.when(text.isNull() | (text == ""), none).otherwise(let(sentences(text), counted))


PACKED = "array<struct<text:string,last:int>>"


def packed(pieces: Column, full, between: str, tail) -> Column:
    """Pieces packed in order: array<struct<text,last>>, ``last`` being a chunk's last piece.

    ``full(n, more)`` says whether a chunk of ``n`` characters has no room for a piece of
    ``more``.  Chunks after the first begin with ``tail`` of the one before, and ``between``.
    """

    def fold(x: Column) -> Column:
        found, sizes = x["p"], x["n"]
        start = F.struct(F.array().cast(PACKED).alias("out"), F.lit(0).alias("a"), F.lit("").alias("head"), F.lit(0).alias("n"))
        text = lambda acc, b: F.concat(acc["head"], F.array_join(F.slice(found, acc["a"] + 1, b - acc["a"]), between))
        closed = lambda acc, t, b: F.concat(acc["out"], F.array(F.struct(t.alias("text"), (b - 1).alias("last"))))

        def step(acc: Column, i: Column) -> Column:
            more = F.get(sizes, i)

            def cut(x: Column) -> Column:
                n = F.length(x["h"]) + len(between) + more
                return F.struct(closed(acc, x["t"], i).alias("out"), i.alias("a"), F.concat(x["h"], F.lit(between)).alias("head"), n.alias("n"))

            ended = let(let(text(acc, i), lambda t: F.struct(t.alias("t"), tail(t).alias("h"))), cut)
            grown = F.struct(acc["out"].alias("out"), acc["a"].alias("a"), acc["head"].alias("head"), (acc["n"] + F.when(acc["n"] > 0, len(between)).otherwise(0) + more).alias("n"))
            return F.when((acc["n"] > 0) & full(acc["n"], more), ended).otherwise(grown)

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: closed(acc, text(acc, F.size(found)), F.size(found)))

    sized = let(pieces, lambda p: F.struct(p.alias("p"), F.transform(p, F.length).alias("n")))
    return let(sized, lambda x: F.when(F.size(x["p"]) == 0, F.array().cast(PACKED)).otherwise(fold(x)))


def char_chunks(text: Column, size: int = 512, overlap: int = 128, least: int = 10) -> Column:
    """Sentences of over ``least`` characters packed up to ``size``; a chunk begins with the last ``overlap`` characters before."""
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), strip), lambda s: F.length(s) > least)
    chunks = packed(pieces, lambda n, more: n + more > size, " ", lambda t: F.right(t, F.lit(overlap)))
    return F.filter(F.transform(chunks, lambda x: strip(x["text"])), lambda t: t != "")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def overlap_text(text: Column, n: int) -> Column:
    """All of a short text; else, of its last ``n`` characters, the run that ends in a terminator, or the last line."""
    tail = F.right(text, F.lit(n))
    # anchored, from the last terminator but one: a search from every place would take the square of ``n``
    sentence = strip(F.regexp_extract(tail, r"(?s)^(?:.*[.!?])?([^.!?]*+[.!?])\s*$", 1))
    line = F.element_at(F.split(tail, "\n"), -1)
    return F.when(F.length(text) <= n, text).otherwise(let(sentence, lambda s: F.when(s != "", s).otherwise(line)))


def paragraph_chunks(text: Column, max_tokens: int = 1000, overlap: int = 2000) -> Column:
    """Paragraphs packed while a fourth of the length stays within ``max_tokens``; each chunk begins with an overlap."""
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), strip), lambda p: p != "")
    chunks = packed(pieces, lambda n, more: F.floor((n + 2 + more) / 4) > max_tokens, "\n\n", lambda t: overlap_text(t, overlap))
    return F.transform(chunks, lambda x: x["text"])


def outline(text: Column) -> Column:
    """A text as nested levels: sections (markdown or upper-case headings), their paragraphs, their sentences."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n(?=#{1,6}\s|[A-Z][A-Z ]{3,}\n)"), lambda s: strip(s) != "")
    paragraphs = lambda s: F.filter(F.transform(F.split(s, r"\n\s*\n"), strip), lambda p: p != "")
    return F.transform(parts, lambda s: F.struct(strip(s).alias("section"), F.transform(paragraphs(s), lambda p: F.struct(p.alias("paragraph"), sentences(p).alias("sentences"))).alias("paragraphs")))


# --- kinds of documents -------------------------------------------------------------------------

#: Weight in tenths, and cues, of each kind, in the order that decides ties (fixed values).
KINDS = {
    "legal": (8, (r"\b(?:contract|agreement|clause|article|section|party|whereas|therefore)\b", r"\n\s*(?:Article|ARTICLE|Clause|CLAUSE)\s+\d+", r"\n\s*\(\w+\)\s+[A-Z]")),
    "academic": (7, (r"\b(?:abstract|introduction|methods|results|discussion|conclusion|references)\b", r"\n\s*(?:Abstract|Introduction|Methods|Results|Discussion|Conclusion)", r"\n\s*\d+\.\d+\s+[A-Z][a-z]+")),
    "business": (6, (r"\b(?:executive summary|background|analysis|recommendations|financial|revenue)\b", r"\n\s*(?:Executive Summary|Background|Analysis|Recommendations)", r"\n\s*[A-Z][A-Z\s]{3,}\n")),
    "technical": (5, (r"\b(?:api|endpoint|function|class|method|parameter|return)\b", r"\n\s*```\w+", r"\n\s*#\s+[^\n]+")),
}


def kind_scores(text: Column, kinds=KINDS) -> Column:
    """Weighted numbers of cues by kind (a struct), in whole tenths so that ties are exact.

    The words of all kinds, which never overlap, are looked for in one pass; other cues in one each.
    """
    words = {name: cues[0].removeprefix(r"\b(?:").removesuffix(r")\b").split("|") for name, (_, cues) in kinds.items()}
    every = "|".join(sorted({w for ws in words.values() for w in ws}))
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{every})\b"), F.lit(0)), F.lower)

    def scores(seen: Column) -> Column:
        among = lambda own: lambda w: w.isin(own)
        own = {name: F.size(F.filter(seen, among(words[name]))) for name in kinds}
        rest = {name: sum((F.regexp_count(text, F.lit("(?i)" + c)) for c in cues[1:]), F.lit(0)) for name, (_, cues) in kinds.items()}
        return F.struct(*[((own[name] + rest[name]) * weight).alias(name) for name, (weight, _) in kinds.items()])

    return let(found, scores)


def kind(text: Column, kinds=KINDS) -> Column:
    """The kind with the largest score, the first of those tied."""

    def first(s: Column) -> Column:
        best = F.greatest(*[s[k] for k in kinds]) if len(kinds) > 1 else s[next(iter(kinds))]
        return F.coalesce(*[F.when(s[k] == best, F.lit(k)) for k in kinds])

    return let(kind_scores(text, kinds), first)


# --- semantic boundaries ------------------------------------------------------------------------

#: Boundary patterns by name, matched in any case (fixed values).
BOUNDARIES = {
    "chapter": r"\n\s*(?:Chapter|CHAPTER)\s+\d+[:\s]",
    "section": r"\n\s*(?:Section|SECTION)\s+\d+[:\s]",
    "subsection": r"\n\s*\d+\.\d+\s+[A-Z]",
    "legal_section": r"\n\s*(?:Article|ARTICLE|Clause|CLAUSE)\s+\d+[:\s]",
    "legal_subsection": r"\n\s*\(\w+\)\s+[A-Z]",
    "legal_paragraph": r"\n\s*\d+\.\s+[A-Z]",
    "academic_section": r"\n\s*(?:Introduction|Methods|Results|Discussion|Conclusion)",
    "academic_subsection": r"\n\s*\d+\.\d+\s+[A-Z][a-z]+",
    "business_section": r"\n\s*(?:Executive Summary|Background|Analysis|Recommendations)",
    "business_subsection": r"\n\s*[A-Z][A-Z\s]{3,}\n",
    "markdown_h1": r"\n\s*#\s+[^\n]+",
    "markdown_h2": r"\n\s*##\s+[^\n]+",
    "markdown_h3": r"\n\s*###\s+[^\n]+",
    "topic_shift": r"\n\s*(?:However|Moreover|Furthermore|Additionally|In contrast|On the other hand)",
    "conclusion_indicators": r"\n\s*(?:In conclusion|To summarize|Therefore|Thus|As a result)",
    "new_topic": r"\n\s*(?:The next|Another|A different|Moving on|Now consider)",
}
#: Which boundary comes first at one position (fixed values).
DEFAULT_PRIORITY = [
    "chapter", "section", "legal_section", "academic_section", "business_section",
    "subsection", "legal_subsection", "academic_subsection", "business_subsection",
    "markdown_h1", "markdown_h2", "markdown_h3",
    "topic_shift", "conclusion_indicators", "new_topic",
]
#: What comes before them for a kind of document (fixed values).
FIRST_FOR_KIND = {
    "legal": ["legal_section", "legal_subsection", "legal_paragraph", "section", "subsection", "chapter"],
    "academic": ["academic_section", "academic_subsection", "section", "subsection", "chapter"],
    "business": ["business_section", "business_subsection", "section", "subsection", "chapter"],
}


def priority(kind_name: str | None) -> list[str]:
    """The order of boundaries for a kind of document: its own first; a pure function, no state between documents."""
    first = FIRST_FOR_KIND.get(kind_name, [])
    return first + [k for k in DEFAULT_PRIORITY if k not in first]


def positions(text: Column, regex: Column) -> Column:
    """Where each match begins, from 0: the pieces around the matches and the matches themselves, in turn, summed up."""

    def places(x: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.get(x["gaps"], i)
            return let(begin, lambda b: F.struct(F.concat(acc["out"], F.array(b)).alias("out"), (b + F.get(x["hits"], i)).alias("at")))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1), start, step, lambda acc: acc["out"])

    def sized(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, regex, F.lit(0))
        both = F.struct(F.transform(gaps, F.length).alias("gaps"), F.transform(hits, F.length).alias("hits"))
        return F.when(F.size(gaps) > 1, let(both, places)).otherwise(F.array().cast("array<int>"))

    return let(F.split(text, regex, -1), sized)


def boundaries(text: Column, kind_name: Column | None = None) -> Column:
    """array<struct<pos,rank,name>> of all boundaries, by position, then by the order for the kind of document; null as empty."""

    def rank(name: str) -> Column:
        place = lambda k: F.lit(priority(k).index(name) if name in priority(k) else None).cast("int")
        out = place(None)
        for k in FIRST_FOR_KIND if kind_name is not None else ():
            out = F.when(kind_name == k, place(k)).otherwise(out)
        return out

    names = BOUNDARIES if kind_name is not None else DEFAULT_PRIORITY
    patterns = F.array(*[F.struct(rank(n).alias("rank"), F.lit(n).alias("name"), F.lit(f"(?iU){BOUNDARIES[n]}").alias("regex")) for n in names])

    def every(whole: Column) -> Column:
        found = lambda x: F.transform(positions(whole, x["regex"]), lambda p: F.struct(p.alias("pos"), x["rank"].alias("rank"), x["name"].alias("name")))
        return F.sort_array(F.flatten(F.transform(F.filter(patterns, lambda x: x["rank"].isNotNull()), found)))

    return let(F.coalesce(text, F.lit("")), every)


CHUNK = "array<struct<text:string,boundary_type:string,estimated_tokens:int,chunk_strategy:string,document_type:string>>"


def semantic_chunks(df: DataFrame, text_col: str = "text", max_tokens: int = 1000, overlap: int = 5000, by_kind: bool = False) -> DataFrame:
    """``df`` with ``chunks``: array<struct<text,boundary_type,estimated_tokens,chunk_strategy,document_type>>.

    Segments run from boundary to boundary, the first from the start; whole segments are
    packed while the estimate stays within ``max_tokens``.  A chunk is typed by its last
    boundary.  Texts without any boundary are packed by paragraph.  White space between
    two boundaries is no segment, but its boundary types the chunk that is open.
    """

    def chunk(t: Column, boundary: Column, strategy: str, kind_name: Column) -> Column:
        fields = {"text": t, "boundary_type": boundary, "estimated_tokens": estimated_tokens(t).cast("int"), "chunk_strategy": F.lit(strategy), "document_type": kind_name}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def segments(text: Column, found: Column) -> Column:
        first = F.struct(F.lit(0).alias("pos"), F.lit("document_start").alias("name"))
        starts = F.concat(F.array(first), F.transform(found, lambda b: F.struct(b["pos"].alias("pos"), b["name"].alias("name"))))
        at = lambda s, i: F.get(s, i)["pos"]
        cut = lambda s, i: F.substring(text, at(s, i) + 1, F.coalesce(at(s, i + 1), F.length(text)) - at(s, i))
        return let(starts, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.struct(cut(s, i).alias("s"), F.get(s, i)["name"].alias("name"))))

    def by_boundary(x: Column, kind_name: Column) -> Column:
        """x: the segments, and which of them aren't blank."""
        all_, full = x["all"], x["full"]
        pieces = F.transform(full, lambda i: F.get(all_, i)["s"])
        tail = (lambda t: overlap_text(t, overlap)) if overlap < max_tokens * 4 else (lambda t: F.lit(""))
        chunks = packed(pieces, lambda n, more: F.floor((n + more) / 4) > max_tokens, "", tail)
        last = lambda j: F.get(all_, F.coalesce(F.get(full, j + 1), F.size(all_)) - 1)["name"]
        return F.transform(chunks, lambda c: let(strip(c["text"]), lambda t: chunk(t, last(c["last"]), "semantic_boundary", kind_name)))

    def chunked(text: Column, x: Column) -> Column:
        kind_name = F.coalesce(x["kind"], F.lit("general"))
        full = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: strip(F.get(s, i)["s"]) != "")
        typed = let(let(segments(text, x["found"]), lambda s: F.struct(s.alias("all"), full(s).alias("full"))), lambda y: by_boundary(y, kind_name))
        plain = F.transform(paragraph_chunks(text, max_tokens), lambda t: chunk(t, F.lit("paragraph_group"), "paragraph_fallback", kind_name))
        return F.when(F.size(x["found"]) > 0, typed.cast(CHUNK)).otherwise(plain.cast(CHUNK))

    def all_of(text: Column) -> Column:
        of_kind = kind(text) if by_kind else F.lit(None).cast("string")
        found = let(of_kind, lambda k: F.struct(k.alias("kind"), boundaries(text, k if by_kind else None).alias("found")))
        return let(found, lambda x: chunked(text, x))

    return df.withColumn("chunks", let(F.coalesce(F.col(text_col), F.lit("")), all_of))


# --- frames of chunks ---------------------------------------------------------------------------


def exploded(df: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    """One row a chunk: id, ``chunk_index`` from 0, ``chunk_text``, ``token_count``."""
    rows = df.select(F.col(id_col), F.posexplode(chunks).alias("chunk_index", "chunk_text"))
    return rows.withColumn("token_count", F.size(tokens(F.col("chunk_text"))))


def embedding_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 128) -> DataFrame:
    """Chunks made ready for embedding: id, position, length, words, quality, status, and how many there are."""
    whole = df.select(F.col(id_col).cast("string").alias("document_id"), char_chunks(F.col(text_col), size, overlap).alias("chunks"))
    rows = whole.select("document_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_position", "chunk_text"))
    digits = F.when(F.col("chunk_position") < 1000, F.lpad(F.col("chunk_position").cast("string"), 3, "0")).otherwise(F.col("chunk_position").cast("string"))
    length = F.length("chunk_text")
    rows = rows.withColumns(
        {
            "chunk_id": F.concat("document_id", F.lit("_chunk_"), digits),
            "chunk_length": length,
            "chunk_word_count": F.size(F.split("chunk_text", r"(?U)\s+")),
            "chunk_quality": F.when(length.between(100, 1000), "optimal").otherwise("suboptimal"),
            "embedding_status": F.lit("ready_for_embedding"),
        }
    )
    detail = F.struct("chunk_position", "total_chunks", "chunk_length", F.lit(overlap).alias("overlap"))
    return rows.withColumn("chunk_metadata", F.to_json(detail))
