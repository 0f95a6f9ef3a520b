import hashlib
from collections import Counter, defaultdict

from fixtures import documents, plain

from lakeloom.llm import linededup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least=10):
    holders = defaultdict(set)
    low = lambda i: -(2**63) if i is None else i
    for i, text, _ in rows:
        for line in text.split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(low(i))
    out = Counter()
    for i, text, _ in rows:
        lines = text.split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == low(i)]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_brute_force(spark):
    docs = documents(spark)
    assert Counter(map(tuple, linededup.digests(docs).collect())) == brute(plain(docs))


def test_hot_line_over_many_partitions(spark):
    rows = ["a very common line indeed\nown %d xxxxxxxx\na very common line indeed" % i for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = documents(spark, rows)
        got = Counter(map(tuple, linededup.digests(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(plain(docs))


def test_rewritten_documents(spark):
    docs = documents(spark, ["only shared line", "only shared line", "only shared line\nmine alone here"])
    got = {r.doc_id: r for r in linededup.deduplicated(docs).collect()}
    assert docs.columns == linededup.deduplicated(docs).columns
    assert {i: r.text for i, r in got.items()} == {0: "only shared line", 6: "mine alone here"}
    assert got[6].n_chars == 15 and got[6].size == "clash"
    assert linededup.digests(docs.limit(0)).count() == 0


def test_text_of_many_megabytes(spark):
    lines = [f"line number {i} of a long text" for i in range(400_000)]
    docs = spark.createDataFrame([(2, "\n".join(lines)), (1, "\n".join(lines[5::1000])), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.digests(docs).collect()}
    assert len("\n".join(lines)) > 12_000_000 and got == {1: (400, 0), 2: (400_000, 400), 3: (1, 0)}
    assert linededup.deduplicated(docs).filter("doc_id = 2").selectExpr("length(text) AS n").first().n == len("\n".join(x for i, x in enumerate(lines) if i % 1000 != 5))
